"""Queries of small rules and of persons and folders, over what the given tables hold."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import privacy, scopes
from tallyspark.plans.registry import query
from tallyspark.sources import bridge as B
from tallyspark.sources import files
from tallyspark.sources.shared import shared_dir


def one_of(key, *values):
    """The value whose place is the key's remainder."""
    return F.get(F.array(*values), (key % len(values)).cast("int"))


@query("P18_repos", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'acme/r' || o_orderkey WHEN 1 THEN 'acme/r' || o_orderkey WHEN 4 THEN 'g/sub/r' || o_orderkey END AS repo FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    n = k.cast("string")
    raw = one_of(k, F.concat(F.lit("Acme/R"), n, F.lit(".git/")), F.concat(F.lit(" /acme/r"), n, F.lit(".git.git")), F.concat(F.lit("solo"), n), F.concat(F.lit("a/../r"), n), F.concat(F.lit("g/sub/r"), n), F.concat(F.lit("A B/r"), n))
    return B.table(spark, sf, "orders").select("o_orderkey", S.canonical_repo(raw).alias("repo"))


@query("P19_buckets", "SELECT CASE WHEN event_id % 5 < 2 THEN 'unattributed:main' WHEN event_id % 5 < 4 THEN 'unattributed:detached-head' ELSE 'unattributed:branch-without-issue' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    k = F.col("event_id")
    branch = one_of(k, F.lit("main"), F.lit(" master"), F.lit("HEAD"), F.lit(None).cast("string"), F.concat(F.lit("x/"), k.cast("string")))
    return B.table(spark, sf, "events").groupBy(S.bucket_of_branch(branch).alias("bucket")).agg(F.count("*").alias("n"))


@query("P31_dates", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('year', o_orderdate)::TIMESTAMP WHEN 1 THEN date_trunc('month', o_orderdate)::TIMESTAMP WHEN 2 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS starts FROM orders")
def _(spark, sf):
    d = F.col("o_orderdate")
    raw = one_of(F.col("o_orderkey"), F.date_format(d, "yyyy"), F.date_format(d, "yyyy-MM"), F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd.MM.yyyy"))
    return B.table(spark, sf, "orders").select("o_orderkey", S.window_date(raw).cast("timestamp_ntz").alias("starts"))


@query("P38_ranges", "SELECT o_custkey, strftime(m, '%Y-%m') AS period FROM (SELECT o_custkey, unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders GROUP BY 1)")
def _(spark, sf):
    """Every month from a customer's first order to the last."""
    at = B.table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_date(F.date_trunc("month", F.min("o_orderdate"))).alias("a"), F.to_date(F.date_trunc("month", F.max("o_orderdate"))).alias("b"))
    return at.select("o_custkey", F.explode(F.expr("sequence(a, b, INTERVAL 1 MONTH)")).alias("m")).select("o_custkey", F.date_format("m", "yyyy-MM").alias("period"))


@query("S18_price_file", "SELECT lower(p_brand) AS key, max(floor(p_retailprice))::DOUBLE AS input_per_m FROM part GROUP BY 1")
def _(spark, sf):
    """A price file with a rate for each brand, written and read."""
    rate = F.struct(F.lit("x").alias("provider"), F.max(F.floor("p_retailprice")).cast("double").alias("input_per_m"), F.lit(1.0).alias("output_per_m"))
    brands = B.table(spark, sf, "part").groupBy(F.lower("p_brand").alias("key")).agg(rate.alias("rate"))
    body = brands.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.map_from_entries(F.collect_list(F.struct("key", "rate"))).alias("models"))).alias("value"))
    path = f"{shared_dir(spark)}/prices-{uuid.uuid4().hex}"
    body.write.text(path)
    return files.read_prices(spark, path).select("key", "input_per_m")


@query("X20_aliases_as_of", """, s AS (SELECT row_number() OVER (ORDER BY period) AS seal FROM (SELECT DISTINCT strftime(ts, '%Y-%m') AS period FROM outcomes)), a AS (SELECT c_custkey, c_custkey % 50 AS since_seal, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 50 + c_custkey % 7 END AS ended_seal FROM customer)
SELECT seal, count(*) AS aliases FROM s JOIN a ON since_seal < seal AND (ended_seal IS NULL OR seal <= ended_seal) GROUP BY 1""")
def _(spark, sf):
    """Aliases in force at each seal: each alias starts one and may end one, and what is open is summed over the seals, which are months."""
    from pyspark.sql.window import Window

    months = B.outcomes(spark, sf).select(F.date_format("ts", "yyyy-MM").alias("period")).distinct()
    seals = months.select(F.row_number().over(Window.orderBy("period")).cast("long").alias("seal"))
    k = F.col("c_custkey")
    a = B.table(spark, sf, "customer").select((k % 50).alias("since"), F.when(k % 3 > 0, k % 50 + k % 7).alias("ended"))
    opens = a.where("ended is null or ended > since").select(F.explode(F.array(F.struct((F.col("since") + 1).alias("seal"), F.lit(1).alias("d")), F.struct((F.col("ended") + 1).alias("seal"), F.lit(-1).alias("d")))).alias("x")).select("x.*").where("seal is not null")
    steps = opens.groupBy("seal").agg(F.sum("d").alias("d")).unionByName(seals.withColumn("d", F.lit(0).cast("long"))).groupBy("seal").agg(F.sum("d").alias("d"))
    open_ = steps.withColumn("aliases", F.sum("d").over(Window.orderBy("seal").rowsBetween(Window.unboundedPreceding, 0)))
    return open_.join(seals, "seal").where("aliases > 0").select("seal", "aliases")


ROOTS = """d AS (SELECT DISTINCT '/w/r' || (o_orderkey % 40) || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/sub' || (o_custkey % 4) ELSE '/sub' || (o_custkey % 4) || '/x' || (o_custkey % 3) END AS cwd FROM orders),
r AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN '/w/r' || (s_suppkey % 40) ELSE '/w/r' || (s_suppkey % 40) || '/sub' || (s_suppkey % 4) END AS root FROM supplier), rm AS (SELECT root, CASE WHEN root LIKE '%/sub3' THEN '/w/r2' ELSE root END AS main FROM r),
t AS (SELECT '/w/r' || (n_nationkey * 2) AS target, n_nationkey AS place FROM nation)"""


@query("P39_scopes", f"""WITH {ROOTS}, own AS (SELECT p, max_by(main, length(root)) AS main FROM (SELECT cwd AS p FROM d UNION SELECT target FROM t) JOIN rm ON p = root OR starts_with(p, root || '/') GROUP BY 1),
x AS (SELECT cwd, target, place, o.main AS own, q.main AS t_root, cwd = target OR starts_with(cwd, target || '/') AS inside FROM d CROSS JOIN t LEFT JOIN own o ON o.p = cwd LEFT JOIN own q ON q.p = target),
y AS (SELECT cwd, target, place, CASE WHEN inside AND NOT coalesce(own <> t_root AND starts_with(own, t_root || '/'), false) THEN 0 WHEN NOT inside AND (own = target OR starts_with(own, target || '/')) THEN 1 END AS rank FROM x)
SELECT cwd, CASE min(rank) WHEN 0 THEN 'direct' WHEN 1 THEN 'worktree' ELSE 'foreign' END AS scope, min_by(target, rank * 1000 + place) AS target FROM y GROUP BY 1""")
def _(spark, sf):
    """Folders of orders against targets and repositories, some of which are nested and some linked to another."""
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("s_suppkey")
    text = lambda x: x.cast("string")
    sub = F.concat(F.lit("/sub"), text(c % 4))
    cwd = F.concat(F.lit("/w/r"), text(k % 40), one_of(k, F.lit(""), sub, F.concat(sub, F.lit("/x"), text(c % 3))))
    root = F.concat(F.lit("/w/r"), text(s % 40), F.when(s % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("/sub"), text(s % 4))))
    roots = B.table(spark, sf, "supplier").select(root.alias("root")).distinct().withColumn("main", F.when(F.col("root").endswith("/sub3"), F.lit("/w/r2")).otherwise(F.col("root")))
    targets = B.table(spark, sf, "nation").select(F.concat(F.lit("/w/r"), text(F.col("n_nationkey") * 2)).alias("target"), F.col("n_nationkey").alias("place"))
    return scopes.scoped(B.table(spark, sf, "orders").select(cwd.alias("cwd")), targets, roots)


@query("X12_erased", "SELECT 'events' AS stored, count(*) FILTER (developer NOT IN ('dev-1', 'dev-2', 'dev-3')) AS kept, count(*) FILTER (developer IN ('dev-1', 'dev-2', 'dev-3')) AS taken, 0 AS named FROM token_events UNION ALL SELECT 'outcomes', count(*), count(*) FILTER (developer IN ('dev-1', 'dev-2', 'dev-3')), count(DISTINCT developer) FILTER (developer NOT IN ('dev-1', 'dev-2', 'dev-3')) FROM outcomes")
def _(spark, sf):
    """One person with two more ids: their events go, and outcomes keep their points without a name. Nothing is left that names them."""
    k = F.col("c_custkey")
    aliases = B.table(spark, sf, "customer").where(k.isin(1, 2)).select(F.concat(F.lit("dev-"), (k + 1).cast("string")).alias("alias"), F.concat(F.lit("dev-"), k.cast("string")).alias("canonical"))
    ids = privacy.identities(aliases, "dev-3")
    tables = {"events": privacy.Stored(B.token_events(spark, sf), "developer"), "outcomes": privacy.Stored(B.outcomes(spark, sf), None, (("developer", ("developer",)),))}
    new, counts = privacy.taken_away(tables, ids)
    row = lambda name, named: new[name].agg(F.lit(name).alias("stored"), F.count("*").alias("kept"), F.lit(counts[name]).cast("long").alias("taken"), named.alias("named"))
    left = F.count(F.when(F.col("developer").isin(*ids), 1))
    return row("events", left).unionByName(row("outcomes", left + F.countDistinct("developer")))

"""Queries of manifests, amendments and price tables by identity."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tallyspark.operators import amend, manifest, pricing, registry
from tallyspark.plans.basics import PRICED
from tallyspark.plans.registry import query
from tallyspark.sources import bridge as B
from tallyspark.sources.shared import shared_dir

SINCE, UNTIL = "1996-01-01", "1997-01-01"
NOW = datetime(1999, 6, 1)


@query("X8_table_hash", "SELECT 'table-1:' || sha256(string_agg(strlen(p_brand) || ':' || p_brand || strlen(dearest::VARCHAR) || ':' || dearest || strlen(n::VARCHAR) || ':' || n, '' ORDER BY p_brand)) AS hash FROM (SELECT p_brand, max(floor(p_retailprice))::BIGINT AS dearest, count(*) AS n FROM part GROUP BY 1)")
def _(spark, sf):
    """A small table, a row for each brand, by the bytes of its rows."""
    brands = B.table(spark, sf, "part").groupBy("p_brand").agg(F.max(F.floor("p_retailprice")).alias("dearest"), F.count("*").alias("n"))
    return spark.createDataFrame([(manifest.table_hash(brands, "p_brand", ["dearest", "n"]),)], "hash string")


def pinned_and_now(spark, sf):
    """A manifest of the rows that had come up to the middle of all ids, and what is there now, with one outcome in a hundred changed."""
    e = B.token_events(spark, sf).select("id", "developer", "repo", "cost_micro", "ts")
    o = B.outcomes(spark, sf).select("id", "developer", "points20", "ts")
    half = (e.agg(F.max("id")).first()[0] or 0) // 2
    now = o.withColumn("points20", F.when(F.col("id") % 100 == 7, F.col("points20") + 1).otherwise(F.col("points20")))
    pops = lambda e, o: {"events": manifest.Population(e, ("id", "developer", "repo", "cost_micro", "ts"), days_before=14), "outcomes": manifest.Population(o, ("id", "developer", "points20", "ts"))}
    report = lambda e: e.where(f"ts >= timestamp_ntz '{SINCE}' and ts < timestamp_ntz '{UNTIL}'").groupBy("developer").agg(F.sum("cost_micro").alias("cost_micro"))
    early = e.where(F.col("id") <= half)
    then = manifest.manifest(pops(early, o), {"k": "3", "aggregation": "team"}, SINCE, UNTIL, report(early))
    return then, pops(e, now), report(e)


@query("X9_manifest", f"""SELECT 'events' AS population, count(*) AS n, max(id) AS through FROM token_events WHERE ts >= TIMESTAMP '{SINCE}' - INTERVAL 14 DAYS AND ts < TIMESTAMP '{UNTIL}' AND id <= (SELECT max(id) // 2 FROM token_events)
UNION ALL SELECT 'outcomes', count(*), max(id) FROM outcomes WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}'""")
def _(spark, sf):
    then, _, _ = pinned_and_now(spark, sf)
    return spark.createDataFrame([(k, p["n"], p["through"]) for k, p in then["populations"].items()], "population string, n long, through long")


@query("X9_differences", f"""SELECT 'k' AS dimension, 'pin' AS kind, '4' AS now UNION ALL SELECT 'events', 'late', count(*) || ' rows since' FROM token_events WHERE ts >= TIMESTAMP '{SINCE}' - INTERVAL 14 DAYS AND ts < TIMESTAMP '{UNTIL}'
  AND id > (SELECT max(id) FROM token_events WHERE ts >= TIMESTAMP '{SINCE}' - INTERVAL 14 DAYS AND ts < TIMESTAMP '{UNTIL}' AND id <= (SELECT max(id) // 2 FROM token_events)) HAVING count(*) > 0
UNION ALL SELECT 'outcomes', 'changed', count(*) || ' rows' FROM outcomes WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}' HAVING count(*) FILTER (id % 100 = 7) > 0
UNION ALL SELECT 'report', 'report', count(DISTINCT developer) || ' rows' FROM token_events WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}'""")
def _(spark, sf):
    then, now, report = pinned_and_now(spark, sf)
    found = manifest.verify(then, now, {"k": "4", "aggregation": "team"}, report)
    # a digest follows the number of rows; it is left out here
    return spark.createDataFrame([(d.dimension, d.kind, " ".join(d.now.split()[:2]) if d.kind in ("changed", "report") else d.now) for d in found], "dimension string, kind string, now string")


@query("X11_repair_plan", """, m AS (SELECT DISTINCT session_id, 'acme/r' || (substr(session_id, 3)::BIGINT % 5 + 1) AS mapped FROM token_events WHERE substr(session_id, 3)::BIGINT % 2 = 1)
SELECT CASE WHEN developer <> 'dev-7' THEN 'keep' WHEN repo <> 'unqualified' THEN CASE WHEN mapped <> repo THEN 'conflict' ELSE 'keep' END WHEN mapped IS NULL THEN 'unresolved' ELSE 'change' END AS verdict, count(*) AS n, sum(cost_micro)::BIGINT AS cost_micro FROM token_events LEFT JOIN m USING (session_id) GROUP BY 1""")
def _(spark, sf):
    """What a repair of one developer's rows would do, by a mapping of every other session."""
    e = B.token_events(spark, sf)
    number = F.substring("session_id", 3, 20).cast("long")
    m = e.select("session_id").distinct().where(number % 2 == 1).select("session_id", F.concat(F.lit("acme/r"), (number % 5 + 1).cast("string")).alias("repo"))
    return amend.repair_repositories(e, m, "dev-7", "operator", "unknown repositories").counts()


@query("T17_overridden", "SELECT developer, sum(CASE WHEN id % 97 = 0 AND source <> 'anthropic-admin' THEN 1000 ELSE cost_micro END)::BIGINT AS cost_micro, count(*) FILTER (id % 97 = 0 AND source <> 'anthropic-admin' AND cost_micro <> 1000) AS audited, sum(cost_micro) FILTER (id % 97 = 0 AND source <> 'anthropic-admin' AND cost_micro <> 1000)::BIGINT AS was FROM token_events GROUP BY 1")
def _(spark, sf):
    """Costs set by hand, of rows that no poller counts: the new table's sums, with the rows of the audit and what they were."""
    e = B.token_events(spark, sf).withColumn("provider", F.col("source"))
    # ids repeat here, once for each source: rows are told apart by both
    one = F.concat_ws("/", "id", "source").alias("id")
    o = e.where("id % 97 = 0 and source != 'anthropic-admin'").select(one).distinct()
    e = e.withColumn("id", one)
    o = o.select("id", F.lit(1000).cast("long").alias("cost_micro"), F.lit("operator").alias("actor"), F.lit("bill").alias("reason"), F.lit(None).cast("string").alias("billed_to"), F.lit(1).alias("place"))
    table, audit = amend.override_costs(e, o, ["anthropic-admin"]).committed()
    was = audit.groupBy("developer").agg(F.count("*").alias("audited"), F.sum("cost_micro").alias("was"))
    return table.groupBy("developer").agg(F.sum("cost_micro").alias("cost_micro")).join(was, "developer", "left").fillna(0, ["audited"])


def price_log(spark):
    """Versions 1 and 2 with one identity each, 3 with two."""
    log = registry.PriceRegistry(spark, f"{shared_dir(spark)}/prices-{uuid.uuid4().hex}")
    all_, some = pricing.price_table(spark), pricing.price_table(spark, pricing.SAMPLE[:4])
    log.record(1, all_, NOW)
    log.record(2, all_, NOW)
    log.record(3, some, NOW)
    log.forget(3, "operator", "lacks rates", NOW)
    log.record(3, all_, NOW)
    return log


@query("X18_first_prices", f"{PRICED} SELECT price_version, count(*) AS n, sum(priced_micro)::BIGINT AS original_micro, sum(cost_micro)::BIGINT AS cost_micro FROM priced WHERE price_version IN (1, 2) AND source IN ('jsonl', 'proxy') AND guess IS NULL AND id % 50 <> 0 AND NOT (cost_micro <> 0 AND input_tok + output_tok + cache_read + cache_write_5m + cache_write_1h = 0) GROUP BY 1")
def _(spark, sf):
    """Rows at the table they were first priced with; a version that has had two tables is left out."""
    none = F.lit(None).cast("string")
    e = B.token_events(spark, sf).withColumns({"rate_snapshot": none, "pricing_basis": none})
    got, _ = registry.original_basis(e, price_log(spark), [1, 2, 3], e.where("id % 50 = 0").select("id").distinct())
    return got.groupBy("price_version").agg(F.count("*").alias("n"), F.sum("original_micro").alias("original_micro"), F.sum("cost_micro").alias("cost_micro"))

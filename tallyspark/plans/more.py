"""Queries of token accounting, ledgers, labels, closing of months and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import scalars as S
from tallyspark.functions import text as T
from tallyspark.operators import labels, ledgers, pricing, recovery, scores
from tallyspark.plans.attribution import CLAIMS, quality_events, QE
from tallyspark.plans.basics import E_SQL, EO_SQL, NORMAL, NOW, PRICED, RATIOS, SCORE_SQL, UNATTRIBUTED, _label_sql, events, scored, work
from tallyspark.plans.registry import query
from tallyspark.sources import bridge as B

AT = "JOIN memberships m ON x.developer = m.developer AND x.ts >= m.valid_from AND (m.valid_to IS NULL OR x.ts < m.valid_to)"
SUBJECTS = ("Fix #12 and closes #7, #9", "Tidy (#44)", "OP-31: start", "fixes #5 (#6)", "plain", "Refs #3")


def subjects(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, SUBJECTS)), (F.col("o_orderkey") % 6).cast("int")).alias("subject"))


def case(*values: str | None) -> str:
    return "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


@query("P12_body_issue", f"SELECT {case('issue-12', None, None, 'issue-5', None, 'issue-3')} AS issue, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return subjects(spark, sf).groupBy(T.issue_of_body(F.col("subject")).alias("issue")).agg(F.count("*").alias("n"))


@query("P13_subject_issue", f"SELECT {case('issue-12', None, 'OP-31', 'issue-5', None, None)} AS issue, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return subjects(spark, sf).groupBy(T.issue_of_subject(F.col("subject")).alias("issue")).agg(F.count("*").alias("n"))


@query("P34_subject_pull", "SELECT CASE o_orderkey % 6 WHEN 1 THEN 44 WHEN 5 THEN 3 END AS pull, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return subjects(spark, sf).groupBy(T.pull_of_subject(F.col("subject")).alias("pull")).agg(F.count("*").alias("n"))


@query("P18_canonical_repo", """SELECT raw, repo FROM (VALUES ('Owner/Repo.git/', 'owner/repo'), ('owner/repo.git.git', 'owner/repo'), ('/a/b/', 'a/b'), ('solo', NULL), ('a/../b', NULL), ('unqualified', NULL), ('A B/c', NULL), ('g/sub/x', 'g/sub/x')) t(raw, repo)""")
def _(spark, sf):
    raw = spark.createDataFrame([(x,) for x in ("Owner/Repo.git/", "owner/repo.git.git", "/a/b/", "solo", "a/../b", "unqualified", "A B/c", "g/sub/x")], "raw string")
    return raw.select("raw", S.canonical_repo(F.col("raw")).alias("repo"))


@query("P19_branch_bucket", "SELECT branch, bucket FROM (VALUES ('main', 'unattributed:main'), ('master', 'unattributed:main'), ('HEAD', 'unattributed:detached-head'), ('', 'unattributed:detached-head'), ('x/y', 'unattributed:branch-without-issue')) t(branch, bucket)")
def _(spark, sf):
    return spark.createDataFrame([(x,) for x in ("main", "master", "HEAD", "", "x/y")], "branch string").select("branch", S.bucket_of_branch(F.col("branch")).alias("bucket"))


@query("P22_first_paragraph", "SELECT doc_id, regexp_replace(string_split_regex(trim(regexp_replace(text, '^\\s+', '')), '\\n[ \\t]*\\n')[1], '\\s*\\n\\s*', ' ', 'g') AS subject FROM documents")
def _(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", T.first_paragraph(F.col("text")).alias("subject"))


@query("P23_generated", "SELECT o_orderkey % 3 AS k, o_orderkey % 3 = 0 AS generated, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, sf):
    k = F.col("o_orderkey") % 3
    paths = F.when(k == 0, F.array(F.lit("vendor/a.go"), F.lit("x/go.sum"))).when(k == 1, F.array(F.lit("vendor/a.go"), F.lit("main.go"))).otherwise(F.array().cast("array<string>"))
    return B.table(spark, sf, "orders").groupBy(k.alias("k"), T.all_generated(paths).alias("generated")).agg(F.count("*").alias("n"))


@query("P24_ci_ref", """, r AS (SELECT 'sha' || (o_orderkey % 3) || ':' || (o_orderkey % 4) || CASE WHEN o_orderkey % 2 = 0 THEN ':wf' || (o_custkey % 2) ELSE '' END AS ref FROM orders)
SELECT split_part(ref, ':', 1) AS head_sha, split_part(ref, ':', 2)::INTEGER AS attempt, nullif(split_part(ref, ':', 3), '') AS workflow, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def _(spark, sf):
    k = F.col("o_orderkey")
    ref = F.concat(F.lit("sha"), (k % 3).cast("string"), F.lit(":"), (k % 4).cast("string"), F.when(k % 2 == 0, F.concat(F.lit(":wf"), (F.col("o_custkey") % 2).cast("string"))).otherwise(F.lit("")))
    parts = F.split(ref, ":")
    return B.table(spark, sf, "orders").groupBy(F.get(parts, F.lit(0)).alias("head_sha"), F.get(parts, F.lit(1)).cast("int").alias("attempt"), F.get(parts, F.lit(2)).alias("workflow")).agg(F.count("*").alias("n"))


@query("P25_token_accounting", """, u AS (SELECT l_partkey AS total_in, l_suppkey AS cached, l_linenumber * 10 AS out, l_partkey + l_linenumber * 10 + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS total FROM lineitem)
SELECT cached <= total_in AND total_in + out = total AS valid, count(*) AS n, sum(CASE WHEN cached <= total_in AND total_in + out = total THEN total_in - cached END)::BIGINT AS input_tok, sum(CASE WHEN cached <= total_in AND total_in + out = total THEN cached END)::BIGINT AS cache_read FROM u GROUP BY 1""")
def _(spark, sf):
    n = F.col("l_linenumber").cast("long") * 10
    u = B.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("total_in"), F.col("l_suppkey").alias("cached"), n.alias("out"), (F.col("l_partkey") + n + F.when(F.col("l_orderkey") % 10 == 0, 1).otherwise(0)).alias("total"))
    split = S.split_cached(u, "total_in", "cached", "out", "total")
    return split.groupBy("valid").agg(F.count("*").alias("n"), F.sum("input_tok").alias("input_tok"), F.sum("cache_read").alias("cache_read"))


@query("P28_clamped", "SELECT c_nationkey, sum(greatest(floor(c_acctbal)::BIGINT, 0))::BIGINT AS kept, count(*) FILTER (c_acctbal < 0) AS clamped FROM customer GROUP BY 1")
def _(spark, sf):
    return B.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum(S.clamped(F.floor("c_acctbal"))).alias("kept"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("clamped"))


@query("P29_aliases", "SELECT CASE WHEN regexp_matches(developer, '^dev-4') THEN 'dev-1' ELSE developer END AS developer, sum(cost_micro)::BIGINT AS cost_micro FROM token_events GROUP BY 1")
def _(spark, sf):
    aliases = B.memberships(spark, sf).select(F.col("developer").alias("alias")).where("alias rlike '^dev-4'").distinct().withColumn("canonical", F.lit("dev-1"))
    return recovery.canonical(B.token_events(spark, sf), aliases).groupBy("developer").agg(F.sum("cost_micro").alias("cost_micro"))


@query("P30_period_bounds", "SELECT DISTINCT period, (period || '-01')::DATE AS starts, ((period || '-01')::DATE + INTERVAL 1 MONTH)::DATE AS ends FROM spend")
def _(spark, sf):
    start = F.to_date(F.concat("period", F.lit("-01")))
    return B.spend(spark, sf).select("period").distinct().select("period", start.alias("starts"), F.add_months(start, 1).alias("ends"))


@query("P32_premium", f"{PRICED} SELECT m AS model, bool_and(how < 2) AS exact, bool_or(how < 2 AND i >= 4) AS premium FROM priced GROUP BY 1")
def _(spark, sf):
    rates = pricing.price_table(spark).select(F.col("key").alias("k"), "input_per_m")
    e = B.token_events(spark, sf).select(S.normal_model(F.col("model")).alias("model"), S.normal_host(F.col("host")).alias("host")).distinct()
    own = e.join(rates.withColumnRenamed("input_per_m", "a"), F.concat_ws("@", "model", "host") == F.col("k"), "left").drop("k").join(rates.withColumnRenamed("input_per_m", "b"), F.col("model") == F.col("k"), "left")
    rate = F.coalesce("a", "b")
    return own.groupBy("model").agg(F.bool_and(rate.isNotNull()).alias("exact"), F.coalesce(F.bool_or(rate >= 4), F.lit(False)).alias("premium"))


@query("P33_safe_since", "SELECT source, CASE WHEN min(ts) = date_trunc('day', min(ts)) THEN min(ts)::DATE ELSE (min(ts)::DATE + INTERVAL 1 DAY)::DATE END AS safe FROM (SELECT event_type AS source, ts FROM events) GROUP BY 1")
def _(spark, sf):
    first = B.table(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(F.min("ts").alias("t"))
    day = F.to_date("t")
    return first.select("source", F.when(F.col("t") == day.cast("timestamp_ntz"), day).otherwise(F.date_add(day, 1)).alias("safe"))


@query("P35_revert_pull", "SELECT o_orderkey % 4 AS k, o_orderkey % 4 IN (0, 2) AS revert, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, sf):
    k = (F.col("o_orderkey") % 4).cast("int")
    head, title = F.get(F.array(*map(F.lit, ("revert-12-x", "revert-x", "feat/a", "b"))), k), F.get(F.array(*map(F.lit, ("a", "Reverting", 'Revert "Add"', "Revert: x"))), k)
    return B.table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 4).alias("k"), (head.rlike(r"^revert-\d+-") | F.startswith(title, F.lit('Revert "'))).alias("revert")).agg(F.count("*").alias("n"))


@query("P36_json_scalar", "SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return B.table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("P37_date_scalars", "SELECT date_trunc('month', ts)::DATE AS month, (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE AS next_month, min((ts::DATE - INTERVAL 7 DAYS)::DATE) AS week_before, count(*) AS n FROM outcomes GROUP BY 1, 2")
def _(spark, sf):
    month = F.to_date(F.date_trunc("month", "ts"))
    return B.outcomes(spark, sf).groupBy(month.alias("month"), F.add_months(month, 1).alias("next_month")).agg(F.min(F.date_sub(F.to_date("ts"), 7)).alias("week_before"), F.count("*").alias("n"))


@query("P40_stat_encoding", "SELECT CASE WHEN pr_number IS NULL THEN 'n' ELSE 'v' || (pr_number % 10) END AS stat, count(*) AS n FROM token_events GROUP BY 1")
def _(spark, sf):
    return B.token_events(spark, sf).groupBy(F.when(F.col("pr_number").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), (F.col("pr_number") % 10).cast("string"))).alias("stat")).agg(F.count("*").alias("n"))


@query("F8_people_only", "SELECT count(DISTINCT developer) AS people FROM token_events WHERE NOT (developer = '' OR developer LIKE 'unattributed%')")
def _(spark, sf):
    return B.token_events(spark, sf).where(~S.unattributed(F.col("developer"))).agg(F.countDistinct("developer").alias("people"))


@query("F9_protected_band", "SELECT count(*) AS n FROM token_events e WHERE NOT EXISTS (SELECT 1 FROM (VALUES (TIMESTAMP '1997-03-01', TIMESTAMP '1997-04-01'), (TIMESTAMP '1998-01-01', TIMESTAMP '1998-02-01')) s(f, u) WHERE e.ts < s.u AND e.ts >= s.f - INTERVAL 14 DAYS)")
def _(spark, sf):
    seals = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '1997-03-01', TIMESTAMP_NTZ '1997-04-01'), (TIMESTAMP_NTZ '1998-01-01', TIMESTAMP_NTZ '1998-02-01') AS s(starts, ends)")
    return recovery.unsealed(B.token_events(spark, sf), seals).agg(F.count("*").alias("n"))


@query("F11_settled_days", f"SELECT ts::DATE AS day, count(*) AS n FROM token_events WHERE ts::DATE + INTERVAL 1 DAY <= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS GROUP BY 1")
def _(spark, sf):
    ends = F.date_add(F.to_date("ts"), 1).cast("timestamp_ntz")
    return B.token_events(spark, sf).where(ends <= F.lit(NOW).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("J1_tolerant_join", f"{EO_SQL}, k AS (SELECT DISTINCT developer, issue_id, repo FROM o), c AS (SELECT developer, issue_id, repo, count(*) AS n FROM e GROUP BY 1, 2, 3) SELECT k.repo AS work_repo, c.repo AS cost_repo, count(*) AS pairs, sum(n)::BIGINT AS n FROM k JOIN c ON k.developer = c.developer AND k.issue_id = c.issue_id AND (k.repo = c.repo OR k.repo IN ('', 'unqualified') OR c.repo IN ('', 'unqualified')) GROUP BY 1, 2")
def _(spark, sf):
    k = work(spark, sf).select("developer", "issue_id", F.col("repo").alias("work_repo")).distinct()
    c = events(spark, sf).groupBy("developer", "issue_id", F.col("repo").alias("cost_repo")).agg(F.count("*").alias("n"))
    both = k.join(c, ["developer", "issue_id"]).where(S.repos_match(F.col("work_repo"), F.col("cost_repo")))
    return both.groupBy("work_repo", "cost_repo").agg(F.count("*").alias("pairs"), F.sum("n").alias("n"))


@query("J10_all_developers", f"{EO_SQL} SELECT developer FROM e UNION SELECT developer FROM o UNION SELECT developer FROM spend WHERE developer IS NOT NULL")
def _(spark, sf):
    ids = [df.select("developer") for df in (events(spark, sf), work(spark, sf), B.spend(spark, sf).where("developer is not null"))]
    return ids[0].union(ids[1]).union(ids[2]).distinct()


@query("J13_latest_declaration", "SELECT repo, pr, merged_at, merge_sha FROM (SELECT repo, pr_number % 400 AS pr, merged_at, merge_sha, row_number() OVER (PARTITION BY repo, pr_number % 400 ORDER BY merged_at DESC, merge_sha DESC) AS r FROM outcomes) WHERE r = 1")
def _(spark, sf):
    o = B.outcomes(spark, sf).select("repo", (F.col("pr_number") % 400).alias("pr"), "merged_at", "merge_sha")
    return ledgers.first_writer(o, ["repo", "pr"], [F.desc("merged_at"), F.desc("merge_sha")])


@query("J14_latest_events", ", m AS (SELECT developer, source, max(ts) AS ts FROM token_events GROUP BY 1, 2) SELECT developer, source, ts, count(*) AS n, max(id) AS id FROM token_events JOIN m USING (developer, source, ts) GROUP BY 1, 2, 3")
def _(spark, sf):
    e = B.token_events(spark, sf)
    last = F.max("ts").over(Window.partitionBy("developer", "source"))
    return e.withColumn("last", last).where("ts = last").groupBy("developer", "source", "ts").agg(F.count("*").alias("n"), F.max("id").alias("id"))


@query("J15_evidence_join", f"{QE}, h AS (SELECT DISTINCT outcome_id FROM qe WHERE event_type = 'ci_fail_flaky') SELECT o.work_type, q.event_type, h.outcome_id IS NOT NULL AS recovered, count(*) AS n FROM qe q JOIN outcomes o ON q.outcome_id = o.id LEFT JOIN h ON h.outcome_id = o.id GROUP BY 1, 2, 3")
def _(spark, sf):
    q, o = quality_events(spark, sf), B.outcomes(spark, sf).select(F.col("id").alias("outcome_id"), "work_type")
    h = q.where("event_type = 'ci_fail_flaky'").select("outcome_id").distinct().withColumn("hit", F.lit(True))
    return q.join(o, "outcome_id").join(h, "outcome_id", "left").groupBy("work_type", "event_type", F.col("hit").isNotNull().alias("recovered")).agg(F.count("*").alias("n"))


@query("J19_rate_snapshot", f"{PRICED}, s AS (SELECT id, max(priced_micro) AS snap FROM priced WHERE price_version = 1 GROUP BY 1) SELECT price_version, count(*) AS n, count(snap) AS with_rate FROM token_events LEFT JOIN s USING (id) GROUP BY 1")
def _(spark, sf):
    e = B.token_events(spark, sf)
    snap = pricing.priced(e.where("price_version = 1"), pricing.price_table(spark)).groupBy("id").agg(F.max("priced_micro").alias("snap"))
    return e.join(snap, "id", "left").groupBy("price_version").agg(F.count("*").alias("n"), F.count("snap").alias("with_rate"))


@query("J20_subagent_parent", "SELECT c.conv_id, c.turn, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def _(spark, sf):
    c = B.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    return c.join(p, ["conv_id", "turn"], "left").select("conv_id", "turn", "parent_role")


@query("A14_captured_buckets", f"{E_SQL} SELECT source AS engine, CASE WHEN {UNATTRIBUTED} THEN issue_id ELSE 'attributed' END AS bucket, count(*) AS n, sum(cost_micro)::BIGINT AS cost_micro, sum(cost_micro)::DOUBLE / sum(sum(cost_micro)) OVER () AS share FROM e WHERE source <> 'anthropic-admin' GROUP BY 1, 2")
def _(spark, sf):
    bucket = F.when(S.unattributed(F.col("issue_id")), F.col("issue_id")).otherwise(F.lit("attributed"))
    g = events(spark, sf).where("source != 'anthropic-admin'").groupBy(F.col("source").alias("engine"), bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("cost_micro").alias("cost_micro"))
    return g.withColumn("share", F.col("cost_micro") / F.sum("cost_micro").over(Window.partitionBy()))


def by_team(spark, sf):
    return scores.labelled(events(spark, sf), B.memberships(spark, sf), "team")


@query("A24_census", f"{E_SQL} SELECT coalesce(team, '') AS label, count(DISTINCT x.developer) AS people, count(DISTINCT CASE WHEN cache_read > 150000 THEN x.developer END) AS carriers, count(DISTINCT CASE WHEN cache_read > 150000 THEN x.developer END) >= 3 AND count(DISTINCT x.developer) - count(DISTINCT CASE WHEN cache_read > 150000 THEN x.developer END) >= 3 AS clears FROM e x LEFT {AT} GROUP BY 1")
def _(spark, sf):
    return labels.census(by_team(spark, sf).withColumn("has", F.col("cache_read") > 150_000), "has")


@query("A26_refold", f"{E_SQL} SELECT coalesce(team, '') AS label, sum(cost_micro)::BIGINT AS cost_micro, count(DISTINCT x.developer)::INTEGER AS people FROM e x LEFT {AT} GROUP BY 1")
def _(spark, sf):
    rows = by_team(spark, sf)
    kept = [labels.prefolded(rows.where(F.year("ts") == y)) for y in (1997, 1998, 1999)]
    return labels.refolded(kept[0].unionByName(kept[1]).unionByName(kept[2]))


@query("A28_team_levers", f"{E_SQL}, p AS (SELECT coalesce(team, '') AS label, x.developer, bool_or(cache_read > 0) AS reads, sum(cache_read) AS r, sum(input_tok + cache_read) AS t FROM e x LEFT {AT} GROUP BY 1, 2) SELECT label, count(*) FILTER (reads) AS carriers, count(*) FILTER (NOT reads) AS others, CASE WHEN count(*) FILTER (reads) >= 3 AND count(*) FILTER (NOT reads) >= 3 THEN sum(r)::DOUBLE / sum(t) END AS read_share FROM p GROUP BY 1")
def _(spark, sf):
    return labels.levers(by_team(spark, sf))


@query("A30_corrections", ", c AS (SELECT DISTINCT p.id FROM outcomes p JOIN outcomes c ON c.repo = p.repo AND c.head_branch_hash = p.head_branch_hash AND c.id <> p.id AND c.merged_at >= p.merged_at AND c.merged_at <= p.merged_at + INTERVAL 14 DAYS) SELECT repo, count(*) AS corrected FROM c JOIN outcomes USING (id) GROUP BY 1")
def _(spark, sf):
    return recovery.followed(B.outcomes(spark, sf)).groupBy("repo").agg(F.count("*").alias("corrected"))


@query("A33_scope_disclosure", f"{E_SQL} SELECT count(*) AS n, sum(cost_micro)::BIGINT AS cost_micro FROM e WHERE repo = 'unqualified'")
def _(spark, sf):
    return events(spark, sf).where("repo = 'unqualified'").agg(F.count("*").alias("n"), F.sum("cost_micro").alias("cost_micro"))


@query("A35_aggregate_prices", f"{PRICED} SELECT billing_mode, count(*) FILTER (guess IS NOT NULL) AS approx, count(*) FILTER (price_version < 3) AS historical, sum(greatest(priced_micro - cost_micro, 0))::BIGINT AS ceiling_micro FROM priced GROUP BY 1")
def _(spark, sf):
    p = pricing.priced(B.token_events(spark, sf), pricing.price_table(spark))
    return p.groupBy("billing_mode").agg(F.count(F.when(F.col("guess").isNotNull(), 1)).alias("approx"), F.count(F.when(F.col("price_version") < 3, 1)).alias("historical"), F.sum(S.clamped(F.col("priced_micro") - F.col("cost_micro"))).alias("ceiling_micro"))


@query("A43_local_scores", f"{E_SQL}, c AS (SELECT developer, issue_id, sum(cost_micro)::BIGINT AS cost_micro FROM e GROUP BY 1, 2) SELECT * FROM c UNION ALL SELECT developer, NULL, sum(cost_micro)::BIGINT FROM c GROUP BY 1 UNION ALL SELECT NULL, NULL, sum(cost_micro)::BIGINT FROM c")
def _(spark, sf):
    return events(spark, sf).rollup("developer", "issue_id").agg(F.sum("cost_micro").alias("cost_micro"))


@query("A47_captured_tokens", f"SELECT ts::DATE AS day, {NORMAL} AS model, sum(input_tok)::BIGINT AS input_tok, sum(output_tok)::BIGINT AS output_tok, sum(cache_read)::BIGINT AS cache_read, sum(cache_write_5m)::BIGINT AS cache_write_5m, sum(cache_write_1h)::BIGINT AS cache_write_1h FROM token_events WHERE source <> 'anthropic-admin' GROUP BY 1, 2")
def _(spark, sf):
    e = B.token_events(spark, sf).where("source != 'anthropic-admin'")
    return e.groupBy(F.to_date("ts").alias("day"), S.normal_model(F.col("model")).alias("model")).agg(*(F.sum(c).alias(c) for c in ledgers.VECTOR))


@query("A49_fill_once", "SELECT DISTINCT org, period FROM spend WHERE developer IS NOT NULL AND (org, period) NOT IN (SELECT org, period FROM spend WHERE developer IS NULL AND paid_micro > 100000000000)")
def _(spark, sf):
    s = B.spend(spark, sf)
    return s.where("developer is not null").select("org", "period").distinct().join(s.where("developer is null and paid_micro > 100000000000"), ["org", "period"], "left_anti")


@query("A52_team_rows", f"{_label_sql('team')} SELECT label, points20, cost_micro, CASE WHEN cost_micro > 0 THEN (points20 / 20.0::DOUBLE) / (cost_micro / 1e6 / 1000) ELSE 0 END AS points_per_k FROM s WHERE label <> ''")
def _(spark, sf):
    return scores.label_scores(events(spark, sf), work(spark, sf), B.memberships(spark, sf), "team").where("label != ''").select("label", "points20", "cost_micro", "points_per_k")


@query("A54_session_log", f"{PRICED} SELECT session_id, min(ts) AS starts, max(ts) AS ends, count(*) AS calls, sum(input_tok + output_tok)::BIGINT AS tokens, sum(priced_micro)::BIGINT AS priced_micro FROM priced GROUP BY 1")
def _(spark, sf):
    p = pricing.priced(B.token_events(spark, sf), pricing.price_table(spark))
    return p.groupBy("session_id").agg(F.min("ts").alias("starts"), F.max("ts").alias("ends"), F.count("*").alias("calls"), F.sum(F.col("input_tok") + F.col("output_tok")).alias("tokens"), F.sum("priced_micro").alias("priced_micro"))


@query("A55_personal_score", f"{SCORE_SQL} SELECT *, {RATIOS} FROM s WHERE developer = 'dev-7'")
def _(spark, sf):
    return scored(spark, sf).where("developer = 'dev-7'")


@query("W7_message_bounds", "SELECT conv_id, floor(turn / 2)::BIGINT AS grp, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1, 2")
def _(spark, sf):
    return B.table(spark, sf, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("grp")).agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("O1_identifier_order", f"{_label_sql('team')} SELECT row_number() OVER (ORDER BY label = '', label) AS place, label FROM s")
def _(spark, sf):
    s = scores.label_scores(events(spark, sf), work(spark, sf), B.memberships(spark, sf), "team")
    return s.select(F.row_number().over(Window.orderBy(F.col("label") == "", "label")).cast("long").alias("place"), "label")


@query("T6_observation_windows", f"{QE} SELECT event_type, count(*) AS n FROM qe JOIN outcomes o ON qe.outcome_id = o.id WHERE event_ts >= ts AND event_ts <= ts + CASE WHEN event_type LIKE 'ci%' THEN INTERVAL 48 HOURS ELSE INTERVAL 60 DAYS END GROUP BY 1")
def _(spark, sf):
    o = B.outcomes(spark, sf).select(F.col("id").alias("outcome_id"), "ts")
    limit = F.when(F.col("event_type").startswith("ci"), F.col("ts") + F.expr("INTERVAL 48 HOURS")).otherwise(F.col("ts") + F.expr("INTERVAL 60 DAYS"))
    return quality_events(spark, sf).join(o, "outcome_id").where((F.col("event_ts") >= F.col("ts")) & (F.col("event_ts") <= limit)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("T7_late_fill", f"{CLAIMS}, f AS (SELECT id, ts, cost_micro, min(outcome_id) AS pr FROM cl GROUP BY 1, 2, 3 HAVING count(DISTINCT outcome_id) = 1) SELECT count(*) AS filled FROM f WHERE ts >= TIMESTAMP '1998-02-01'")
def _(spark, sf):
    c = recovery.claims(B.token_events(spark, sf), B.outcomes(spark, sf)).groupBy("id", "ts", "cost_micro").agg(F.min("outcome_id").alias("a"), F.max("outcome_id").alias("b"))
    return c.where((F.col("a") == F.col("b")) & (F.col("ts") >= F.lit("1998-02-01").cast("timestamp_ntz"))).agg(F.count("*").alias("filled"))


@query("T10_sealable", """, mo AS (SELECT DISTINCT strftime(ts, '%Y-%m') AS period, date_trunc('month', ts) + INTERVAL 1 MONTH AS ends FROM outcomes), cv AS (SELECT min(t) AS settled FROM (SELECT source, max(ts) AS t FROM token_events GROUP BY 1)),
k AS (SELECT mo.*, ends + INTERVAL 14 DAYS <= TIMESTAMP '1999-06-01' AND settled >= ends AS ok FROM mo, cv) SELECT period, ends FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.period <= a.period AND NOT b.ok)""")
def _(spark, sf):
    months = B.outcomes(spark, sf).select(F.date_format("ts", "yyyy-MM").alias("period"), F.add_months(F.to_date(F.date_trunc("month", "ts")), 1).cast("timestamp_ntz").alias("ends")).distinct()
    coverage = B.token_events(spark, sf).groupBy("source").agg(F.max("ts").alias("settled_through"))
    return labels.sealable(months, coverage, NOW)


@query("T12_retention", "SELECT count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS")
def _(spark, sf):
    e = B.table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("t")).first().t  # one value
    return e.where(F.col("ts") >= F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 10 DAYS")).agg(F.count("*").alias("kept"))


@query("T15_superseded", "SELECT repo, count(*) AS n FROM outcomes p WHERE source = 'push' AND NOT EXISTS (SELECT 1 FROM outcomes g WHERE g.source = 'github-webhook' AND g.repo = p.repo AND g.head_branch_hash = p.head_branch_hash) GROUP BY 1")
def _(spark, sf):
    o = B.outcomes(spark, sf)
    return o.where("source = 'push'").join(o.where("source = 'github-webhook'").select("repo", "head_branch_hash"), ["repo", "head_branch_hash"], "left_anti").groupBy("repo").agg(F.count("*").alias("n"))


@query("T16_placements", """, a AS (SELECT 'dev-' || user_id AS developer, 'team-' || (event_id % 3) AS team, ts AS moved FROM events WHERE event_type = 'signup'), m AS (SELECT *, lag(team) OVER (PARTITION BY developer ORDER BY moved) AS was FROM a)
SELECT developer, team, moved AS valid_from, lead(moved) OVER (PARTITION BY developer ORDER BY moved) AS valid_to FROM m WHERE was IS NULL OR was <> team""")
def _(spark, sf):
    e = B.table(spark, sf, "events").where("event_type = 'signup'")
    return labels.placements(e.select(F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("developer"), F.concat(F.lit("team-"), (F.col("event_id") % 3).cast("string")).alias("team"), F.col("ts").alias("at")))


@query("T17_overrides", "SELECT developer, sum(CASE WHEN id % 97 = 0 THEN 1000 ELSE cost_micro END)::BIGINT AS cost_micro, count(*) FILTER (id % 97 = 0) AS overridden FROM token_events GROUP BY 1")
def _(spark, sf):
    e = B.token_events(spark, sf)
    over = e.where("id % 97 = 0").select("id").distinct().withColumn("own", F.lit(1000).cast("long"))
    return e.join(over, "id", "left").groupBy("developer").agg(F.sum(F.coalesce("own", "cost_micro")).alias("cost_micro"), F.count("own").alias("overridden"))


@query("X3_interval_gate", f"{E_SQL} SELECT developer, 2 * sum(CASE WHEN NOT {UNATTRIBUTED} THEN cost_micro ELSE 0 END) >= sum(cost_micro) AS shown FROM e GROUP BY 1")
def _(spark, sf):
    linked = F.sum(F.when(~S.unattributed(F.col("issue_id")), F.col("cost_micro")).otherwise(0))
    return events(spark, sf).groupBy("developer").agg((2 * linked.cast("decimal(38,0)") >= F.sum("cost_micro").cast("decimal(38,0)")).alias("shown"))


@query("X9_manifest_diff", f"{E_SQL} SELECT developer, sum(cost_micro)::BIGINT AS was, sum(cost_micro + CASE WHEN id % 1009 = 0 THEN 1 ELSE 0 END)::BIGINT AS is_now FROM e GROUP BY 1 HAVING count(*) FILTER (id % 1009 = 0) > 0")
def _(spark, sf):
    e = events(spark, sf)
    a, b = (x.groupBy("developer").agg(F.sum("cost_micro").alias("cost_micro")) for x in (e, e.withColumn("cost_micro", F.col("cost_micro") + F.when(F.col("id") % 1009 == 0, 1).otherwise(0))))
    return labels.verified(a, b, ["developer"], ["cost_micro"]).select("developer", F.col("stored.cost_micro").alias("was"), F.col("again.cost_micro").alias("is_now"))


@query("X11_repair_repo", ", mp AS (SELECT session_id, min(repo) AS r, count(DISTINCT repo) AS n FROM token_events WHERE repo <> 'unqualified' GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 5 THEN 'conflict' WHEN n > 1 THEN 'ambiguous' ELSE 'repaired' END AS result, count(*) AS rows_ FROM token_events e LEFT JOIN mp USING (session_id) WHERE e.repo = 'unqualified' GROUP BY 1".replace("rows_", "n_rows"))
def _(spark, sf):
    e = B.token_events(spark, sf)
    known = e.where("repo != 'unqualified'").groupBy("session_id").agg(F.countDistinct("repo").alias("n"))
    result = F.when(F.col("n").isNull(), F.lit("unresolved")).when(F.col("n") > 5, F.lit("conflict")).when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.lit("repaired"))
    return e.where("repo = 'unqualified'").join(known, "session_id", "left").groupBy(result.alias("result")).agg(F.count("*").alias("n_rows"))


@query("X12_erasure", "SELECT developer, count(*) AS n FROM token_events WHERE developer NOT IN ('dev-1', 'dev-2') GROUP BY 1")
def _(spark, sf):
    subjects_ = spark.createDataFrame([("dev-1",), ("dev-2",)], "developer string")
    return B.token_events(spark, sf).join(F.broadcast(subjects_), "developer", "left_anti").groupBy("developer").agg(F.count("*").alias("n"))


@query("X15_saturating_sum", "SELECT issue_id, least(s, 9223372036854775807)::BIGINT AS capped, s > 9223372036854775807 AS over FROM (SELECT issue_id, sum(cost_micro::HUGEINT * 25000000000) AS s FROM token_events GROUP BY 1)")
def _(spark, sf):
    """Costs, scaled so that the sums of many issues pass a long; as costs aren't negative, a sum that fails is past its largest value."""
    total = F.try_sum(F.col("cost_micro") * F.lit(25_000_000_000))
    return B.token_events(spark, sf).groupBy("issue_id").agg(F.coalesce(total, F.lit(S.LONG)).alias("capped"), total.isNull().alias("over"))


@query("X20_alias_as_of", "SELECT s.seal, a.alias FROM (SELECT unnest(range(1, 7)) AS seal) s JOIN (VALUES ('x', 1, 3), ('y', 2, NULL), ('z', 4, 5)) a(alias, since_seal, ended_seal) ON a.since_seal < s.seal AND s.seal <= coalesce(a.ended_seal, 9223372036854775807)")
def _(spark, sf):
    a = spark.createDataFrame([("x", 1, 3), ("y", 2, None), ("z", 4, 5)], "alias string, since_seal long, ended_seal long")
    s = spark.range(1, 7).select(F.col("id").alias("seal"))
    return s.join(F.broadcast(a), (F.col("since_seal") < F.col("seal")) & (F.col("seal") <= F.coalesce("ended_seal", F.lit(S.LONG)))).select("seal", "alias")


@query("U3_except", "SELECT DISTINCT issue_id FROM token_events EXCEPT SELECT issue_id FROM outcomes WHERE id % 2 = 0")
def _(spark, sf):
    return B.token_events(spark, sf).select("issue_id").distinct().join(B.outcomes(spark, sf).where("id % 2 = 0").select("issue_id"), "issue_id", "left_anti")

"""Queries of sources and sinks, corrective work, seals and digests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions import scalars as S
from tallyspark.operators import intervals, labels, ledgers, pricing, recovery, scores
from tallyspark.plans.attribution import CLAIMS, RELATIONS, relations
from tallyspark.plans.basics import E_SQL, EO_SQL, MID, NORMAL, NOW, PRICED, SINCE, UNATTRIBUTED, UNTIL, _halves, _label_sql, events, scored, work, SCORE_SQL
from tallyspark.plans.more import AT, by_team
from tallyspark.plans.registry import query
from tallyspark.plans.windows import session_lines
from tallyspark.sources import bridge as B
from tallyspark.sources import files, sessions, usage, webhooks
from tallyspark.sources.shared import shared_dir


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("S2_message_fold", "SELECT 's' || conv_id AS session, count(DISTINCT floor(turn / 2)) AS messages, sum(m)::BIGINT AS input_tok FROM (SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id, floor(turn / 2) ORDER BY length(coalesce(text, '')) DESC) = 1 THEN length(coalesce(text, '')) ELSE 0 END AS m FROM conversations) GROUP BY 1")
def _(spark, sf):
    return sessions.folded(sessions.parsed(session_lines(spark, sf))).groupBy("session").agg(F.count("*").alias("messages"), F.sum("input_tok").alias("input_tok"))


@query("S4_rollout", """, c AS (SELECT user_id AS session, event_id AS ordinal, sum(json_extract(props, '$.k')::BIGINT + 10) OVER w AS i, sum(5) OVER w AS h, sum(event_id % 7) OVER w AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT session, count(*) AS calls, (max(i) - max(h))::BIGINT AS input_tok, max(h)::BIGINT AS cache_read, max(o)::BIGINT AS output_tok FROM c WHERE session % 9 <> 0 GROUP BY 1""")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = B.table(spark, sf, "events")
    broken = F.when((F.col("user_id") % 9 == 0) & (F.row_number().over(w) == 2), -1_000_000).otherwise(0)
    use = F.struct((F.sum(F.get_json_object("props", "$.k").cast("long") + 10).over(w) + broken).alias("input_tokens"), F.sum(F.lit(5)).over(w).alias("cached_input_tokens"), F.sum(F.col("event_id") % 7).over(w).alias("output_tokens"))
    line = F.to_json(F.struct(F.lit("token_count").alias("type"), F.struct(F.struct(use.alias("total_token_usage")).alias("info")).alias("payload")))
    calls = usage.rollouts(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("ordinal"), line.alias("value")))
    return calls.groupBy("session").agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("input_tok", "cache_read", "output_tok")))


@query("S7_subagents", "SELECT p.conv_id, count(*) AS children, sum(length(coalesce(c.text, '')))::BIGINT AS chars FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = 0 AND c.turn > 0 GROUP BY 1")
def _(spark, sf):
    c = B.table(spark, sf, "conversations")
    line = F.to_json(F.struct(F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id")).alias("stream"), F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.lit("0")).alias("parent"), F.length("text").alias("chars")).alias("payload")))
    rows = c.select(F.from_json(line, "stream STRUCT<id STRING>, payload STRUCT<parent STRING, chars BIGINT>").alias("r")).select("r.stream.id", "r.payload.parent", "r.payload.chars")
    child, parent = rows.where("id != parent"), rows.where("id = parent").select(F.col("id").alias("parent"))
    return child.join(parent, "parent").groupBy(F.split("parent", "-")[0].cast("long").alias("conv_id")).agg(F.count("*").alias("children"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))


@query("S8_responses", """, x AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT CASE event_id % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' ELSE 'gemini' END AS provider, sum(CASE event_id % 3 WHEN 0 THEN k ELSE 100 END)::BIGINT AS input_tok, sum(CASE event_id % 3 WHEN 2 THEN 12 ELSE 7 END)::BIGINT AS output_tok, sum(k)::BIGINT AS cache_read FROM x GROUP BY 1""")
def _(spark, sf):
    k, i = F.get_json_object("props", "$.k"), F.col("event_id") % 3
    body = (
        F.when(i == 0, F.concat(F.lit('{"model":"m","usage":{"input_tokens":'), k, F.lit(',"output_tokens":7,"cache_read_input_tokens":'), k, F.lit("}}")))
        .when(i == 1, F.concat(F.lit('{"model":"m","usage":{"prompt_tokens":'), (k.cast("long") + 100).cast("string"), F.lit(',"completion_tokens":7,"prompt_tokens_details":{"cached_tokens":'), k, F.lit("}}}")))
        .otherwise(F.concat(F.lit('{"usageMetadata":{"promptTokenCount":'), (k.cast("long") + 100).cast("string"), F.lit(',"candidatesTokenCount":7,"thoughtsTokenCount":5,"cachedContentTokenCount":'), k, F.lit("}}")))
    )
    provider = F.when(i == 0, F.lit("anthropic")).when(i == 1, F.lit("openai")).otherwise(F.lit("gemini"))
    r = usage.responses(B.table(spark, sf, "events").select(provider.alias("provider"), body.alias("body")))
    return r.groupBy("provider").agg(*(F.sum(c).alias(c) for c in ("input_tok", "output_tok", "cache_read")))


@query("S9_event_streams", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS input_tok, 3 AS cache_read, event_id % 50 + 10 AS output_tok, 3 AS frames FROM events")
def _(spark, sf):
    k, o = F.get_json_object("props", "$.k"), (F.col("event_id") % 50 + 10).cast("string")
    body = F.concat(F.lit('event: message_start\ndata: {"type":"message_start","message":{"usage":{"input_tokens":'), k, F.lit(',"output_tokens":1,"cache_read_input_tokens":3}}}\n\nevent: message_delta\ndata: {"type":"message_delta","usage":{"output_tokens":'), o, F.lit('}}\n\n: keep-alive\n\nevent: message_stop\ndata: {"type":"message_stop"}\n\n'))
    return usage.streams(B.table(spark, sf, "events").select("event_id", body.alias("body")), "event_id")


@query("S10_daily_buckets", f"SELECT ts::DATE AS day, {NORMAL} AS model, sum(input_tok)::BIGINT AS input_tok, sum(output_tok)::BIGINT AS output_tok, sum(cache_read)::BIGINT AS cache_read FROM token_events WHERE source = 'anthropic-admin' AND ts::DATE + INTERVAL 2 DAYS <= TIMESTAMP '{NOW}' GROUP BY 1, 2")
def _(spark, sf):
    e = B.token_events(spark, sf).where("source = 'anthropic-admin'")
    result = F.struct(S.normal_model(F.col("model")).alias("model"), F.col("input_tok").alias("uncached_input_tokens"), F.col("output_tok").alias("output_tokens"), F.col("cache_read").alias("cache_read_input_tokens"))
    page = F.to_json(F.struct(F.array(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("starting_at"), F.array(result).alias("results"))).alias("data")))
    return usage.daily_buckets(e.select(page.alias("value")), NOW)


@query("S11_billing_delta", """, t AS (SELECT l_suppkey % 5 AS product, l_shipdate::DATE AS day, sum(round_even(l_discount * 1e6, 0)::BIGINT)::BIGINT AS total FROM lineitem GROUP BY 1, 2), p AS (SELECT l_suppkey % 5 AS product, l_shipdate::DATE AS day, sum(round_even(l_discount * 1e6, 0)::BIGINT)::BIGINT AS posted FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2)
SELECT product, day, total - coalesce(posted, 0) AS delta FROM t LEFT JOIN p USING (product, day) WHERE total <> coalesce(posted, 0)""")
def _(spark, sf):
    lines = B.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("product"), F.to_date("l_shipdate").alias("day"), "l_discount", "l_linenumber")
    now, before = (usage.billing_totals(x, ["product", "day"], "l_discount") for x in (lines, lines.where("l_linenumber < 4")))
    return ledgers.delta_to_post(now, before.withColumnRenamed("total", "amount"), ["product", "day"])


@query("S12_priced_days", f"{PRICED} SELECT developer, ts::DATE AS day, sum(priced_micro)::BIGINT AS priced_micro, count(*) AS n FROM priced WHERE source = 'proxy' GROUP BY 1, 2")
def _(spark, sf):
    p = pricing.priced(B.token_events(spark, sf).where("source = 'proxy'"), pricing.price_table(spark))
    return p.groupBy("developer", F.to_date("ts").alias("day")).agg(F.sum("priced_micro").alias("priced_micro"), F.count("*").alias("n"))


@query("S13_commits", "SELECT 'b' || (user_id % 20) AS branch, count(*) AS commits, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT 'all', count(*), min(ts), max(ts) FROM events WHERE event_type = 'purchase'")
def _(spark, sf):
    c = B.table(spark, sf, "events").where("event_type = 'purchase'").select(F.array(F.concat(F.lit("b"), (F.col("user_id") % 20).cast("string")), F.lit("all")).alias("branches"), "ts")
    return c.select(F.explode("branches").alias("branch"), "ts").groupBy("branch").agg(F.count("*").alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def deliveries(spark, sf):
    """Pull-request payloads, one per order and some of them delivered twice."""
    o, k = B.table(spark, sf, "orders"), F.col("o_orderkey")
    label = F.when(k % 4 == 0, F.array(F.struct(F.lit("size/L").alias("name")), F.struct(F.lit("type:bug").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    pull = F.struct(k.cast("int").alias("number"), F.lit("t").alias("title"), F.when(k % 5 == 0, F.concat(F.lit("Closes #"), k.cast("string"))).alias("body"), (k % 7 != 0).alias("merged"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("merged_at"), F.sha2(k.cast("string"), 256).alias("merge_commit_sha"),
                    F.struct(F.when(k % 3 == 0, F.concat(F.lit("feat/"), k.cast("string"), F.lit("-x"))).otherwise(F.lit("topic")).alias("ref")).alias("head"), F.struct(F.concat(F.lit("dev-"), (F.col("o_custkey") % 50).cast("string")).alias("login"), F.lit("User").alias("type")).alias("user"), label.alias("labels"), (k % 300).cast("int").alias("additions"), F.lit(5).alias("deletions"), (k % 4).cast("int").alias("changed_files"))
    body = F.to_json(F.struct(F.lit("closed").alias("action"), pull.alias("pull_request"), F.struct(F.lit("Acme/Repo").alias("full_name")).alias("repository")))
    return o.select(k.alias("delivery_id"), body.alias("body"), F.explode(F.when(k % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("again")).drop("again")


PULLS = """, pr AS (SELECT o_orderkey AS k, o_custkey % 50 AS d, CASE WHEN o_orderkey % 3 = 0 AND length(o_orderkey::VARCHAR) = 4 AND o_orderkey BETWEEN 1900 AND 2099 THEN NULL WHEN o_orderkey % 3 = 0 AND o_orderkey > 0 THEN 'issue-' || o_orderkey END AS branch_issue, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey > 0 THEN 'issue-' || o_orderkey END AS body_issue, o_orderkey % 300 + 5 + 10 * (o_orderkey % 4) AS effort FROM orders WHERE o_orderkey % 7 <> 0)"""


@query("S14_pull_requests", f"{PULLS} SELECT 'acme/repo' AS repo, k AS pr_number, 'dev-' || d AS developer, coalesce(branch_issue, body_issue) AS issue_id, CASE WHEN k % 4 = 0 THEN 5.0::DOUBLE WHEN effort <= 15 THEN 0.5 WHEN effort <= 60 THEN 1 WHEN effort <= 200 THEN 3 WHEN effort <= 1000 THEN 5 ELSE 8 END AS weight, CASE WHEN k % 4 = 0 THEN 'label' ELSE 'heuristic' END AS weight_source, CASE WHEN k % 4 = 0 THEN 'bug' ELSE 'feature' END AS work_type FROM pr")
def _(spark, sf):
    return webhooks.pull_outcomes(deliveries(spark, sf)).select("repo", F.col("pr_number").cast("long").alias("pr_number"), "developer", "issue_id", "weight", "weight_source", "work_type")


@query("S15_backfill", f"{PULLS} SELECT work_type, count(*) AS n FROM (SELECT CASE WHEN k % 4 = 0 THEN 'bug' ELSE 'feature' END AS work_type FROM pr) GROUP BY 1")
def _(spark, sf):
    return webhooks.pull_outcomes(deliveries(spark, sf)).groupBy("work_type").agg(F.count("*").alias("n"))


@query("S16_ingest_rows", "SELECT event_type, CASE WHEN value < 0 THEN 'range' WHEN user_id % 25 = 0 THEN 'developer' END AS reason, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    line = F.to_json(F.struct("event_type", "value", F.when(F.col("user_id") % 25 != 0, F.col("user_id")).alias("developer")))
    r = B.table(spark, sf, "events").select(F.from_json(line, "event_type STRING, value DOUBLE, developer BIGINT").alias("r")).select("r.*")
    return r.groupBy("event_type", F.when(F.col("value") < 0, F.lit("range")).when(F.col("developer").isNull(), F.lit("developer")).alias("reason")).agg(F.count("*").alias("n"))


@query("S17_hierarchy", "SELECT DISTINCT 'dev-' || (c_custkey % 50) AS developer, 'team-' || (c_custkey % 50 % 7) AS team, 'div-' || (c_custkey % 50 % 7 % 3) AS division, 'org' AS org FROM customer")
def _(spark, sf):
    path, d = place(spark, "hierarchy"), F.col("c_custkey") % 50
    rows = B.table(spark, sf, "customer").select(F.concat(F.lit("dev-"), d.cast("string")).alias("developer"), F.concat(F.lit("team-"), (d % 7).cast("string")).alias("team"), F.concat(F.lit("div-"), (d % 7 % 3).cast("string")).alias("division"), F.lit("org").alias("org")).distinct()
    rows.write.option("header", True).csv(path)
    return files.read_hierarchy(spark, path)


@query("S18_prices", "SELECT key, input_per_m FROM (VALUES ('a', 1.5::DOUBLE), ('b', 2.0)) t(key, input_per_m)")
def _(spark, sf):
    path = place(spark, "prices")
    spark.createDataFrame([('{"version": 1, "models": {"a": {"provider": "x", "input_per_m": 1.5, "output_per_m": 3.0}, "b": {"provider": "y", "input_per_m": 2.0, "output_per_m": 4.0}}}',)], "value string").write.text(path)
    return files.read_prices(spark, path).select("key", "input_per_m")


@query("K1_event_sink", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, sum(cost_micro)::BIGINT AS cost_micro FROM token_events GROUP BY 1")
def _(spark, sf):
    path = place(spark, "events")
    files.write_events(B.token_events(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.sum("cost_micro").alias("cost_micro"))


@query("K2_export", "SELECT developer, CASE WHEN regexp_matches(note, '^[=+@-]') THEN '''' || note ELSE note END AS note FROM (SELECT 'dev-' || (o_custkey % 50) AS developer, CASE o_orderkey % 3 WHEN 0 THEN '=sum(a)' WHEN 1 THEN 'plain' ELSE '-1' END AS note FROM orders)")
def _(spark, sf):
    path = place(spark, "export")
    note = F.get(F.array(F.lit("=sum(a)"), F.lit("plain"), F.lit("-1")), (F.col("o_orderkey") % 3).cast("int"))
    files.export_csv(B.table(spark, sf, "orders").select(F.concat(F.lit("dev-"), (F.col("o_custkey") % 50).cast("string")).alias("developer"), note.alias("note")), path)
    return spark.read.schema("developer string, note string").option("header", True).csv(path)


@query("P4_call_cost", f"{PRICED} SELECT id, ts, max(priced_micro) AS dearest, count(*) AS n FROM priced GROUP BY 1, 2")
def _(spark, sf):
    return pricing.priced(B.token_events(spark, sf), pricing.price_table(spark)).groupBy("id", "ts").agg(F.max("priced_micro").alias("dearest"), F.count("*").alias("n"))


@query("P26_additive_tokens", """, u AS (SELECT l_partkey AS i, l_suppkey AS o, l_linenumber AS r, l_partkey + l_suppkey + l_linenumber + CASE WHEN l_orderkey % 8 = 0 THEN 3 ELSE 0 END AS t FROM lineitem) SELECT i + o + r = t AND t <= 536870912 AS valid, count(*) AS n, sum(o + r)::BIGINT AS output_tok FROM u GROUP BY 1""")
def _(spark, sf):
    n = F.col("l_linenumber").cast("long")
    u = B.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("o"), n.alias("r"), (F.col("l_partkey") + F.col("l_suppkey") + n + F.when(F.col("l_orderkey") % 8 == 0, 3).otherwise(0)).alias("t"))
    valid = (F.col("i") + F.col("o") + F.col("r") == F.col("t")) & (F.col("t") <= 1 << 29)
    return u.groupBy(valid.alias("valid")).agg(F.count("*").alias("n"), F.sum(F.col("o") + F.col("r")).alias("output_tok"))


@query("P27_two_forms", "SELECT l_returnflag AS kind, sum(CASE WHEN l_returnflag = 'A' THEN l_partkey - least(l_suppkey, l_partkey) ELSE l_partkey END)::BIGINT AS input_tok, sum(CASE WHEN l_returnflag = 'A' THEN least(l_suppkey, l_partkey) ELSE l_suppkey END)::BIGINT AS cache_read FROM lineitem GROUP BY 1")
def _(spark, sf):
    agent, cached = F.col("l_returnflag") == "A", F.least("l_suppkey", "l_partkey")
    return B.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.sum(F.when(agent, F.col("l_partkey") - cached).otherwise(F.col("l_partkey"))).alias("input_tok"), F.sum(F.when(agent, cached).otherwise(F.col("l_suppkey"))).alias("cache_read"))


@query("P31_window_dates", "SELECT raw, starts FROM (VALUES ('2024', TIMESTAMP '2024-01-01'), ('2024-05', TIMESTAMP '2024-05-01'), ('2024-05-09', TIMESTAMP '2024-05-09'), ('soon', NULL)) t(raw, starts)")
def _(spark, sf):
    return spark.createDataFrame([("2024",), ("2024-05",), ("2024-05-09",), ("soon",)], "raw string").select("raw", S.window_date(F.col("raw")).alias("starts"))


@query("P39_repo_scope", "SELECT cwd, scope FROM (VALUES ('/w/a', 'inside'), ('/w/a/src', 'inside'), ('/w/ab', 'outside'), ('/w/a/sub/x', 'nested'), ('/', 'outside')) t(cwd, scope)")
def _(spark, sf):
    d = spark.createDataFrame([("/w/a",), ("/w/a/src",), ("/w/ab",), ("/w/a/sub/x",), ("/",)], "cwd string")
    return d.select("cwd", S.repo_scope(F.col("cwd"), "/w/a", ["/w/a/sub"]).alias("scope"))


@query("P41_reported_null", f"{SCORE_SQL} SELECT developer, CASE WHEN points20 > 0 THEN cost_micro / 1e6 / (points20 / 20.0::DOUBLE) END AS cost_per_point FROM s")
def _(spark, sf):
    return scored(spark, sf).select("developer", "cost_per_point")


@query("F10_positive_cost", "SELECT repo, sum(cost_micro)::BIGINT AS cost_micro FROM token_events GROUP BY 1 HAVING sum(cost_micro) > 0")
def _(spark, sf):
    return B.token_events(spark, sf).groupBy("repo").agg(F.sum("cost_micro").alias("cost_micro")).where("cost_micro > 0")


@query("J6_by_number", f"{CLAIMS} SELECT claim, count(*) AS n FROM u JOIN bw ON u.branch_hash IS NULL AND u.pr_number = bw.pr_number AND u.repo = bw.repo AND u.ts BETWEEN window_start AND merged_at JOIN (SELECT id AS i, issue_id AS claim FROM outcomes) ON i = bw.id GROUP BY 1")
def _(spark, sf):
    return recovery.claims(B.token_events(spark, sf).where("branch_hash is null"), B.outcomes(spark, sf)).groupBy("claim").agg(F.count("*").alias("n"))


@query("J7_unique_claims", f"{CLAIMS}, g AS (SELECT id, ts, cost_micro, count(DISTINCT claim) AS claims FROM cl GROUP BY 1, 2, 3) SELECT claims, count(*) AS n FROM g GROUP BY 1")
def _(spark, sf):
    return recovery.claims(B.token_events(spark, sf), B.outcomes(spark, sf)).groupBy("id", "ts", "cost_micro").agg(F.countDistinct("claim").alias("claims")).groupBy("claims").agg(F.count("*").alias("n"))


def _teams(spark, sf, since, until):
    e, o = (scores.in_window(x, since, until) for x in (B.token_events(spark, sf), B.outcomes(spark, sf)))
    m = B.memberships(spark, sf)
    return scores.k_anonymous(scores.label_scores(e, o, m, "team"), scores.labelled(o, m, "team").select("label", "developer"))


def _team_sql(name: str, since: str, until: str) -> str:
    at = "JOIN memberships m ON x.developer = m.developer AND x.ts >= m.valid_from AND (m.valid_to IS NULL OR x.ts < m.valid_to)"
    inside = f"ts >= TIMESTAMP '{since}' AND ts < TIMESTAMP '{until}'"
    return f"""{name} AS (WITH c AS (SELECT coalesce(team, '') AS label, sum(cost_micro)::BIGINT AS cost_micro FROM token_events x LEFT {at} WHERE {inside} GROUP BY 1), w AS (SELECT coalesce(team, '') AS label, sum(points20)::BIGINT AS points20, count(DISTINCT x.developer) AS people FROM outcomes x LEFT {at} WHERE {inside} GROUP BY 1)
  SELECT label, cost_micro, points20 FROM c JOIN w USING (label) WHERE label <> '' AND people >= 3)"""


@query("A27_compare_named", f", {_team_sql('a', SINCE, MID)}, {_team_sql('b', MID, UNTIL)} SELECT label, a.cost_micro AS before_micro, b.cost_micro AS after_micro, b.points20 - a.points20 AS change20 FROM a JOIN b USING (label)")
def _(spark, sf):
    a, b = (_teams(spark, sf, *w).where("label != 'other'") for w in ((SINCE, MID), (MID, UNTIL)))
    return a.alias("a").join(b.alias("b"), "label").select("label", F.col("a.cost_micro").alias("before_micro"), F.col("b.cost_micro").alias("after_micro"), (F.col("b.points20") - F.col("a.points20")).alias("change20"))


@query("A36_repair_spend", f""", r AS ({RELATIONS}), k AS (SELECT o.developer, o.repo, o.pr_number, o.issue_id FROM r JOIN outcomes o ON o.id = r.child WHERE state NOT IN ('removed', 'unrelated', 'withdrawn'))
SELECT count(*) AS n, sum(cost_micro)::BIGINT AS cost_micro FROM token_events e WHERE EXISTS (SELECT 1 FROM k WHERE k.developer = e.developer AND k.repo = e.repo AND k.pr_number = e.pr_number)
OR e.pr_number IS NULL AND EXISTS (SELECT 1 FROM k WHERE k.developer = e.developer AND k.repo = e.repo AND k.issue_id <> '' AND k.issue_id = e.issue_id)""")
def _(spark, sf):
    kids = relations(spark, sf).where("state not in ('removed', 'unrelated', 'withdrawn')").select(F.col("child").alias("id")).distinct().join(B.outcomes(spark, sf), "id")
    return ledgers.repair_spend(B.token_events(spark, sf), kids).agg(F.count("*").alias("n"), F.sum("cost_micro").alias("cost_micro"))


@query("A42_correction_states", f", r AS ({RELATIONS}) SELECT state, o.id IS NOT NULL AS parent_known, count(*) AS n FROM r LEFT JOIN outcomes o ON o.id = r.parent GROUP BY 1, 2")
def _(spark, sf):
    known = B.outcomes(spark, sf).select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return relations(spark, sf).join(known, "parent", "left").groupBy("state", F.col("known").isNotNull().alias("parent_known")).agg(F.count("*").alias("n"))


@query("A50_correction_counts", f", r AS ({RELATIONS}) SELECT count(*) AS relations, count(DISTINCT child) AS children, count(DISTINCT parent) AS parents FROM r WHERE state <> 'withdrawn'")
def _(spark, sf):
    return relations(spark, sf).where("state != 'withdrawn'").agg(F.count("*").alias("relations"), F.countDistinct("child").alias("children"), F.countDistinct("parent").alias("parents"))


@query("A45_coverage", f"{SCORE_SQL} SELECT developer, CASE WHEN cost_micro > 0 THEN realtime_micro / cost_micro::DOUBLE * 100 ELSE 0 END AS coverage_pct FROM s")
def _(spark, sf):
    return scored(spark, sf).select("developer", "coverage_pct")


@query("W2_window_starts", "SELECT count(*) AS n, min(created_at - INTERVAL 7 DAYS) AS earliest FROM outcomes")
def _(spark, sf):
    return recovery.branch_windows(B.outcomes(spark, sf)).agg(F.count("*").alias("n"), F.min("window_start").alias("earliest"))


@query("W4_latest", "SELECT developer, max_by(id, (ts, id)) AS id FROM outcomes GROUP BY 1")
def _(spark, sf):
    return ledgers.first_writer(B.outcomes(spark, sf), ["developer"], [F.desc("ts"), F.desc("id")]).select("developer", "id")


@query("W5_session_model", "SELECT session_id, arg_min(model, (ts, id, model)) AS model FROM token_events GROUP BY 1")
def _(spark, sf):
    return B.token_events(spark, sf).groupBy("session_id").agg(F.min_by("model", F.struct("ts", "id", "model")).alias("model"))


@query("O2_cost_order", f"{E_SQL}, c AS (SELECT {NORMAL} AS model, sum(cost_micro)::BIGINT AS cost_micro FROM e GROUP BY 1) SELECT row_number() OVER (ORDER BY cost_micro DESC, model) AS place, model, cost_micro FROM c")
def _(spark, sf):
    c = scores.composition(events(spark, sf), S.normal_model(F.col("model")))
    return c.select(F.row_number().over(Window.orderBy(F.desc("cost_micro"), "model")).cast("long").alias("place"), "model", "cost_micro")


@query("O4_top_gaps", f"{EO_SQL}, g AS (SELECT issue_id, sum(cost_micro)::BIGINT AS cost_micro FROM e WHERE NOT {UNATTRIBUTED} AND issue_id NOT IN (SELECT issue_id FROM o WHERE weight = 8) GROUP BY 1) SELECT issue_id, cost_micro, (SELECT count(*) FROM g) AS all_gaps FROM g ORDER BY cost_micro DESC, issue_id LIMIT 50")
def _(spark, sf):
    big = work(spark, sf).where("weight = 8").select("issue_id").distinct()
    gaps = events(spark, sf).where(~S.unattributed(F.col("issue_id"))).join(big, "issue_id", "left_anti").groupBy("issue_id").agg(F.sum("cost_micro").alias("cost_micro"))
    return gaps.withColumn("all_gaps", gaps.agg(F.count("*")).scalar()).orderBy(F.desc("cost_micro"), "issue_id").limit(50)


@query("O5_digest_order", "SELECT id, ts, ts::DATE AS day, row_number() OVER (ORDER BY ts, id) AS place FROM outcomes")
def _(spark, sf):
    return ledgers.places(B.outcomes(spark, sf).select("id", "ts"), "ts", "id")


@query("U1_union_all", "SELECT developer, count(*) AS n FROM (SELECT developer FROM token_events UNION ALL SELECT developer FROM outcomes) GROUP BY 1")
def _(spark, sf):
    return B.token_events(spark, sf).select("developer").unionByName(B.outcomes(spark, sf).select("developer")).groupBy("developer").agg(F.count("*").alias("n"))


@query("U2_union", f", r AS ({RELATIONS}) SELECT child AS id FROM r UNION SELECT parent FROM r")
def _(spark, sf):
    r = relations(spark, sf)
    return r.select(F.col("child").alias("id")).union(r.select("parent")).distinct()


@query("U4_people", f"{EO_SQL} SELECT count(*) AS people FROM (SELECT developer FROM e UNION SELECT developer FROM o)")
def _(spark, sf):
    sets = [df.agg(F.collect_set("developer").alias("s")) for df in (events(spark, sf).select("developer").distinct(), work(spark, sf).select("developer").distinct())]
    return sets[0].unionByName(sets[1]).agg(F.size(F.array_distinct(F.flatten(F.collect_list("s")))).cast("long").alias("people"))


@query("T9_membership_cuts", f"{_label_sql('team')} SELECT label, cost_micro, points20 FROM s")
def _(spark, sf):
    return scores.label_scores(events(spark, sf), work(spark, sf), B.memberships(spark, sf), "team").select("label", "cost_micro", "points20")


@query("T11_seal_gaps", """, m AS (SELECT DISTINCT strftime(ts, '%Y-%m') AS period FROM outcomes WHERE month(ts) <> 7), a AS (SELECT strftime(x, '%Y-%m') AS period FROM (SELECT unnest(generate_series((SELECT min(date_trunc('month', ts)) FROM outcomes)::TIMESTAMP, (SELECT max(date_trunc('month', ts)) FROM outcomes)::TIMESTAMP, INTERVAL 1 MONTH)) AS x)) SELECT period FROM a WHERE period NOT IN (SELECT period FROM m)""")
def _(spark, sf):
    o = B.outcomes(spark, sf)
    have = o.where(F.month("ts") != 7).select(F.date_format("ts", "yyyy-MM").alias("period")).distinct()
    span = o.agg(F.to_date(F.date_trunc("month", F.min("ts"))).alias("a"), F.to_date(F.date_trunc("month", F.max("ts"))).alias("b"))
    months = span.select(F.explode(F.expr("sequence(a, b, INTERVAL 1 MONTH)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("period"))
    return months.join(have, "period", "left_anti")


@query("G4_effective_points", f", r AS ({RELATIONS}), p AS (SELECT child AS id, min(parent % 40) AS stored20 FROM r WHERE state = 'confirmed' GROUP BY 1) SELECT developer, sum(coalesce(stored20, points20))::BIGINT AS points20 FROM outcomes LEFT JOIN p USING (id) GROUP BY 1")
def _(spark, sf):
    p = relations(spark, sf).where("state = 'confirmed'").groupBy(F.col("child").alias("id")).agg(F.min(F.col("parent") % 40).alias("stored20"))
    return B.outcomes(spark, sf).join(p, "id", "left").groupBy("developer").agg(F.sum(F.coalesce("stored20", "points20")).alias("points20"))


@query("G5_lifecycle", """, a AS (SELECT o_custkey AS relation, o_orderdate AS at_, o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'dispute' ELSE 'withdraw' END AS act FROM orders)
SELECT relation, CASE max_by(act, (at_, ord)) WHEN 'confirm' THEN 'confirmed' WHEN 'dispute' THEN 'disputed' ELSE 'withdrawn' END AS state, count(*) AS steps FROM a GROUP BY 1""")
def _(spark, sf):
    k = F.col("o_orderkey")
    act = F.get(F.array(*map(F.lit, ("confirmed", "disputed", "withdrawn"))), (k % 3).cast("int"))
    return B.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("relation")).agg(F.max_by(act, F.struct("o_orderdate", "o_orderkey")).alias("state"), F.count("*").alias("steps"))


@query("X2_interval_inputs", f"""{EO_SQL}, r AS ({RELATIONS}), ox AS (SELECT *, id NOT IN (SELECT child FROM r WHERE state = 'confirmed') AS eligible FROM o), n AS (SELECT developer, issue_id, repo, count(*) AS k, count(*) FILTER (eligible) AS ok, sum(points20)::BIGINT AS points20, coalesce(sum(points20) FILTER (NOT eligible), 0)::BIGINT AS repair20 FROM ox GROUP BY 1, 2, 3),
i AS (SELECT developer, issue_id, repo, sum(cost_micro)::BIGINT AS c FROM e GROUP BY 1, 2, 3), j AS (SELECT n.developer, n.issue_id, n.repo, any_value(k) AS k, any_value(ok) AS ok, any_value(points20) AS points20, any_value(repair20) AS repair20, coalesce(sum(c), 0)::BIGINT AS cost FROM n LEFT JOIN i ON i.developer = n.developer AND i.issue_id = n.issue_id AND (i.repo = n.repo OR i.repo = 'unqualified' OR n.repo = 'unqualified') GROUP BY 1, 2, 3),
t AS (SELECT developer, sum(c)::BIGINT AS total FROM i GROUP BY 1), d AS (SELECT developer, sum(cost)::BIGINT AS linked, sum(cost * ok / k::DOUBLE) AS drawn, sum(repair20)::BIGINT AS fixed20, coalesce(any_value(total), 0) AS total FROM j LEFT JOIN t USING (developer) GROUP BY 1), s AS (SELECT *, CASE WHEN linked > total THEN total / linked::DOUBLE ELSE 1 END AS scale FROM d)
SELECT developer, issue_id, repo, k, ok, points20, cost / k::DOUBLE * scale AS each_micro, round(greatest(total - linked, 0) + (linked - drawn) * scale, 2) AS fixed_micro, fixed20, total > 0 AND 2 * drawn >= greatest(total, linked) AS shown FROM j JOIN s USING (developer)""")
def _(spark, sf):
    """Confirmed follow-ups are repair, which isn't drawn."""
    repairs = relations(spark, sf).where("state = 'confirmed'").select(F.col("child").alias("id"), F.lit(False).alias("eligible"))
    o = work(spark, sf).join(repairs, "id", "left").withColumn("eligible", F.coalesce("eligible", F.lit(True)))
    return intervals.issue_shares(o, events(spark, sf)).withColumn("fixed_micro", F.round("fixed_micro", 2))


@query("X4_reciprocal", "SELECT o_orderkey AS id, CASE WHEN lo > 0 AND hi > 0 THEN 1000 / hi ELSE 0 END AS cpp_lo, CASE WHEN lo > 0 AND hi > 0 THEN 1000 / lo ELSE 0 END AS cpp_hi FROM (SELECT o_orderkey, (o_orderkey % 5)::DOUBLE AS lo, o_orderkey % 5 + 2.5::DOUBLE AS hi FROM orders)")
def _(spark, sf):
    lo, hi = (F.col("o_orderkey") % 5).cast("double"), F.col("o_orderkey") % 5 + 2.5
    ok = (lo > 0) & (hi > 0)
    return B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(ok, 1000 / hi).otherwise(0.0).alias("cpp_lo"), F.when(ok, 1000 / lo).otherwise(0.0).alias("cpp_hi"))


@query("X5_significant")
def _(spark, sf):
    e, o = B.token_events(spark, sf), B.outcomes(spark, sf)
    halves = []
    for (since, until), score in zip(((SINCE, MID), (MID, UNTIL)), _halves(spark, sf)):
        rows, fixed = intervals.interval_rows(scores.in_window(o, since, until), scores.in_window(e, since, until))
        bounds = intervals.intervals(rows, fixed).join(fixed.select("developer", "shown"), "developer")
        halves.append(score.select("developer", "ranked").join(bounds, "developer"))
    return intervals.significant(*halves)


def _framed(*columns: str) -> str:
    return "sha256(" + " || ".join(f"unhex(lpad(hex(octet_length(encode({c}::VARCHAR))), 16, '0')) || encode({c}::VARCHAR)" for c in columns) + ")"


def _parts(h: str) -> str:
    return ", ".join(f"sum(('0x' || {h}[{1 + 12 * k}:{12 * k + 12}])::BIGINT)::VARCHAR AS h{k}" for k in range(4))


@query("X7_relation_digests", f", r AS ({RELATIONS}), h AS (SELECT state, {_framed('child', 'parent', 'state')} AS h FROM r) SELECT state, count(*) AS n, {_parts('h')} FROM h GROUP BY 1")
def _(spark, sf):
    return ledgers.digests(relations(spark, sf), ["state"], ["child", "parent", "state"])


@query("X8_price_hash", "SELECT sha256('a=1;b=2') AS hash")
def _(spark, sf):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "key string, rate int")
    line = F.transform(F.array_sort(F.collect_list(F.struct("key", "rate"))), lambda x: F.concat_ws("=", x["key"], x["rate"].cast("string")))
    return rows.agg(F.sha2(F.array_join(line, ";"), 256).alias("hash"))


SECRET = bytes(range(32))
OUTER, INNER = (bytes(b ^ x for b in SECRET.ljust(64, b"\0")).hex() for x in (0x5C, 0x36))


@query("X13_sealed_keys", f"SELECT sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode('month' || chr(0) || strftime(date_trunc('month', ts), '%Y-%m-%dT%H:%M:%SZ') || chr(0) || developer)))) AS key, count(*) AS n FROM token_events GROUP BY 1")
def _(spark, sf):
    e = B.token_events(spark, sf).groupBy(F.date_trunc("month", "ts").alias("month"), "developer").agg(F.count("*").alias("n"))
    return e.groupBy(S.person_key(SECRET, "month", F.col("month"), F.col("developer")).alias("key")).agg(F.sum("n").alias("n"))


@query("X14_refold_check", f"{E_SQL}, b AS (SELECT label, sum(cost_micro)::BIGINT + 1 AS was FROM (SELECT coalesce(team, '') AS label, cost_micro FROM e x LEFT {AT}) GROUP BY 1) SELECT label, was FROM b WHERE label = (SELECT min(label) FROM b)")
def _(spark, sf):
    """The stored fold of the first label is changed by one; it alone must not stand the check."""
    rows = by_team(spark, sf)
    years = [labels.prefolded(rows.where(F.year("ts") == y)) for y in (1997, 1998, 1999)]
    again = labels.refolded(years[0].unionByName(years[1]).unionByName(years[2]))
    body = rows.groupBy("label").agg(F.sum("cost_micro").alias("cost_micro"), F.countDistinct("developer").cast("int").alias("people"))
    changed = body.join(body.agg(F.min("label").alias("first"))).withColumn("cost_micro", F.col("cost_micro") + (F.col("label") == F.col("first")).cast("long"))
    return labels.verified(changed, again, ["label"], ["cost_micro", "people"]).select("label", F.col("stored.cost_micro").alias("was"))


@query("X16_policy_rubric", "SELECT work_type, sum(CASE WHEN merged_at >= TIMESTAMP '1999-01-01' THEN points20 ELSE (weight * 20)::BIGINT END)::BIGINT AS points20 FROM outcomes GROUP BY 1")
def _(spark, sf):
    points = F.when(F.col("merged_at") >= F.lit("1999-01-01").cast("timestamp_ntz"), F.col("points20")).otherwise((F.col("weight") * 20).cast("long"))
    return B.outcomes(spark, sf).groupBy("work_type").agg(F.sum(points).alias("points20"))


@query("X17_price_registry", "SELECT price_version AS version, count(DISTINCT model) AS identities, count(DISTINCT model) > 1 AS collision FROM token_events GROUP BY 1")
def _(spark, sf):
    return B.token_events(spark, sf).groupBy(F.col("price_version").alias("version")).agg(F.countDistinct("model").alias("identities"), (F.countDistinct("model") > 1).alias("collision"))


@query("X18_original_basis", "SELECT price_version, count(*) AS n FROM token_events WHERE source IN ('jsonl', 'proxy') AND id NOT IN (SELECT id FROM token_events WHERE source = 'anthropic-admin') AND price_version IN (1, 2) GROUP BY 1")
def _(spark, sf):
    e = B.token_events(spark, sf)
    polled = e.where("source = 'anthropic-admin'").select("id")
    return e.where("source in ('jsonl', 'proxy') and price_version in (1, 2)").join(polled, "id", "left_anti").groupBy("price_version").agg(F.count("*").alias("n"))


@query("X19_reviewed_plan", "SELECT CASE WHEN author_type = 'Bot' THEN 'exclude' WHEN source = 'push' THEN 'unknown' ELSE 'keep' END AS verdict, count(*) AS n FROM outcomes GROUP BY 1")
def _(spark, sf):
    verdict = F.when(F.col("author_type") == "Bot", F.lit("exclude")).when(F.col("source") == "push", F.lit("unknown")).otherwise(F.lit("keep"))
    return B.outcomes(spark, sf).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("X21_seal_disclosure", "SELECT period, days, CASE WHEN days < 14 THEN 'early' ELSE 'graced' END AS grace FROM (SELECT DISTINCT strftime(ts, '%Y-%m') AS period, date_diff('day', (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE, DATE '1999-06-01') AS days FROM outcomes) WHERE days >= 0")
def _(spark, sf):
    ends = F.add_months(F.to_date(F.date_trunc("month", "ts")), 1)
    d = B.outcomes(spark, sf).select(F.date_format("ts", "yyyy-MM").alias("period"), F.datediff(F.lit(NOW).cast("date"), ends).cast("long").alias("days")).distinct().where("days >= 0")
    return d.withColumn("grace", F.when(F.col("days") < 14, F.lit("early")).otherwise(F.lit("graced")))


@query("X22_legacy_digests", f"SELECT ts::DATE AS day, count(*) AS n, {_parts('h')} FROM (SELECT ts, {_framed('id', 'developer')} AS h FROM outcomes) GROUP BY 1")
def _(spark, sf):
    return ledgers.day_digests(B.outcomes(spark, sf), ["id", "developer"])


@query("S19_payloads", "SELECT o_orderkey AS id, 'body ' || o_orderkey AS body FROM orders")
def _(spark, sf):
    import gzip

    def pack(frames):
        for f in frames:
            yield f.assign(gz=[gzip.compress(x.encode()) for x in f["body"]])[["id", "gz"]]

    stored = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("body "), F.col("o_orderkey").cast("string")).alias("body")).mapInPandas(pack, "id long, gz binary")
    return stored.select("id", webhooks.gunzipped("gz").cast("string").alias("body"))



#: The chains' shape in SQL: the charged parent is the only link's, problems pass down from the top, and a chain's depth is counted.
CHAINS = f"""WITH RECURSIVE r AS ({RELATIONS}), k AS (SELECT child, parent, state FROM r WHERE parent > 0 AND state <> 'withdrawn'),
n AS (SELECT o.o_orderkey AS id, o.o_orderdate AS merged, k.parent, k.state, p.o_orderkey AS known, p.o_orderdate AS p_at FROM orders o LEFT JOIN k ON k.child = o.o_orderkey LEFT JOIN orders p ON p.o_orderkey = k.parent),
d AS (SELECT *, CASE WHEN parent IS NULL THEN NULL WHEN known IS NULL THEN 'missing-or-excluded-parent' WHEN p_at > merged THEN 'parent-after-child' END AS own FROM n),
t AS (SELECT id, own AS problem, 0 AS depth FROM d WHERE parent IS NULL OR known IS NULL UNION ALL SELECT d.id, coalesce(t.problem, d.own), t.depth + 1 FROM d JOIN t ON d.parent = t.id)"""


@query("G2_corrective_chains", f"{CHAINS} SELECT id, CASE WHEN problem IS NULL THEN coalesce(parent, 0) ELSE 0 END AS parent, coalesce(problem, '') AS problem, coalesce(state = 'disputed', false) AS disputed, parent IS NOT NULL AND problem IS NULL AS weak FROM d JOIN t USING (id)")
def _(spark, sf):
    """Chains of the relation table: whom each change charges, and what is wrong with those that charge nobody."""
    r = settled_chains(spark, sf)
    return r.select("id", "parent", F.when(F.col("parent") == 0, F.col("reason")).otherwise(F.lit("")).alias("problem"), "disputed", ((F.col("parent") != 0) & F.col("provisional")).alias("weak"))


@query("G3_allocation")
def _(spark, sf):
    """Points, shares, growth and status of every change of the chains."""
    return settled_chains(spark, sf)


def settled_chains(spark, sf):
    from tallyspark.operators import chains

    r = relations(spark, sf).where("parent > 0")
    none = F.lit(None).cast("string")
    link = F.struct("parent", "state", none.alias("own"), none.alias("before"), none.alias("after"), none.alias("original"), F.lit(False).alias("pure"))
    links = r.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_list(link)).alias("links"))
    fraction = lambda c, by: F.concat((F.col(c) * by).cast("long").cast("string"), F.lit(f"/{by}"))
    rows = B.outcomes(spark, sf).drop("merge_sha").join(links, "id", "left").select("id", "repo", F.col("pr_number").cast("int").alias("pr"), F.sha2(F.col("id").cast("string"), 256).alias("sha"), "developer", F.col("merged_at").cast("timestamp").alias("merged_at"), fraction("weight", 2).alias("weight"), F.concat(F.round(F.col("quality") * 10).cast("long").cast("string"), F.lit("/10")).alias("quality"), (F.col("id") % 1500).alias("effort"), "links")
    return chains.settle(rows)


@query("T14_worktree_branch", """, m AS (SELECT event_id, user_id AS worktree, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id AS worktree, ts, max('b' || (event_id % 5)) AS branch FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT m.event_id, m.worktree, m.ts, r.branch FROM m ASOF LEFT JOIN r ON m.worktree = r.worktree AND m.ts >= r.ts""")
def _(spark, sf):
    e = B.table(spark, sf, "events").withColumnRenamed("user_id", "worktree")
    reflog = e.where("event_type = 'purchase'").groupBy("worktree", "ts").agg(F.max(F.concat(F.lit("b"), (F.col("event_id") % 5).cast("string"))).alias("branch"))
    return recovery.as_of(e.where("event_type = 'click'").select("event_id", "worktree", "ts"), reflog, "worktree", "branch")


@query("T13_held_back", "SELECT event_id, user_id AS session, ts FROM events e WHERE (SELECT max(ts) FROM events x WHERE x.user_id = e.user_id) <= TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 10 MINUTES")
def _(spark, sf):
    e = B.table(spark, sf, "events").select("event_id", F.col("user_id").alias("session"), "ts")
    return recovery.released(e, "2024-01-30 20:00:00")


@query("S6_message_scan", "SELECT l_orderkey AS id, l_shipdate AS updated, l_partkey AS input_tok, l_suppkey + l_linenumber AS output_tok, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND (l_shipdate, l_orderkey) > (TIMESTAMP '1999-01-01', 100) AND (l_partkey + l_suppkey + l_linenumber) % 8 <> 0 GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    n = F.col("l_linenumber").cast("long")
    tokens = F.struct(F.col("l_partkey").alias("input"), F.col("l_suppkey").alias("output"), n.alias("reasoning"), (F.col("l_partkey") + F.col("l_suppkey") + n + F.when((F.col("l_partkey") + F.col("l_suppkey") + n) % 8 == 0, 1).otherwise(0)).alias("total"))
    message = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("time_updated"), F.to_json(F.struct(F.when(F.col("l_linestatus") == "O", F.lit("own")).otherwise(F.lit("other")).alias("providerID"), tokens.alias("tokens"))).alias("data"))
    got = sessions.stored_messages(message, ("1999-01-01", 100), ["own"])
    return got.groupBy("id", F.col("time_updated").alias("updated"), "input_tok", "output_tok").agg(F.count("*").alias("n"))

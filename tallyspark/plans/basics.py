"""Queries of prices, scores, roll-ups and spend."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import pricing, scores
from tallyspark.plans.registry import query
from tallyspark.sources import bridge as B
from tallyspark.sources.shared import written

SINCE, UNTIL, MID, NOW = "1997-01-01", "2000-01-01", "1998-07-01", "1999-06-01"
IN_WINDOW = f"ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}'"
NORMAL = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(model)), '^zai-coding-plan/', ''), '(-\d{8}|-\d{6}|-\d{4}|-preview\d*|-latest)$', ''), '-\d{4}-\d{2}-\d{2}$', '')"
HOST = "coalesce(nullif(lower(trim(host)), ''), 'unknown')"
CLASS = r"""CASE WHEN regexp_matches(m, 'nemotron-ultra|deepseek-r1-full') THEN 'self-hosted-large' WHEN regexp_matches(m, 'phi-4-mini|embeddings|reranker') THEN 'self-hosted-small'
  WHEN regexp_extract(m, '(?:^|[^0-9])([0-9]+(?:\.[0-9]+)?)b(?:[^0-9a-z]|$)', 1) = '' THEN ''
  WHEN regexp_extract(m, '(?:^|[^0-9])([0-9]+(?:\.[0-9]+)?)b(?:[^0-9a-z]|$)', 1)::DOUBLE >= 70 THEN 'self-hosted-large'
  WHEN regexp_extract(m, '(?:^|[^0-9])([0-9]+(?:\.[0-9]+)?)b(?:[^0-9a-z]|$)', 1)::DOUBLE >= 7 THEN 'self-hosted-medium' ELSE 'self-hosted-small' END"""
UNATTRIBUTED = "(issue_id = '' OR issue_id = 'unattributed' OR issue_id LIKE 'unattributed:%')"


def events(spark, sf):
    return scores.in_window(B.token_events(spark, sf), SINCE, UNTIL)


def work(spark, sf):
    return scores.in_window(B.outcomes(spark, sf), SINCE, UNTIL)


E_SQL = f", e AS (SELECT * FROM token_events WHERE {IN_WINDOW})"
EO_SQL = f"{E_SQL}, o AS (SELECT * FROM outcomes WHERE {IN_WINDOW})"


@query("P1_normal_model", f"SELECT model, {NORMAL} AS normal, count(*) AS n FROM token_events GROUP BY 1, 2")
def _(spark, sf):
    return B.token_events(spark, sf).groupBy("model", S.normal_model(F.col("model")).alias("normal")).agg(F.count("*").alias("n"))


@query("P2_host_key", f"SELECT CASE WHEN {HOST} <> 'unknown' THEN {NORMAL} || '@' || {HOST} END AS key, {HOST} AS host, count(*) AS n FROM token_events GROUP BY 1, 2")
def _(spark, sf):
    return B.token_events(spark, sf).groupBy(S.host_key(F.col("model"), F.col("host")).alias("key"), S.normal_host(F.col("host")).alias("host")).agg(F.count("*").alias("n"))


@query("P3_size_class", f", t AS (SELECT {NORMAL} AS m FROM token_events) SELECT m AS model, {CLASS} AS class, count(*) AS n FROM t GROUP BY 1, 2")
def _(spark, sf):
    m = S.normal_model(F.col("model"))
    return B.token_events(spark, sf).groupBy(m.alias("model"), S.size_class(m).alias("class")).agg(F.count("*").alias("n"))


@query("P7_effort_weight", """, x AS (SELECT l_partkey % 2000 + l_suppkey + 10 * l_linenumber AS effort FROM lineitem)
SELECT CASE WHEN effort <= 15 THEN 0.5::DOUBLE WHEN effort <= 60 THEN 1 WHEN effort <= 200 THEN 3 WHEN effort <= 1000 THEN 5 ELSE 8 END AS weight, count(*) AS n FROM x GROUP BY 1""")
def _(spark, sf):
    return B.table(spark, sf, "lineitem").groupBy(S.effort_weight(F.col("l_partkey") % 2000, F.col("l_suppkey"), F.col("l_linenumber")).alias("weight")).agg(F.count("*").alias("n"))


LABELS = (["size/M", "type:bug"], ["XS", "kind: Security ", "feature"], ["docs"], [" incident", "size/xl", "s"], ["L", "research", "TECH-DEBT"], [])
LABEL_SQL = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {list(x)}::VARCHAR[]" for i, x in enumerate(LABELS)) + " END"


def _labels():
    key = F.col("o_orderkey") % 6
    out = F.when(key == 0, F.array(*map(F.lit, LABELS[0])))
    for i, x in enumerate(LABELS[1:], 1):
        out = out.when(key == i, F.array(*map(F.lit, x)) if x else F.array().cast("array<string>"))
    return out


@query("P6_size_weight", f""", k AS (SELECT {LABEL_SQL} AS labels FROM orders), w AS (SELECT list_filter(list_transform(labels, lambda x: CASE lower(x) WHEN 'size/xs' THEN 0.5::DOUBLE WHEN 'xs' THEN 0.5 WHEN 'size/s' THEN 1 WHEN 's' THEN 1 WHEN 'size/m' THEN 3 WHEN 'm' THEN 3 WHEN 'size/l' THEN 5 WHEN 'l' THEN 5 WHEN 'size/xl' THEN 8 WHEN 'xl' THEN 8 END), lambda x: x IS NOT NULL) AS w FROM k)
SELECT coalesce(w[1], 0) AS weight, count(*) AS n FROM w GROUP BY 1""")
def _(spark, sf):
    return B.table(spark, sf, "orders").groupBy(S.size_weight(_labels()).alias("weight")).agg(F.count("*").alias("n"))


@query("P9_work_type", f""", k AS (SELECT list_transform({LABEL_SQL}, lambda x: trim(regexp_replace(lower(trim(x)), '^(type|kind):', ''))) AS l FROM orders)
SELECT CASE WHEN list_contains(l, 'security') THEN 'security' WHEN list_contains(l, 'incident') THEN 'incident' WHEN list_contains(l, 'compliance') THEN 'compliance' WHEN list_contains(l, 'bug') THEN 'bug'
  WHEN list_contains(l, 'tech-debt') THEN 'tech-debt' WHEN list_contains(l, 'research') THEN 'research' ELSE 'feature' END AS work_type, count(*) AS n FROM k GROUP BY 1""")
def _(spark, sf):
    return B.table(spark, sf, "orders").groupBy(S.work_type(_labels()).alias("work_type")).agg(F.count("*").alias("n"))


@query("P8_resolved_weight", """, x AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 5.0::DOUBLE ELSE 0 END AS explicit, o_custkey % 900 + o_orderkey % 7 * 10 AS effort FROM orders)
SELECT CASE WHEN explicit <> 0 THEN explicit WHEN effort <= 15 THEN 0.5 WHEN effort <= 60 THEN 1 WHEN effort <= 200 THEN 3 WHEN effort <= 1000 THEN 5 ELSE 8 END AS weight,
  CASE WHEN explicit <> 0 THEN 'label' ELSE 'heuristic' END AS weight_source, count(*) AS n FROM x GROUP BY 1, 2""")
def _(spark, sf):
    explicit = F.when(F.col("o_orderkey") % 3 == 0, 5.0).otherwise(0.0)
    weight = F.when(explicit != 0, explicit).otherwise(S.effort_weight(F.col("o_custkey") % 900, F.lit(0), F.col("o_orderkey") % 7))
    return B.table(spark, sf, "orders").groupBy(weight.alias("weight"), F.when(explicit != 0, F.lit("label")).otherwise(F.lit("heuristic")).alias("weight_source")).agg(F.count("*").alias("n"))


@query("P10_to_micro", "SELECT l_orderkey % 100 AS k, sum((round_even(l_extendedprice * l_discount * 1e6, 0))::BIGINT)::BIGINT AS micro FROM lineitem GROUP BY 1")
def _(spark, sf):
    return B.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("k")).agg(F.sum(S.to_micro(F.col("l_extendedprice") * F.col("l_discount"))).alias("micro"))


@query("P17_branch_hash", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 THEN sha256('acme/r' || (o_orderkey % 6) || chr(0) || 'feat/' || (o_orderkey % 5)) END AS hash FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    repo = F.when(k % 6 == 0, F.lit("unqualified")).otherwise(F.concat(F.lit("acme/r"), (k % 6).cast("string")))
    branch = F.when(k % 5 == 0, F.lit("main")).otherwise(F.concat(F.lit("refs/heads/feat/"), (k % 5).cast("string")))
    return B.table(spark, sf, "orders").select("o_orderkey", S.branch_hash(repo, branch).alias("hash"))


@query("P20_idempotency_key", """, x AS (SELECT l_orderkey::VARCHAR AS a, l_linenumber::VARCHAR AS b FROM lineitem), f AS (SELECT unhex(lpad(hex(length(a)), 16, '0')) || encode(a) || unhex(lpad(hex(length(b)), 16, '0')) || encode(b) AS framed FROM x)
SELECT sha256(framed) AS key, count(*) AS n FROM f GROUP BY 1""")
def _(spark, sf):
    return B.table(spark, sf, "lineitem").groupBy(S.length_prefixed(F.col("l_orderkey"), F.col("l_linenumber")).alias("key")).agg(F.count("*").alias("n"))


MESSAGES = ("Revert: PM requested, no longer needed", "Revert because it broke the build", "Revert feature flag\nnow disabled", "Revert pivoting away after an outage", "Revert")
MESSAGE_SQL = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)) + " END"


@query("P21_revert_kind", f"""SELECT CASE WHEN o_orderkey % 5 IN (0, 2) THEN 'revert_strategic' ELSE 'revert_quality' END AS kind, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    message = F.get(F.array(*map(F.lit, MESSAGES)), (F.col("o_orderkey") % 5).cast("int"))
    return B.table(spark, sf, "orders").groupBy(S.revert_kind(message).alias("kind")).agg(F.count("*").alias("n"))


@query("P38_periods", "SELECT strftime(m, '%Y-%m') AS period FROM (SELECT unnest(generate_series(DATE '1997-01-01', DATE '1999-12-01', INTERVAL 1 MONTH)) AS m)")
def _(spark, sf):
    return spark.range(1).select(F.explode(F.expr("sequence(DATE '1997-01-01', DATE '1999-12-01', INTERVAL 1 MONTH)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("period"))


@query("F1_window", f"SELECT count(*) AS n, sum(cost_micro)::BIGINT AS cost_micro FROM token_events WHERE {IN_WINDOW}")
def _(spark, sf):
    return events(spark, sf).agg(F.count("*").alias("n"), F.sum("cost_micro").alias("cost_micro"))


@query("F2_repo_scope", "SELECT developer, count(*) AS n FROM token_events WHERE repo = 'acme/r3' GROUP BY 1")
def _(spark, sf):
    return scores.in_repo(B.token_events(spark, sf), "acme/r3").groupBy("developer").agg(F.count("*").alias("n"))


@query("F3_row_validation", """SELECT CASE WHEN input_tok > 45000 THEN 'tokens' WHEN ts >= TIMESTAMP '2001-06-01' THEN 'future' WHEN length(developer) > 5 THEN 'developer' END AS reason, count(*) AS n FROM token_events GROUP BY 1""")
def _(spark, sf):
    reason = F.when(F.col("input_tok") > 45_000, F.lit("tokens")).when(F.col("ts") >= F.lit("2001-06-01").cast("timestamp_ntz"), F.lit("future")).when(F.length("developer") > 5, F.lit("developer"))
    return B.token_events(spark, sf).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("F4_unattributed", f"SELECT {UNATTRIBUTED} AS unattributed, count(*) AS n, sum(cost_micro)::BIGINT AS cost_micro FROM token_events GROUP BY 1")
def _(spark, sf):
    return B.token_events(spark, sf).groupBy(S.unattributed(F.col("issue_id")).alias("unattributed")).agg(F.count("*").alias("n"), F.sum("cost_micro").alias("cost_micro"))


@query("F6_excluded", "SELECT work_type, count(*) AS n FROM outcomes WHERE merge_sha NOT IN (SELECT sha256(o_orderkey::VARCHAR) FROM orders WHERE o_orderkey % 13 = 0) GROUP BY 1")
def _(spark, sf):
    gone = B.table(spark, sf, "orders").where("o_orderkey % 13 = 0").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("merge_sha"))
    return B.outcomes(spark, sf).join(gone, "merge_sha", "left_anti").groupBy("work_type").agg(F.count("*").alias("n"))


@query("F7_bot_filter", "SELECT author_type, count(*) AS n FROM outcomes WHERE author_type <> 'Bot' AND NOT regexp_matches(developer, '(\\[bot\\]|-bot)$') GROUP BY 1")
def _(spark, sf):
    return B.outcomes(spark, sf).where((F.col("author_type") != "Bot") & ~F.col("developer").rlike(r"(\[bot\]|-bot)$")).groupBy("author_type").agg(F.count("*").alias("n"))


COST_SQL = "SELECT developer, sum(cost_micro)::BIGINT AS cost_micro, sum(CASE WHEN fidelity = 'realtime' THEN cost_micro ELSE 0 END)::BIGINT AS realtime_micro FROM e GROUP BY 1"


@query("A1_developer_cost", f"{E_SQL} {COST_SQL}")
def _(spark, sf):
    return scores.developer_cost(events(spark, sf))


@query("A2_issue_cost", f"""{E_SQL} SELECT developer, repo, issue_id, sum(cost_micro)::BIGINT AS cost_micro, sum(CASE WHEN source <> 'anthropic-admin' AND fidelity = 'realtime' THEN cost_micro ELSE 0 END)::BIGINT AS realtime_micro,
  sum(CASE WHEN source <> 'anthropic-admin' AND fidelity <> 'realtime' THEN cost_micro ELSE 0 END)::BIGINT AS late_micro, count(*) AS n FROM e GROUP BY 1, 2, 3""")
def _(spark, sf):
    return scores.issue_cost(events(spark, sf))


TOKENS_SQL = """, latest AS (SELECT repo, issue_id, max(ts) AS latest FROM o GROUP BY 1, 2),
tok AS (SELECT e.repo, e.issue_id, e.developer, sum(input_tok + output_tok + cache_read + cache_write_5m + cache_write_1h)::BIGINT AS tokens FROM e JOIN latest l ON e.repo = l.repo AND e.issue_id = l.issue_id
  AND e.ts <= l.latest AND e.ts >= l.latest - INTERVAL 14 DAYS GROUP BY 1, 2, 3),
ot AS (SELECT o.*, coalesce(tokens, 0) AS tokens FROM o LEFT JOIN tok USING (repo, issue_id, developer))"""
RATIOS = """points20 / 20.0::DOUBLE AS points, CASE WHEN cost_micro > 0 THEN (points20 / 20.0::DOUBLE) / (cost_micro / 1e6 / 1000) ELSE 0 END AS points_per_k,
  CASE WHEN cost_micro > 0 THEN realtime_micro / cost_micro::DOUBLE * 100 ELSE 0 END AS coverage_pct, CASE WHEN points20 > 0 THEN cost_micro / 1e6 / (points20 / 20.0::DOUBLE) END AS cost_per_point,
  CASE WHEN paid_micro > 0 THEN cost_micro / 1e6 / (paid_micro / 1e6) ELSE 0 END AS leverage, flagged = 0 AND n >= 3 AND cost_micro >= 5000000 AS ranked"""
SCORE_SQL = f"""{EO_SQL}{TOKENS_SQL}, c AS ({COST_SQL}), w AS (SELECT developer, sum(points20)::BIGINT AS points20, count(*) AS n, sum(CASE WHEN tokens = 0 THEN 1 ELSE 0 END)::BIGINT AS flagged FROM ot GROUP BY 1),
p AS (SELECT developer, sum(paid_micro)::BIGINT AS paid_micro FROM spend WHERE developer IS NOT NULL GROUP BY 1),
s AS (SELECT developer, coalesce(cost_micro, 0) AS cost_micro, coalesce(realtime_micro, 0) AS realtime_micro, coalesce(points20, 0) AS points20, coalesce(n, 0) AS n, coalesce(flagged, 0) AS flagged, coalesce(paid_micro, 0) AS paid_micro
  FROM c FULL JOIN w USING (developer) FULL JOIN p USING (developer))"""


def scored(spark, sf):
    e, o = events(spark, sf), work(spark, sf)
    paid = B.spend(spark, sf).where("developer is not null").groupBy("developer").agg(F.sum("paid_micro").alias("paid_micro"))
    return scores.developer_scores(e, scores.zero_token_outcomes(o, e), paid)


@query("A3_developer_score", f"{SCORE_SQL} SELECT *, {RATIOS} FROM s")
def _(spark, sf):
    return scored(spark, sf)


@query("A4_evidence_floor", f"{SCORE_SQL} SELECT flagged = 0 AND n >= 3 AND cost_micro >= 5000000 AS ranked, count(*) AS developers FROM s GROUP BY 1")
def _(spark, sf):
    return scored(spark, sf).groupBy("ranked").agg(F.count("*").alias("developers"))


@query("A6_company", f"""{SCORE_SQL}, t AS (SELECT sum(cost_micro)::BIGINT AS cost_micro, sum(realtime_micro)::BIGINT AS realtime_micro, sum(points20)::BIGINT AS points20, sum(n)::BIGINT AS n, sum(flagged)::BIGINT AS flagged, sum(paid_micro)::BIGINT AS paid_micro, count(*) AS developers FROM s)
SELECT *, {RATIOS} FROM t WHERE developers > 0""")
def _(spark, sf):
    return scores.company_score(scored(spark, sf))


def _label_sql(label: str) -> str:
    at = "JOIN m ON x.developer = m.developer AND x.ts >= m.valid_from AND (m.valid_to IS NULL OR x.ts < m.valid_to)"
    return f"""{EO_SQL}, m AS (SELECT * FROM memberships), c AS (SELECT coalesce({label}, '') AS label, sum(cost_micro)::BIGINT AS cost_micro, sum(CASE WHEN fidelity = 'realtime' THEN cost_micro ELSE 0 END)::BIGINT AS realtime_micro FROM e x LEFT {at} GROUP BY 1),
w AS (SELECT coalesce({label}, '') AS label, sum(points20)::BIGINT AS points20, count(*) AS n FROM o x LEFT {at} GROUP BY 1),
s AS (SELECT label, coalesce(cost_micro, 0) AS cost_micro, coalesce(realtime_micro, 0) AS realtime_micro, coalesce(points20, 0) AS points20, coalesce(n, 0) AS n, 0::BIGINT AS flagged, 0::BIGINT AS paid_micro FROM c FULL JOIN w USING (label))"""


@query("A5_team_rollup", f"{_label_sql('team')} SELECT *, {RATIOS} FROM s")
def _(spark, sf):
    return scores.label_scores(events(spark, sf), work(spark, sf), B.memberships(spark, sf), "team")


@query("A7_division_rollup", f"{_label_sql('division')} SELECT *, {RATIOS} FROM s")
def _(spark, sf):
    return scores.label_scores(events(spark, sf), work(spark, sf), B.memberships(spark, sf), "division")


@query("A25_k_anonymous", f"""{_label_sql('team')}, ppl AS (SELECT DISTINCT coalesce(team, '') AS label, x.developer FROM o x LEFT JOIN m ON x.developer = m.developer AND x.ts >= m.valid_from AND (m.valid_to IS NULL OR x.ts < m.valid_to)),
k AS (SELECT label, count(*) AS people FROM ppl GROUP BY 1), nm AS (SELECT s.*, CASE WHEN people >= 5 AND label <> '' THEN label ELSE 'other' END AS shown FROM s LEFT JOIN k USING (label)),
f AS (SELECT shown AS label, sum(cost_micro)::BIGINT AS cost_micro, sum(points20)::BIGINT AS points20, sum(n)::BIGINT AS n FROM nm GROUP BY 1),
mem AS (SELECT shown AS label, count(DISTINCT developer) AS people FROM ppl JOIN nm USING (label) GROUP BY 1)
SELECT f.*, people FROM f LEFT JOIN mem USING (label) WHERE NOT EXISTS (SELECT 1 FROM mem WHERE label = 'other' AND people < 5)""")
def _(spark, sf):
    e, o, m = events(spark, sf), work(spark, sf), B.memberships(spark, sf)
    return scores.k_anonymous(scores.label_scores(e, o, m, "team"), scores.labelled(o, m, "team").select("label", "developer"), k=5)


COSTS = ", i AS (SELECT developer, issue_id, repo, sum(cost_micro)::BIGINT AS c FROM e GROUP BY 1, 2, 3)"


@query("J2_joined_cost", f"""{EO_SQL}{COSTS}, k AS (SELECT DISTINCT developer, issue_id, repo FROM o)
SELECT k.developer, k.issue_id, k.repo, coalesce(sum(c), 0)::BIGINT AS cost_micro FROM k LEFT JOIN i ON i.developer = k.developer AND i.issue_id = k.issue_id AND (i.repo = k.repo OR i.repo = 'unqualified' OR k.repo = 'unqualified') GROUP BY 1, 2, 3""")
def _(spark, sf):
    return scores.joined_cost(work(spark, sf).select("developer", "issue_id", "repo").distinct(), events(spark, sf)).select("developer", "issue_id", "repo", "cost_micro")


@query("J3_outcome_tokens", f"{EO_SQL}{TOKENS_SQL} SELECT id, tokens FROM ot")
def _(spark, sf):
    return scores.zero_token_outcomes(work(spark, sf), events(spark, sf)).select("id", "tokens")


@query("A8_work_types", f"""{EO_SQL}{COSTS}, k AS (SELECT DISTINCT work_type, developer, issue_id, repo FROM o),
j AS (SELECT k.work_type, k.developer, coalesce(sum(c), 0)::BIGINT AS cost_micro FROM k LEFT JOIN i ON i.developer = k.developer AND i.issue_id = k.issue_id AND (i.repo = k.repo OR i.repo = 'unqualified' OR k.repo = 'unqualified') GROUP BY 1, 2)
SELECT work_type, developer, sum(points20)::BIGINT AS points20, count(*) AS n, any_value(cost_micro) AS cost_micro FROM o JOIN j USING (work_type, developer) GROUP BY 1, 2""")
def _(spark, sf):
    return scores.work_type_segments(work(spark, sf), events(spark, sf))


@query("A9_reconciliation", f"""{EO_SQL}, x AS (SELECT cost_micro, CASE WHEN {UNATTRIBUTED} THEN 'u' WHEN EXISTS (SELECT 1 FROM o WHERE o.developer = e.developer AND o.issue_id = e.issue_id AND (o.repo = e.repo OR o.repo = 'unqualified' OR e.repo = 'unqualified')) THEN 'l' ELSE 'n' END AS part FROM e)
SELECT sum(cost_micro)::BIGINT AS window_micro, coalesce(sum(cost_micro) FILTER (part = 'l'), 0)::BIGINT AS linked_micro, coalesce(sum(cost_micro) FILTER (part = 'n'), 0)::BIGINT AS no_outcome_micro, coalesce(sum(cost_micro) FILTER (part = 'u'), 0)::BIGINT AS unattributed_micro FROM x""")
def _(spark, sf):
    return scores.reconciliation(events(spark, sf), work(spark, sf))


@query("A10_issue_report", f"""{EO_SQL}, c AS (SELECT repo, issue_id, sum(cost_micro)::BIGINT AS cost_micro FROM e WHERE NOT {UNATTRIBUTED} GROUP BY 1, 2), w AS (SELECT repo, issue_id, sum(points20)::BIGINT AS points20, count(*) AS n FROM o GROUP BY 1, 2)
SELECT repo, issue_id, coalesce(cost_micro, 0) AS cost_micro, coalesce(points20, 0) AS points20, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'cost-only' WHEN cost_micro IS NULL THEN 'outcome-only' WHEN points20 = 0 THEN 'no-points' ELSE 'joined' END AS status FROM c FULL JOIN w USING (repo, issue_id)""")
def _(spark, sf):
    return scores.issue_report(events(spark, sf), work(spark, sf))


@query("A11_composition", f"""{E_SQL} SELECT {NORMAL} AS model, sum(cost_micro)::BIGINT AS cost_micro, count(*) AS n, sum(cache_read)::BIGINT AS cache_read,
  CASE WHEN sum(input_tok + cache_read + cache_write_5m + cache_write_1h) > 0 THEN sum(cache_read)::DOUBLE / sum(input_tok + cache_read + cache_write_5m + cache_write_1h) END AS read_share FROM e GROUP BY 1""")
def _(spark, sf):
    return scores.composition(events(spark, sf), S.normal_model(F.col("model")))


@query("A12_unattributed", f"{E_SQL} SELECT issue_id AS bucket, sum(cost_micro)::BIGINT AS cost_micro, sum(cost_micro)::DOUBLE / sum(sum(cost_micro)) OVER () AS share FROM e WHERE {UNATTRIBUTED} GROUP BY 1")
def _(spark, sf):
    return scores.unattributed_buckets(events(spark, sf))


@query("A13_exploratory", f"{E_SQL} SELECT developer, sum(CASE WHEN issue_id = 'unattributed:main' THEN cost_micro ELSE 0 END)::BIGINT AS main_micro, sum(CASE WHEN issue_id = 'unattributed:main' THEN cost_micro ELSE 0 END)::DOUBLE / sum(cost_micro) AS share FROM e GROUP BY 1")
def _(spark, sf):
    return scores.exploratory_share(events(spark, sf))


@query("A15_fidelity", f"""SELECT source, max(ts) AS last_ts, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS AND ts < TIMESTAMP '{NOW}') AS n_7d, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS AND ts < TIMESTAMP '{NOW}') AS n_30d,
  count(*) FILTER (fidelity = 'realtime') AS n_realtime, count(*) FILTER (fidelity = 'daily') AS n_daily, count(*) FILTER (fidelity = 'estimated') AS n_estimated FROM token_events GROUP BY 1""")
def _(spark, sf):
    return scores.fidelity_mix(B.token_events(spark, sf), NOW)


@query("A16_remainder", f""", d AS (SELECT ts::DATE AS day, {NORMAL} AS model, sum(CASE WHEN source = 'anthropic-admin' THEN input_tok + output_tok ELSE 0 END)::BIGINT AS org, sum(CASE WHEN source <> 'anthropic-admin' THEN input_tok + output_tok ELSE 0 END)::BIGINT AS captured FROM token_events GROUP BY 1, 2)
SELECT day, model, greatest(org - captured, 0) AS remainder, greatest(captured - org, 0) AS over FROM d""")
def _(spark, sf):
    return scores.poller_remainder(B.token_events(spark, sf), F.col("source") == "anthropic-admin", S.normal_model(F.col("model")))


@query("A18_allocated_spend", """, r AS (SELECT * FROM spend WHERE period >= '1999-03' AND period < '1999-09'), own AS (SELECT org, period, developer, sum(paid_micro)::BIGINT AS paid FROM r WHERE developer IS NOT NULL GROUP BY 1, 2, 3),
inv AS (SELECT org, period, sum(paid_micro)::BIGINT AS invoice FROM r WHERE developer IS NULL GROUP BY 1, 2), seats AS (SELECT DISTINCT org, developer FROM spend WHERE developer IS NOT NULL),
rest AS (SELECT inv.org, inv.period, greatest(invoice - coalesce((SELECT sum(paid) FROM own WHERE own.org = inv.org AND own.period = inv.period), 0), 0)::BIGINT AS rest FROM inv),
op AS (SELECT rest.*, s.developer FROM rest LEFT JOIN seats s USING (org) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.org = rest.org AND own.period = rest.period AND own.developer = s.developer)),
sh AS (SELECT developer, rest / greatest(count(developer) OVER (PARTITION BY org, period), 1)::DOUBLE AS paid FROM op),
ful AS (SELECT NULL::VARCHAR AS developer, rest::DOUBLE AS paid FROM rest WHERE NOT EXISTS (SELECT 1 FROM op WHERE op.org = rest.org AND op.period = rest.period))
SELECT developer, sum(paid) AS paid_micro FROM (SELECT developer, paid::DOUBLE AS paid FROM own UNION ALL SELECT * FROM sh UNION ALL SELECT * FROM ful) GROUP BY 1""")
def _(spark, sf):
    return scores.allocated_spend(B.spend(spark, sf), "1999-03", "1999-09").select("developer", F.col("paid_micro"))


@query("A19_active_seats", "SELECT org, period, count(DISTINCT developer) AS seats FROM spend WHERE developer IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return B.spend(spark, sf).where("developer is not null").groupBy("org", "period").agg(F.countDistinct("developer").alias("seats"))


@query("A20_partition", """, p AS (SELECT repo, issue_id, count(*) AS outcomes_, sum(points20)::BIGINT AS points20, sum(CASE WHEN weight = 8 THEN 1 ELSE 0 END)::BIGINT AS largest FROM outcomes WHERE source <> 'push' GROUP BY 1, 2)
SELECT outcomes_ AS outcomes, count(*) AS issues, sum(points20)::BIGINT AS points20, sum(largest)::BIGINT AS largest FROM p GROUP BY 1""")
def _(spark, sf):
    return scores.partition_diagnostics(B.outcomes(spark, sf))


@query("A22_join_readiness", """, c AS (SELECT repo, sum(cost_micro)::BIGINT AS size FROM token_events WHERE repo NOT IN ('unqualified', 'acme/r1') GROUP BY 1), w AS (SELECT repo, count(*) AS size FROM outcomes WHERE repo NOT IN ('unqualified', 'acme/r2') GROUP BY 1)
SELECT 'cost-only' AS kind, repo, size FROM c WHERE repo NOT IN (SELECT repo FROM w) UNION ALL SELECT 'outcome-only', repo, size FROM w WHERE repo NOT IN (SELECT repo FROM c)""")
def _(spark, sf):
    return scores.join_readiness(B.token_events(spark, sf).where("repo != 'acme/r1'"), B.outcomes(spark, sf).where("repo != 'acme/r2'"))


@query("A23_time_to_merge", f"""{_label_sql('team')}, lo AS (SELECT x.*, coalesce(team, '') AS label FROM o x LEFT JOIN m ON x.developer = m.developer AND x.ts >= m.valid_from AND (m.valid_to IS NULL OR x.ts < m.valid_to)),
nm AS (SELECT label FROM lo WHERE label <> '' GROUP BY 1 HAVING count(DISTINCT developer) >= 3), d AS (SELECT lo.*, nm.label AS name, epoch_us(merged_at) - epoch_us(created_at) AS us, CASE WHEN author_type = 'Bot' THEN 'bot' WHEN created_at > merged_at THEN 'no_created_at' END AS reason FROM lo LEFT JOIN nm USING (label)),
co AS (SELECT CASE WHEN name IS NULL THEN 'residual' ELSE 'group' END AS kind, coalesce(name, 'other') AS name, us, developer FROM d WHERE reason IS NULL UNION ALL SELECT 'total', '', us, developer FROM d WHERE reason IS NULL),
l AS (SELECT kind, name, count(*) AS n, count(DISTINCT developer) AS authors, list_sort(list(us)) AS s FROM co GROUP BY 1, 2), g AS (SELECT *, n >= 3 AND authors >= 3 AS clear FROM l), h AS (SELECT *, kind = 'total' AND EXISTS (SELECT 1 FROM g WHERE kind <> 'total' AND NOT clear) AS held FROM g)
SELECT kind, name, CASE WHEN clear AND NOT held THEN n END AS n, CASE WHEN clear AND NOT held THEN (s[(n + 1) // 2] + s[n // 2 + 1]) // 2 // 1000000 END AS median_s, CASE WHEN clear AND NOT held AND n >= 10 THEN s[n - n // 10] // 1000000 END AS p90_s, CASE WHEN NOT clear THEN 'authors<k' WHEN held THEN 'withheld_with_group' WHEN n < 10 THEN 'n<10' END AS null_reason FROM h
UNION ALL SELECT 'excluded', reason, count(*), NULL, NULL, NULL FROM d WHERE reason IS NOT NULL GROUP BY 2""")
def _(spark, sf):
    """Teams as scores name them, under the floor of three people."""
    e, o, m = events(spark, sf), work(spark, sf), B.memberships(spark, sf)
    labelled = scores.labelled(o, m, "team")
    shown = written(scores.k_anonymous(scores.label_scores(e, o, m, "team"), labelled.select("label", "developer")).select("label"), "shown")
    return scores.time_to_merge(labelled, shown, safe=not shown.isEmpty())


def _halves(spark, sf):
    e, o = B.token_events(spark, sf), B.outcomes(spark, sf)
    return [scores.developer_scores(scores.in_window(e, a, b), scores.in_window(o, a, b)) for a, b in ((SINCE, MID), (MID, UNTIL))]


def _half_sql(a: str, b: str) -> str:
    return f"""SELECT developer, cost_micro, CASE WHEN cost_micro > 0 THEN points20 / 20.0::DOUBLE / (cost_micro / 1e6 / 1000) ELSE 0 END AS ratio FROM (SELECT developer, coalesce(c, 0) AS cost_micro, coalesce(p, 0) AS points20 FROM
  (SELECT developer, sum(cost_micro)::BIGINT AS c FROM token_events WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' GROUP BY 1) FULL JOIN (SELECT developer, sum(points20)::BIGINT AS p FROM outcomes WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}' GROUP BY 1) USING (developer))"""


@query("J11_compare", f""", a AS ({_half_sql(SINCE, MID)}), b AS ({_half_sql(MID, UNTIL)})
SELECT developer, a.ratio AS before_ratio, a.cost_micro AS before_micro, a.developer IS NOT NULL AS in_before, b.ratio AS after_ratio, b.cost_micro AS after_micro, b.developer IS NOT NULL AS in_after, b.ratio - a.ratio AS change FROM a FULL JOIN b USING (developer)""")
def _(spark, sf):
    return scores.compared(*_halves(spark, sf), "developer")


@query("A31_price_versions", f"SELECT DISTINCT price_version FROM token_events WHERE {IN_WINDOW}")
def _(spark, sf):
    return events(spark, sf).select("price_version").distinct()


@query("A32_cost_horizon", "SELECT source, min(ts) AS first_ts FROM token_events GROUP BY 1 UNION ALL SELECT 'all', min(ts) FROM token_events")
def _(spark, sf):
    return B.token_events(spark, sf).rollup("source").agg(F.min("ts").alias("first_ts")).withColumn("source", F.coalesce("source", F.lit("all")))


@query("A34_watermarks", f"SELECT coalesce(max(id), 0) AS max_id, count(*) FILTER ({IN_WINDOW}) AS n FROM token_events")
def _(spark, sf):
    inside = (F.col("ts") >= F.lit(SINCE).cast("timestamp_ntz")) & (F.col("ts") < F.lit(UNTIL).cast("timestamp_ntz"))
    return B.token_events(spark, sf).agg(F.coalesce(F.max("id"), F.lit(0)).alias("max_id"), F.count(F.when(inside, 1)).alias("n"))


@query("A38_issue_counts", "SELECT issue_id, count(*) AS n FROM token_events GROUP BY 1")
def _(spark, sf):
    return B.token_events(spark, sf).groupBy("issue_id").agg(F.count("*").alias("n"))


@query("A46_evidence", "SELECT developer, count(*) FILTER (source <> 'anthropic-admin') AS captured, count(*) FILTER (source = 'anthropic-admin') AS manual FROM token_events GROUP BY 1")
def _(spark, sf):
    manual = F.col("source") == "anthropic-admin"
    return B.token_events(spark, sf).groupBy("developer").agg(F.count(F.when(~manual, 1)).alias("captured"), F.count(F.when(manual, 1)).alias("manual"))


@query("A48_org_spend", "SELECT org, period, coalesce(sum(paid_micro) FILTER (developer IS NULL), 0)::BIGINT AS invoice, coalesce(sum(paid_micro) FILTER (developer IS NOT NULL), 0)::BIGINT AS people, coalesce(sum(paid_micro) FILTER (developer IS NOT NULL), 0) > coalesce(sum(paid_micro) FILTER (developer IS NULL), 0) AS over FROM spend GROUP BY 1, 2")
def _(spark, sf):
    part = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("paid_micro"))), F.lit(0)).alias(name)
    return B.spend(spark, sf).groupBy("org", "period").agg(part(F.col("developer").isNull(), "invoice"), part(F.col("developer").isNotNull(), "people")).withColumn("over", F.col("people") > F.col("invoice"))


RATES = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in (r.key, r.provider, r.input_per_m, r.output_per_m, r.combined, r.read_mult, r.write_5m_mult, r.write_1h_mult, r.threshold, r.input_over, r.output_over, r.billing_mode)) + ")" for r in pricing.SAMPLE)
PRICED = f""", rates(key, provider, i, u, combined, rm, w5, w1, th, io, uo, billing_mode) AS (SELECT col0, col1, col2::DOUBLE, col3::DOUBLE, col4, col5::DOUBLE, col6::DOUBLE, col7::DOUBLE, col8, col9::DOUBLE, col10::DOUBLE, col11 FROM (VALUES {RATES})),
t AS (SELECT *, {NORMAL} AS m, {HOST} AS h FROM token_events), k AS (SELECT *, {CLASS} AS cls FROM t),
j AS (SELECT k.*, CASE WHEN a.key IS NOT NULL THEN 0 WHEN b.key IS NOT NULL THEN 1 ELSE 2 END AS how, coalesce(a.key, b.key, c.key) AS rate_key FROM k LEFT JOIN rates a ON h <> 'unknown' AND a.key = m || '@' || h LEFT JOIN rates b ON NOT contains(m, '@') AND b.key = m LEFT JOIN rates c ON c.key = CASE WHEN cls = '' THEN 'self-hosted-medium' ELSE cls END),
r AS (SELECT j.*, rates.* EXCLUDE (key), CASE WHEN th > 0 AND input_tok + cache_read + cache_write_5m + cache_write_1h > th THEN io ELSE i END AS ri, CASE WHEN th > 0 AND input_tok + cache_read + cache_write_5m + cache_write_1h > th THEN uo ELSE u END AS ro FROM j JOIN rates ON rate_key = rates.key),
priced AS (SELECT *, round_even(1e6 * CASE WHEN combined THEN (input_tok + output_tok + cache_read + cache_write_5m + cache_write_1h)::DOUBLE / 1e6 * i
  ELSE input_tok::DOUBLE / 1e6 * ri + cache_read::DOUBLE / 1e6 * ri * rm + cache_write_5m::DOUBLE / 1e6 * ri * w5 + cache_write_1h::DOUBLE / 1e6 * ri * w1 + output_tok::DOUBLE / 1e6 * ro END, 0)::BIGINT AS priced_micro,
  CASE WHEN how = 2 THEN CASE WHEN cls = '' THEN 'flat' ELSE 'size-class' END END AS guess FROM r)"""


@query("P5_priced", f"{PRICED} SELECT m AS model, h AS host, billing_mode, guess, count(*) AS n, sum(priced_micro)::BIGINT AS priced_micro FROM priced GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    p = pricing.priced(B.token_events(spark, sf), pricing.price_table(spark))
    return p.groupBy(S.normal_model(F.col("model")).alias("model"), S.normal_host(F.col("host")).alias("host"), "billing_mode", "guess").agg(F.count("*").alias("n"), F.sum("priced_micro").alias("priced_micro"))


@query("A44_consistency", f"{PRICED} SELECT price_version, count(*) AS n, count(*) FILTER (priced_micro = cost_micro) AS agree, sum(priced_micro - cost_micro)::BIGINT AS drift_micro FROM priced GROUP BY 1")
def _(spark, sf):
    return pricing.cost_consistency(B.token_events(spark, sf), pricing.price_table(spark))


@query("X10_reprice", f"{PRICED} SELECT price_version AS old_version, 9 AS price_version, count(*) AS n, sum(cost_micro)::BIGINT AS old_micro, sum(priced_micro)::BIGINT AS cost_micro FROM priced WHERE price_version >= 2 AND priced_micro <> cost_micro GROUP BY 1")
def _(spark, sf):
    r = pricing.repriced(B.token_events(spark, sf), pricing.price_table(spark), 2, 9)
    return r.groupBy("old_version", "price_version").agg(F.count("*").alias("n"), F.sum("old_micro").alias("old_micro"), F.sum("cost_micro").alias("cost_micro"))


@query("A40_unknown_share", f"{PRICED} SELECT date_trunc('month', ts)::DATE AS month, sum(CASE WHEN guess IS NOT NULL THEN priced_micro ELSE 0 END)::DOUBLE / sum(priced_micro) AS share, sum(CASE WHEN guess IS NOT NULL THEN priced_micro ELSE 0 END)::DOUBLE / sum(priced_micro) > 0.05 AS alert FROM priced GROUP BY 1")
def _(spark, sf):
    p = pricing.priced(B.token_events(spark, sf), pricing.price_table(spark))
    share = F.sum(F.when(F.col("guess").isNotNull(), F.col("priced_micro")).otherwise(0)) / F.sum("priced_micro")
    return p.groupBy(F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(share.alias("share"), (share > 0.05).alias("alert"))

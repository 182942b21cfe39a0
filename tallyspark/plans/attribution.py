"""Queries of later attribution, quality, membership and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.scalars import micros

from tallyspark.functions import scalars as S
from tallyspark.functions import text as T
from tallyspark.operators import graph, intervals, ledgers, quality, recovery, scores
from tallyspark.plans.basics import UNATTRIBUTED, events, work
from tallyspark.plans.registry import query
from tallyspark.sources import bridge as B

WINDOWS = """, bw AS (SELECT *, greatest((SELECT max(p.merged_at) FROM outcomes p WHERE p.repo = o.repo AND p.head_branch_hash = o.head_branch_hash AND p.merged_at < o.merged_at), o.created_at - INTERVAL 7 DAYS) AS window_start FROM outcomes o)"""
CLAIMS = f"""{WINDOWS}, u AS (SELECT * FROM token_events WHERE {UNATTRIBUTED}),
cl AS (SELECT u.id, u.ts, u.cost_micro, bw.issue_id AS claim, bw.id AS outcome_id FROM u JOIN bw ON u.branch_hash = bw.head_branch_hash AND u.repo = bw.repo AND u.ts BETWEEN window_start AND merged_at
  UNION ALL SELECT u.id, u.ts, u.cost_micro, bw.issue_id, bw.id FROM u JOIN bw ON u.branch_hash IS NULL AND u.pr_number = bw.pr_number AND u.repo = bw.repo AND u.ts BETWEEN window_start AND merged_at)"""


@query("W1_branch_windows", f"{WINDOWS} SELECT id, window_start FROM bw")
def _(spark, sf):
    return recovery.branch_windows(B.outcomes(spark, sf)).select("id", "window_start")


@query("J5_claims", f"{CLAIMS} SELECT id, ts, claim, outcome_id, count(*) AS n FROM cl GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return recovery.claims(B.token_events(spark, sf), B.outcomes(spark, sf)).groupBy("id", "ts", "claim", "outcome_id").agg(F.count("*").alias("n"))


@query("T8_recovered", f"{CLAIMS} SELECT id, ts, cost_micro, min(claim) AS issue_id FROM cl GROUP BY 1, 2, 3 HAVING count(DISTINCT claim) = 1")
def _(spark, sf):
    return recovery.recovered(B.token_events(spark, sf), B.outcomes(spark, sf))


@query("A37_receipt", f"""{CLAIMS}, n AS (SELECT id, ts, cost_micro, count(DISTINCT claim) AS c FROM cl GROUP BY 1, 2, 3)
SELECT CASE coalesce(c, 0) WHEN 0 THEN 'unclaimed' WHEN 1 THEN 'recovered' ELSE 'contested' END AS disposition, count(*) AS n, sum(u.cost_micro)::BIGINT AS cost_micro FROM u LEFT JOIN n USING (id, ts, cost_micro) GROUP BY 1""")
def _(spark, sf):
    return recovery.receipt(B.token_events(spark, sf), B.outcomes(spark, sf))


MESSAGES_SQL = ", mg AS (SELECT event_id AS message_id, 'b' || (user_id % 20) AS branch, ts FROM events WHERE event_type = 'click'), co AS (SELECT 'b' || (user_id % 20) AS branch, ts AS commit_ts, event_id AS ord, event_type || event_id AS subject FROM events WHERE event_type = 'purchase')"


@query("J4_session_commits", f"{MESSAGES_SQL} SELECT message_id, branch, min(ord) AS ord, arg_min(subject, ord) AS subject FROM mg JOIN co USING (branch) WHERE abs(epoch_us(ts) - epoch_us(commit_ts)) <= 1800000000 GROUP BY 1, 2")
def _(spark, sf):
    e = B.table(spark, sf, "events").withColumn("branch", F.concat(F.lit("b"), (F.col("user_id") % 20).cast("string")))
    messages = e.where("event_type = 'click'").select(F.col("event_id").alias("message_id"), "branch", "ts")
    commits = e.where("event_type = 'purchase'").select("branch", "ts", F.col("event_id").alias("ord"), F.concat("event_type", F.col("event_id").cast("string")).alias("subject"))
    return recovery.commit_of_session(messages, commits).select("message_id", "branch", "ord", "subject")


COUNTERS = ", c AS (SELECT user_id AS session, event_id AS ordinal, sum(get(k) + CASE WHEN user_id % 10 = 0 AND event_id % 97 = 0 THEN -500 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events))".replace("get(k)", "k")


@query("W3_counter_deltas", f"""{COUNTERS}, d AS (SELECT session, ordinal, total - coalesce(lag(total) OVER (PARTITION BY session ORDER BY ordinal), 0) AS delta FROM c)
SELECT * FROM d WHERE session NOT IN (SELECT session FROM d WHERE delta < 0)""")
def _(spark, sf):
    from pyspark.sql.window import Window

    k = F.get_json_object("props", "$.k").cast("long") + F.when((F.col("user_id") % 10 == 0) & (F.col("event_id") % 97 == 0), -500).otherwise(0)
    c = B.table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("ordinal"), F.sum(k).over(Window.partitionBy("user_id").orderBy("event_id")).alias("total"))
    return recovery.counter_deltas(c)


@query("S5_first_model", """, r AS (SELECT user_id AS session, event_id AS ordinal, CASE WHEN event_id % 3 = 0 AND user_id % 7 <> 0 THEN 'm' || (event_id % 4) END AS model FROM events)
SELECT session, ordinal, coalesce(model, first_value(model IGNORE NULLS) OVER (PARTITION BY session ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS model FROM r WHERE session % 7 <> 0""")
def _(spark, sf):
    model = F.when((F.col("event_id") % 3 == 0) & (F.col("user_id") % 7 != 0), F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")))
    return recovery.first_model(B.table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("ordinal"), model.alias("model")))


@query("W6_push_owner", """, p AS (SELECT repo, issue_id, ts::DATE AS day, id % 5 AS push_order, merge_sha AS commit_sha FROM outcomes WHERE source = 'push') SELECT repo, issue_id, day, push_order, commit_sha FROM (SELECT *, row_number() OVER (PARTITION BY repo, issue_id, day ORDER BY push_order, commit_sha) AS r FROM p) WHERE r = 1""")
def _(spark, sf):
    p = B.outcomes(spark, sf).where("source = 'push'").select("repo", "issue_id", F.to_date("ts").alias("day"), (F.col("id") % 5).alias("push_order"), F.col("merge_sha").alias("commit_sha"))
    return recovery.push_owner(p)


RUNS = ", r AS (SELECT 'src' || (user_id % 5) AS source, ts AS covered_from, ts + to_minutes((event_id % 40)::INTEGER) AS settled_through FROM events)"


@query("T4_source_runs", f"""{RUNS}, o AS (SELECT *, CASE WHEN covered_from > max(settled_through) OVER w OR max(settled_through) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM r WINDOW w AS (PARTITION BY source ORDER BY covered_from, settled_through ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY covered_from, settled_through ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM o)
SELECT source, island, min(covered_from) AS covered_from, max(settled_through) AS settled_through, count(*) AS runs FROM i GROUP BY 1, 2""")
def _(spark, sf):
    runs = B.table(spark, sf, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"), F.col("ts").alias("covered_from"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 40).cast("int"))).alias("settled_through"))
    return recovery.source_runs(runs)


QE = """, qe AS (SELECT o_orderkey % 3000 AS outcome_id, CASE o_custkey % 6 WHEN 0 THEN 'ci_fail' WHEN 1 THEN 'ci_fail_flaky' WHEN 2 THEN 'ci_pass' WHEN 3 THEN 'revert_quality' WHEN 4 THEN 'revert_strategic' ELSE 'revert_ambiguous' END AS event_type,
  'sha' || (o_orderkey % 3) AS head_sha, 'wf' || (o_custkey % 2) AS workflow_id, CASE o_orderkey % 5 WHEN 0 THEN 'pull_request' WHEN 1 THEN NULL ELSE 'push' END AS trigger_event, o_orderkey % 4 AS attempt, o_orderdate AS event_ts FROM orders),
ev AS (SELECT * FROM qe WHERE event_type NOT IN ('ci_pass', 'ci_fail', 'ci_fail_flaky') OR trigger_event IS NULL OR trigger_event = 'push')"""


def quality_events(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.get(F.array(*map(F.lit, ("ci_fail", "ci_fail_flaky", "ci_pass", "revert_quality", "revert_strategic", "revert_ambiguous"))), (c % 6).cast("int"))
    trigger = F.when(k % 5 == 0, F.lit("pull_request")).when(k % 5 != 1, F.lit("push"))
    return B.table(spark, sf, "orders").select((k % 3000).alias("outcome_id"), kind.alias("event_type"), F.concat(F.lit("sha"), (k % 3).cast("string")).alias("head_sha"), F.concat(F.lit("wf"), (c % 2).cast("string")).alias("workflow_id"), trigger.alias("trigger_event"), (k % 4).alias("attempt"), F.col("o_orderdate").alias("event_ts"))


@query("F5_evidence", f"{QE} SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
def _(spark, sf):
    return quality.evidence(quality_events(spark, sf)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("A29_quality", f"""{QE}, f AS (SELECT DISTINCT outcome_id FROM ev e WHERE event_type = 'ci_fail' AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.event_type = 'ci_fail_flaky' AND x.outcome_id = e.outcome_id AND x.head_sha = e.head_sha AND x.workflow_id = e.workflow_id)),
r AS (SELECT outcome_id, min(CASE event_type WHEN 'revert_quality' THEN 0.1::DOUBLE WHEN 'revert_strategic' THEN 0.8 END) AS revert FROM ev GROUP BY 1)
SELECT o.id, least(CASE WHEN f.outcome_id IS NOT NULL THEN CASE WHEN o.id % 11 = 0 THEN 0.55::DOUBLE ELSE 0.7 END WHEN o.id % 11 = 0 THEN 0.85 ELSE 1.0 END, coalesce(revert, 1.0)) AS quality FROM outcomes o LEFT JOIN f ON f.outcome_id = o.id LEFT JOIN r ON r.outcome_id = o.id""")
def _(spark, sf):
    o = B.outcomes(spark, sf)
    return quality.resolved(o, quality_events(spark, sf), o.where("id % 11 = 0").select("id"))


@query("A21_evidence_share", f"""{QE}, h AS (SELECT DISTINCT outcome_id FROM ev) SELECT repo, sum((weight * 2)::BIGINT)::BIGINT AS weight2, sum(CASE WHEN h.outcome_id IS NOT NULL THEN (weight * 2)::BIGINT ELSE 0 END)::BIGINT AS seen2,
  sum(CASE WHEN h.outcome_id IS NOT NULL THEN (weight * 2)::BIGINT ELSE 0 END)::DOUBLE / sum((weight * 2)::BIGINT) AS share FROM outcomes LEFT JOIN h ON outcome_id = id GROUP BY 1""")
def _(spark, sf):
    return quality.evidence_share(B.outcomes(spark, sf), quality_events(spark, sf))


@query("T5_reruns", f"{QE} SELECT DISTINCT p.head_sha, p.workflow_id, p.attempt FROM qe p JOIN qe f ON p.event_type = 'ci_pass' AND f.event_type = 'ci_fail' AND p.head_sha = f.head_sha AND p.workflow_id = f.workflow_id AND p.attempt > f.attempt AND p.event_ts BETWEEN f.event_ts AND f.event_ts + INTERVAL 30 MINUTES")
def _(spark, sf):
    return quality.reruns(quality_events(spark, sf))


@query("A51_ambiguous_reverts", f"{QE} SELECT count(DISTINCT head_sha || ':' || attempt) AS refs FROM qe WHERE event_type = 'revert_ambiguous'")
def _(spark, sf):
    return quality_events(spark, sf).where("event_type = 'revert_ambiguous'").agg(F.countDistinct(F.concat_ws(":", "head_sha", F.col("attempt").cast("string"))).alias("refs"))


@query("J8_membership", """SELECT o.id, coalesce(m.team, '') AS label FROM outcomes o LEFT JOIN memberships m ON o.developer = m.developer AND o.ts >= m.valid_from AND (m.valid_to IS NULL OR o.ts < m.valid_to)""")
def _(spark, sf):
    return scores.labelled(B.outcomes(spark, sf), B.memberships(spark, sf), "team").select("id", "label")


@query("J9_roster", "SELECT DISTINCT team, developer FROM memberships WHERE valid_from < TIMESTAMP '2000-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2000-01-01')")
def _(spark, sf):
    m = B.memberships(spark, sf)
    return m.where((F.col("valid_from") < F.lit("2000-06-01").cast("timestamp_ntz")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit("2000-01-01").cast("timestamp_ntz")))).select("team", "developer").distinct()


RELATIONS = "SELECT child, parent, state FROM (SELECT o_orderkey AS child, greatest(o_orderkey - o_orderkey % 10, o_orderkey - o_custkey % 5 - 1) AS parent, CASE o_custkey % 4 WHEN 0 THEN 'declared' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'disputed' ELSE 'withdrawn' END AS state FROM orders) WHERE child <> parent"


def relations(spark, sf):
    """Corrects-links of all orders: each follows up one shortly before it, or is the first of its story."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    state = F.get(F.array(*map(F.lit, ("declared", "confirmed", "disputed", "withdrawn"))), (c % 4).cast("int"))
    parent = F.greatest(k - k % 10, k - c % 5 - 1)
    return B.table(spark, sf, "orders").select(k.alias("child"), parent.alias("parent"), state.alias("state")).where("child != parent")


@query("J12_repair_spend", f""", r AS ({RELATIONS}), ch AS (SELECT developer, repo, pr_number, issue_id FROM outcomes WHERE id IN (SELECT child FROM r WHERE state <> 'withdrawn'))
SELECT CASE WHEN e.pr_number IS NOT NULL THEN 'pull-request' ELSE 'issue' END AS kind, count(*) AS n, sum(cost_micro)::BIGINT AS cost_micro FROM token_events e
WHERE EXISTS (SELECT 1 FROM ch WHERE ch.developer = e.developer AND ch.repo = e.repo AND ch.pr_number = e.pr_number)
OR e.pr_number IS NULL AND EXISTS (SELECT 1 FROM ch WHERE ch.developer = e.developer AND ch.repo = e.repo AND ch.issue_id <> '' AND ch.issue_id = e.issue_id) GROUP BY 1""")
def _(spark, sf):
    live = relations(spark, sf).where("state != 'withdrawn'").select(F.col("child").alias("id"))
    hit = ledgers.repair_spend(B.token_events(spark, sf), B.outcomes(spark, sf).join(live, "id", "left_semi"))
    return hit.groupBy("kind").agg(F.count("*").alias("n"), F.sum("cost_micro").alias("cost_micro"))


@query("J16_coverage", "SELECT developer, issue_id, bool_or(repo = 'unqualified') AS blind, count(DISTINCT repo) FILTER (repo <> 'unqualified') AS repos FROM outcomes GROUP BY 1, 2")
def _(spark, sf):
    real = F.when(F.col("repo") != "unqualified", F.col("repo"))
    return work_all(spark, sf).groupBy("developer", "issue_id").agg(F.bool_or(F.col("repo") == "unqualified").alias("blind"), F.countDistinct(real).alias("repos"))


def work_all(spark, sf):
    return B.outcomes(spark, sf)


@query("J17_revert_outcome", """, rv AS (SELECT event_id, 'issue-' || (user_id % 500) AS issue_id, 'acme/r' || (user_id % 5 + 1) AS repo, TIMESTAMP '1999-06-01' + to_days((event_id % 300)::INTEGER) AS ts, CASE WHEN event_id % 4 = 0 THEN sha256((event_id % 40000)::VARCHAR) END AS sha FROM events WHERE event_type = 'error')
SELECT event_id, count(id) AS candidates, CASE WHEN count(id) = 1 THEN min(id) END AS outcome_id FROM rv LEFT JOIN outcomes o ON CASE WHEN sha IS NULL THEN o.issue_id = rv.issue_id AND o.repo = rv.repo AND o.ts <= rv.ts AND o.ts >= rv.ts - INTERVAL 60 DAYS ELSE o.merge_sha = sha END GROUP BY 1""")
def _(spark, sf):
    u = F.col("user_id")
    sha = F.when(F.col("event_id") % 4 == 0, F.sha2((F.col("event_id") % 40_000).cast("string"), 256))
    rv = B.table(spark, sf, "events").where("event_type = 'error'").select("event_id", F.concat(F.lit("issue-"), (u % 500).cast("string")).alias("issue_id"), F.concat(F.lit("acme/r"), (u % 5 + 1).cast("string")).alias("repo"), (F.lit("1999-06-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("event_id") % 300).cast("int"))).alias("ts"), sha.alias("sha"))
    return recovery.reverted_outcome(rv, B.outcomes(spark, sf), ["issue_id", "repo"]).select("event_id", "candidates", "outcome_id")


@query("J18_incompatible", """, c AS (SELECT DISTINCT developer, issue_id, repo AS cost_repo FROM token_events WHERE repo <> 'unqualified'), w AS (SELECT DISTINCT developer, issue_id, repo AS work_repo FROM outcomes WHERE repo <> 'unqualified')
SELECT cost_repo, work_repo, count(*) AS issues FROM c JOIN w USING (developer, issue_id) WHERE cost_repo <> work_repo GROUP BY 1, 2""")
def _(spark, sf):
    c = B.token_events(spark, sf).where("repo != 'unqualified'").select("developer", "issue_id", F.col("repo").alias("cost_repo")).distinct()
    w = B.outcomes(spark, sf).where("repo != 'unqualified'").select("developer", "issue_id", F.col("repo").alias("work_repo")).distinct()
    return c.join(w, ["developer", "issue_id"]).where("cost_repo != work_repo").groupBy("cost_repo", "work_repo").agg(F.count("*").alias("issues"))


@query("G1_components", f""", r AS ({RELATIONS}), l AS (SELECT DISTINCT child AS a, parent AS b FROM r UNION SELECT DISTINCT parent, child FROM r),
t AS (WITH RECURSIVE x(a, b) AS (SELECT a, a FROM l UNION SELECT x.a, l.b FROM x JOIN l ON x.b = l.a) SELECT a AS id, min(b) AS root FROM x GROUP BY 1) SELECT * FROM t""")
def _(spark, sf):
    return graph.components(relations(spark, sf).select(F.col("child").alias("a"), F.col("parent").alias("b")))


@query("A39_doctor", f"""SELECT sum(cost_micro)::BIGINT AS total, sum(CASE WHEN NOT {UNATTRIBUTED} THEN cost_micro ELSE 0 END)::BIGINT AS attributed, sum(CASE WHEN issue_id = 'unattributed:main' THEN cost_micro ELSE 0 END)::BIGINT AS main, sum(CASE WHEN issue_id = 'unattributed:detached-head' THEN cost_micro ELSE 0 END)::BIGINT AS detached,
 CASE WHEN sum(CASE WHEN NOT {UNATTRIBUTED} THEN cost_micro ELSE 0 END) >= 0.9 * sum(cost_micro) THEN 'good' WHEN sum(CASE WHEN NOT {UNATTRIBUTED} THEN cost_micro ELSE 0 END) >= 0.5 * sum(cost_micro) THEN 'fair' ELSE 'poor' END AS verdict FROM token_events""")
def _(spark, sf):
    part = lambda c, name: F.sum(F.when(c, F.col("cost_micro")).otherwise(0)).alias(name)
    d = B.token_events(spark, sf).agg(F.sum("cost_micro").alias("total"), part(~S.unattributed(F.col("issue_id")), "attributed"), part(F.col("issue_id") == "unattributed:main", "main"), part(F.col("issue_id") == "unattributed:detached-head", "detached"))
    share = F.col("attributed") / F.col("total")
    return d.withColumn("verdict", F.when(share >= 0.9, F.lit("good")).when(share >= 0.5, F.lit("fair")).otherwise(F.lit("poor")))


@query("A41_tripwire", """, w AS (SELECT date_trunc('month', ts)::DATE AS month, sum(cost_micro)::BIGINT AS cost_micro FROM token_events GROUP BY 1), o AS (SELECT DISTINCT date_trunc('month', ts)::DATE AS month FROM outcomes)
SELECT month, cost_micro FROM w WHERE cost_micro > 0 AND month NOT IN (SELECT month FROM o)""")
def _(spark, sf):
    month = F.to_date(F.date_trunc("month", "ts")).alias("month")
    cost = B.token_events(spark, sf).groupBy(month).agg(F.sum("cost_micro").alias("cost_micro")).where("cost_micro > 0")
    return cost.join(B.outcomes(spark, sf).select(month).distinct(), "month", "left_anti")


@query("A53_effective", f"""{CLAIMS}, rc AS (SELECT id, ts, cost_micro, min(claim) AS found FROM cl GROUP BY 1, 2, 3 HAVING count(DISTINCT claim) = 1)
SELECT e.id, e.ts, e.issue_id AS stored, coalesce(found, e.issue_id) AS effective, CASE WHEN found IS NULL THEN 'stored' ELSE 'recovered' END AS layer, count(*) AS n FROM token_events e LEFT JOIN rc ON {UNATTRIBUTED.replace('issue_id', 'e.issue_id')} AND rc.id = e.id AND rc.ts = e.ts AND rc.cost_micro = e.cost_micro GROUP BY 1, 2, 3, 4, 5""")
def _(spark, sf):
    e = B.token_events(spark, sf)
    found = recovery.recovered(e, B.outcomes(spark, sf)).withColumnRenamed("issue_id", "found").withColumn("open", F.lit(True))
    both = e.withColumn("open", F.when(S.unattributed(F.col("issue_id")), F.lit(True))).join(found, ["id", "ts", "cost_micro", "open"], "left")
    return both.groupBy("id", "ts", F.col("issue_id").alias("stored"), F.coalesce("found", "issue_id").alias("effective"), F.when(F.col("found").isNull(), F.lit("stored")).otherwise(F.lit("recovered")).alias("layer")).agg(F.count("*").alias("n"))


@query("A17_delta", """, t AS (SELECT developer, period, sum(paid_micro)::BIGINT AS total FROM spend WHERE developer IS NOT NULL GROUP BY 1, 2), p AS (SELECT developer, period, sum(paid_micro)::BIGINT AS posted FROM spend WHERE developer IS NOT NULL AND paid_micro % 3 <> 0 GROUP BY 1, 2)
SELECT developer, period, coalesce(total, 0) - coalesce(posted, 0) AS delta FROM t FULL JOIN p USING (developer, period) WHERE coalesce(total, 0) <> coalesce(posted, 0)""")
def _(spark, sf):
    s = B.spend(spark, sf).where("developer is not null")
    return ledgers.delta_to_post(s.groupBy("developer", "period").agg(F.sum("paid_micro").alias("total")), s.where("paid_micro % 3 != 0").withColumn("amount", F.col("paid_micro")), ["developer", "period"])


@query("P11_branch_issue", r"""SELECT branch, issue FROM (VALUES ('feat/123-add', 'issue-123'), ('OP-7_fix', 'OP-7'), ('fix/OP-0042/x', 'OP-0042'), ('main', NULL), ('2024-05-01-notes', NULL), ('feat/2024', NULL), ('feat/12345.x', 'issue-12345'), ('revert-12-x', NULL), ('a/b/9', NULL), ('release/12-x', NULL), ('dependabot/9', NULL)) t(branch, issue)""")
def _(spark, sf):
    b = spark.createDataFrame([("feat/123-add",), ("OP-7_fix",), ("fix/OP-0042/x",), ("main",), ("2024-05-01-notes",), ("feat/2024",), ("feat/12345.x",), ("revert-12-x",), ("a/b/9",), ("release/12-x",), ("dependabot/9",)], "branch string")
    return b.select("branch", T.issue_of_branch(F.col("branch")).alias("issue"))


@query("P14_closed_issues", fr"""SELECT doc_id, list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: 'issue-' || x) AS issues FROM (
SELECT doc_id, flatten(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '(?m)^[ \t]*(?:[-*+][ \t]\s*)?[*_]*[ \t]*(?i:corrects)[ \t]*[*_]*[ \t]*[:：#].*$', 'x', 'g'), '{T.CLOSING}', 1), lambda c: regexp_extract_all(c, '#([1-9][0-9]*)', 1))) AS l FROM documents)""")
def _(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", T.closed_issues(F.col("text")).alias("issues"))


@query("P15_visible_text")
def _(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", T.visible_text(F.col("text")).alias("visible"))


@query("P16_corrects")
def _(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", T.corrects(F.col("text")).alias("declared")).select("doc_id", "declared.*")


@query("X6_day_digests", """, x AS (SELECT ts::DATE AS day, sha256(unhex(lpad(hex(length(id::VARCHAR)), 16, '0')) || encode(id::VARCHAR) || unhex(lpad(hex(length(developer)), 16, '0')) || encode(developer) || unhex(lpad(hex(length(cost_micro::VARCHAR)), 16, '0')) || encode(cost_micro::VARCHAR)) AS h FROM token_events)
SELECT day, count(*) AS n, sum(('0x' || h[1:12])::BIGINT)::VARCHAR AS h0, sum(('0x' || h[13:24])::BIGINT)::VARCHAR AS h1, sum(('0x' || h[25:36])::BIGINT)::VARCHAR AS h2, sum(('0x' || h[37:48])::BIGINT)::VARCHAR AS h3 FROM x GROUP BY 1""")
def _(spark, sf):
    return ledgers.day_digests(B.token_events(spark, sf), ["id", "developer", "cost_micro"])


BIGGER = " OR ".join(f"x.{c} > a.{c}" for c in ledgers.VECTOR)
LESS = " OR ".join(f"x.{c} < a.{c}" for c in ledgers.VECTOR)
WINS = f"(x.developer = a.developer AND ({BIGGER}) AND NOT ({LESS}))"
KEPT = ", ".join(f"{c} := CASE WHEN {WINS} THEN x.{c} ELSE a.{c} END" for c in (*ledgers.VECTOR, "developer"))


@query("T1_upsert", f""", l AS (SELECT id::VARCHAR AS key, list_sort(list(struct_pack(ingest := epoch_us(ts), {", ".join(f"{c} := {c}" for c in (*ledgers.VECTOR, "developer"))}, replaced := 0, conflicts := 0))) AS s FROM token_events GROUP BY 1),
r AS (SELECT key, list_reduce(s, lambda a, x: struct_pack(ingest := a.ingest, {KEPT}, replaced := a.replaced + {WINS}::INTEGER, conflicts := a.conflicts + (x.developer <> a.developer OR ({BIGGER}) AND ({LESS}))::INTEGER)) AS h FROM l)
SELECT key, h.developer AS developer, {", ".join(f"h.{c} AS {c}" for c in ledgers.VECTOR)}, h.replaced AS replaced, h.conflicts AS conflicts FROM r""")
def _(spark, sf):
    e = B.token_events(spark, sf).withColumn("key", F.col("id").cast("string"))
    return ledgers.upserted(e.withColumn("ingest", micros("ts")).select("key", "developer", "ingest", *ledgers.VECTOR))


@query("T2_first_writer", "SELECT developer, issue_id, repo, id FROM (SELECT *, row_number() OVER (PARTITION BY developer, issue_id, repo ORDER BY ts, id) AS r FROM outcomes) WHERE r = 1")
def _(spark, sf):
    return ledgers.first_writer(B.outcomes(spark, sf), ["developer", "issue_id", "repo"], ["ts", "id"]).select("developer", "issue_id", "repo", "id")


@query("O3_page", "SELECT id, ts, developer, true AS more FROM outcomes WHERE (ts, id) > (TIMESTAMP '1998-01-01', 700) ORDER BY ts, id LIMIT 100")
def _(spark, sf):
    return ledgers.page(B.outcomes(spark, sf).select("id", "ts", "developer"), 100, ("1998-01-01", 700))


@query("X1_intervals")
def _(spark, sf):
    return intervals.intervals(*intervals.interval_rows(work(spark, sf), events(spark, sf)))

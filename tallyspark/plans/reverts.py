"""Queries of reverts: events of errors are reverts, orders are outcomes and say by their messages which kind a revert is."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import reverts as R
from tallyspark.plans.basics import MESSAGES
from tallyspark.plans.registry import query
from tallyspark.sources import bridge as B

#: A fourth of the reverts has a footer, an eleventh came with a merge; an earlier look was in doubt about every other guess.
DECIDED = """oc AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'unqualified' ELSE 'acme/r' || (o_orderkey % 6) END AS repo, 'issue-' || (o_orderkey % 50) AS issue_id, o_orderdate::TIMESTAMP AS ts, left(sha256(o_orderkey::VARCHAR), 40) AS merge_sha FROM orders),
rv AS (SELECT event_id, 'v' || event_id AS sha, CASE WHEN event_id % 6 < 5 THEN 'acme/r' || (event_id % 6 + 1) END AS repo, 'issue-' || (user_id % 50) AS issue_id, TIMESTAMP '1998-01-01' + to_days((event_id % 900)::INTEGER) AS ts, event_id % 5 IN (0, 2) AS strategic, event_id % 11 = 0 AS merges,
  CASE WHEN event_id % 4 = 0 THEN left(sha256((event_id * 7 % 20000)::VARCHAR), 40) END AS named FROM events WHERE event_type = 'error'),
gs AS (SELECT rv.sha, count(id) FILTER (o.repo = rv.repo) AS candidates, min(id) FILTER (o.repo = rv.repo) AS one, count(id) FILTER (o.repo = 'unqualified') AS legacy FROM rv JOIN oc o ON o.issue_id = rv.issue_id AND o.ts BETWEEN rv.ts - INTERVAL 60 DAYS AND rv.ts GROUP BY 1),
de AS (SELECT rv.sha, strategic, named, rv.repo, rv.issue_id, rv.ts, CASE WHEN named IS NOT NULL THEN CASE WHEN o.id IS NULL THEN 'footer_unresolved' WHEN rv.ts > o.ts + INTERVAL 60 DAYS THEN 'late' ELSE 'resolved' END WHEN merges THEN 'merge_push'
  WHEN candidates > 1 OR candidates = 1 AND event_id % 2 = 0 THEN 'ambiguous' WHEN candidates = 1 THEN 'resolved' WHEN legacy > 0 THEN 'legacy_only' ELSE 'no_candidate' END AS reason,
  CASE WHEN named IS NOT NULL THEN (o.id IS NOT NULL)::BIGINT WHEN merges THEN 0 ELSE coalesce(candidates, 0) END AS candidates, coalesce(o.id, one) AS one FROM rv LEFT JOIN gs USING (sha) LEFT JOIN oc o ON o.merge_sha = named)"""


def looked_at(spark, sf):
    """reverts, outcomes and the decisions after an earlier look that was in doubt about some."""
    k, i = F.col("id"), F.col("event_id")
    text = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in x))
    named = lambda key: F.left(F.sha2(key.cast("string"), 256), F.lit(40))
    o = B.outcomes(spark, sf).select("id", "repo", text("issue-", k % 50).alias("issue_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), named(k).alias("merge_sha"))
    message = F.get(F.array(*map(F.lit, MESSAGES)), (i % 5).cast("int"))
    footer = F.when(i % 4 == 0, F.concat(F.lit("\n\nThis reverts commit "), named(i * 7 % 20_000), F.lit("."))).otherwise(F.lit(""))
    r = B.table(spark, sf, "events").where("event_type = 'error'").select(
        text("v", i).alias("sha"), F.when(i % 6 < 5, text("acme/r", i % 6 + 1)).alias("repo"), text("issue-", F.col("user_id") % 50).alias("issue_id"),
        (F.lit("1998-01-01").cast("timestamp_ntz") + F.make_dt_interval((i % 900).cast("int"))).alias("ts"), F.concat(message, footer).alias("message"), (i % 11 == 0).alias("merge_push"), (i % 4 > 0).alias("plain"), (i % 2 == 0).alias("even"),
    )
    first = R.decided(r, o, spark.createDataFrame([], "outcome_id long, event_type string, source_ref string"))
    prior = first.where("reason = 'resolved'").join(r.where("plain and even").select("sha"), "sha", "left_semi").select("outcome_id", F.lit("revert_ambiguous").alias("event_type"), F.col("sha").alias("source_ref"))
    return r, o, R.decided(r, o, prior)


@query("J17_revert_decisions", f"WITH {DECIDED} SELECT sha, CASE WHEN reason = 'resolved' THEN one END AS outcome_id, CASE WHEN reason = 'resolved' THEN CASE WHEN strategic THEN 'revert_strategic' ELSE 'revert_quality' END END AS event_type, reason, candidates FROM de")
def _(spark, sf):
    return looked_at(spark, sf)[2]


@query("J17_doubted_outcomes", f"WITH {DECIDED} SELECT o.id, count(*) AS reverts, arg_min(d.sha, row(d.ts, d.sha)) AS first_revert FROM de d JOIN oc o ON o.repo = d.repo AND o.issue_id = d.issue_id AND o.ts BETWEEN d.ts - INTERVAL 60 DAYS AND d.ts WHERE reason = 'ambiguous' AND candidates > 1 GROUP BY 1")
def _(spark, sf):
    r, o, d = looked_at(spark, sf)
    return R.doubted(d, r, o)

"""Queries of direct pushes, whose day rows follow the commits that pull requests leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import push_ledger
from tallyspark.plans.registry import query
from tallyspark.sources import bridge as B

#: Orders as deliveries and, one in eight, as merges; a customer's orders name five commits. Each thirteenth names a row from before the ledger.
COMMANDS = """o AS (SELECT o_orderkey + 1 AS seq, 'r' || (o_custkey % 3) AS repo, 'c' || o_custkey || '-' || (o_orderkey % 5) AS sha, 'issue-' || (o_custkey % 4) AS issue_id, strftime(o_orderdate, '%Y-%m') AS day, 'dev-' || (o_orderkey % 50) AS developer,
  o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 1000) AS ts, CASE WHEN o_orderkey % 3 > 0 THEN epoch(o_orderdate::TIMESTAMP)::BIGINT + o_orderkey * 37 % 86400 ELSE 9223372036854775807 END AS place, o_orderkey % 8 = 2 AS merges, o_orderkey % 13 = 0 AS before FROM orders),
m AS (SELECT sha, min(seq) AS merged FROM o WHERE merges GROUP BY 1), live AS (SELECT o.*, merged FROM o LEFT JOIN m USING (sha) WHERE NOT merges AND (merged IS NULL OR merged > seq)),
e AS (SELECT repo, sha, arg_min(issue_id, seq) AS issue_id, arg_min(day, seq) AS day, arg_min(developer, seq) AS developer, arg_min(ts, seq) AS ts, min(place) AS place, min(seq) AS came, any_value(merged) AS merged FROM live GROUP BY 1, 2),
u AS (SELECT repo, issue_id, day, min(seq) AS id, arg_min(developer, seq) AS developer, arg_min(ts, seq) AS ts FROM o WHERE before GROUP BY 1, 2, 3),
k AS (SELECT repo, issue_id, day, 'pre-ledger:' || id AS sha, developer, ts, 0 AS place, 0 AS arrival, 0 AS born, NULL::BIGINT AS merged FROM u WHERE EXISTS (SELECT 1 FROM e WHERE e.repo = u.repo AND e.issue_id = u.issue_id AND e.day = u.day))"""


def folded(spark, sf):
    k, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    text = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in x))
    later = lambda n: F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + n).cast("timestamp_ntz")
    o = B.table(spark, sf, "orders").select(
        (k + 1).alias("seq"), text("r", c % 3).alias("repo"), text("c", c, "-", k % 5).alias("commit_sha"), text("issue-", c % 4).alias("issue_id"), F.date_format(day, "yyyy-MM").alias("day"),
        text("dev-", k % 50).alias("developer"), later(k % 1000).alias("ts"), F.when(k % 3 > 0, later(k * 37 % 86400)).alias("pushed_at"), (k % 8 == 2).alias("merges"), (k % 13 == 0).alias("before"),
    )
    unlisted = o.where("before").withColumnRenamed("seq", "id")
    return push_ledger.pushed(o.where("not merges"), o.where("merges").select("seq", F.col("commit_sha").alias("sha")), unlisted=unlisted)


@query("T15_push_days", f"""WITH {COMMANDS}, n AS (SELECT repo, issue_id, day, sha, developer, ts, place, CASE WHEN place = 9223372036854775807 THEN came ELSE 0 END AS arrival FROM e WHERE merged IS NULL UNION ALL SELECT repo, issue_id, day, sha, developer, ts, place, arrival FROM k)
SELECT repo, issue_id, day, developer, ts, commits FROM (SELECT *, count(*) OVER (PARTITION BY repo, issue_id, day) AS commits, row_number() OVER (PARTITION BY repo, issue_id, day ORDER BY place, arrival, ts, sha) AS r FROM n) WHERE r = 1
UNION ALL SELECT repo, issue_id, day, developer, ts, 0 FROM u WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo = u.repo AND e.issue_id = u.issue_id AND e.day = u.day)""")
def _(spark, sf):
    return folded(spark, sf).days


@query("T15_push_audit", f"""WITH {COMMANDS}, v AS (SELECT e.repo, e.issue_id, e.day, e.sha, e.developer, e.ts, l.place, CASE WHEN l.place = 9223372036854775807 THEN came ELSE 0 END AS arrival, l.seq AS born, e.merged FROM live l JOIN e ON e.repo = l.repo AND e.sha = l.sha UNION ALL FROM k),
s AS (SELECT repo, issue_id, day, born AS seq, sha, developer FROM v WHERE born > 0 UNION SELECT repo, issue_id, day, merged, sha, developer FROM e WHERE merged IS NOT NULL),
w AS (SELECT s.repo, s.issue_id, s.day, s.seq, any_value(s.sha) AS commit_sha, any_value(s.developer) AS commit_developer,
  min(row(v.place, v.arrival, v.ts, v.sha, v.developer)) FILTER (v.born < s.seq AND (v.merged IS NULL OR v.merged >= s.seq)) AS was, min(row(v.place, v.arrival, v.ts, v.sha, v.developer)) FILTER (v.born <= s.seq AND (v.merged IS NULL OR v.merged > s.seq)) AS now
  FROM s JOIN v ON v.repo = s.repo AND v.issue_id = s.issue_id AND v.day = s.day GROUP BY 1, 2, 3, 4),
c AS (SELECT * FROM w WHERE was IS NOT NULL AND (now IS NULL OR was[3] <> now[3] OR was[5] <> now[5]))
SELECT repo, issue_id, day, seq, CASE WHEN now IS NULL THEN 'superseded' ELSE 'rederived_from' END AS action, was[5] AS developer, was[3] AS ts, commit_sha, commit_developer FROM c
UNION ALL SELECT repo, issue_id, day, seq, 'rederived_to', now[5], now[3], commit_sha, commit_developer FROM c WHERE now IS NOT NULL""")
def _(spark, sf):
    return folded(spark, sf).audit


@query("W6_push_statuses", f"WITH {COMMANDS} SELECT CASE WHEN o.seq >= m.merged THEN 'pr_captured' WHEN e.came = o.seq THEN 'recorded' ELSE 'duplicate' END AS status, count(*) AS n FROM o LEFT JOIN m USING (sha) LEFT JOIN e ON e.repo = o.repo AND e.sha = o.sha WHERE NOT merges GROUP BY 1")
def _(spark, sf):
    return folded(spark, sf).statuses.groupBy("status").agg(F.count("*").alias("n"))

"""Queries of the lives of corrects-relations and of points by projection."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.operators import lifecycle
from tallyspark.plans.registry import query
from tallyspark.plans.rest import settled_chains
from tallyspark.sources import bridge as B


def relations_and_commands(spark, sf):
    """A relation for each customer, and a command on it by each of the customer's orders, three of which are given for one revision."""
    known = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("relation"), F.lit("declared").alias("state"), F.concat(F.lit("dev-"), (F.col("c_custkey") % 50).cast("string")).alias("child_developer"), (F.col("c_custkey") % 11 != 0).alias("captured"))
    k = F.col("o_orderkey")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    actor = F.concat(F.lit("dev-"), (k % 50).cast("string"))
    action = F.get(F.array(*map(F.lit, lifecycle.ACTIONS)), (k % 6).cast("int"))
    revision = (1 + F.floor((rank - 1) / 3)).cast("long")
    review = F.struct(F.lit("5").alias("original"), F.lit("1").alias("own"), F.lit("3").alias("before"), F.lit("5").alias("after"), F.lit(False).alias("pure"), revision.alias("revision"), actor.alias("reviewer"))
    commands = B.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("relation"), k.alias("seq"), F.col("o_orderdate").alias("at"), action.alias("action"), actor.alias("actor"), F.when(k % 5 == 0, F.lit("author")).otherwise(F.lit("operator")).alias("role"), F.when(k % 13 == 0, F.lit("")).otherwise(F.lit("seen")).alias("reason"),
        revision.alias("revision"), F.when(action.isin("confirm", "settle-re-assess") & (k % 17 != 0), review).alias("review"),
    )
    return known, commands


COMMANDS = """WITH RECURSIVE c AS (SELECT o_custkey AS relation, o_orderkey AS seq, row_number() OVER w AS n, ['confirm', 'dispute', 'withdraw', 'settle-uphold', 'settle-re-assess', 'settle-remove'][o_orderkey % 6 + 1] AS action, 'dev-' || (o_orderkey % 50) AS actor,
  CASE WHEN o_orderkey % 5 = 0 THEN 'author' ELSE 'operator' END AS role, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'seen' END AS reason, 1 + (row_number() OVER w - 1) // 3 AS revision, o_orderkey % 17 <> 0 AS reviewed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
m AS (SELECT *, CASE WHEN action <> 'confirm' AND reason = '' THEN 'reason-required' WHEN action IN ('confirm', 'settle-re-assess') AND NOT reviewed THEN 'review-required' END AS bad, 'dev-' || (relation % 50) AS child, relation % 11 <> 0 AS captured FROM c),
t AS (SELECT unnest([{'a': 'confirm', 's': 'declared', 'x': 'confirmed'}, {'a': 'dispute', 's': 'declared', 'x': 'disputed-declared'}, {'a': 'dispute', 's': 'disputed-declared', 'x': 'disputed-declared'}, {'a': 'dispute', 's': 'confirmed', 'x': 'disputed'}, {'a': 'dispute', 's': 'disputed', 'x': 'disputed'}, {'a': 'dispute', 's': 'withdrawn-confirmed', 'x': 'disputed'},
  {'a': 'withdraw', 's': 'declared', 'x': 'withdrawn'}, {'a': 'withdraw', 's': 'confirmed', 'x': 'withdrawn-confirmed'}, {'a': 'withdraw', 's': 'disputed', 'x': 'withdrawn-confirmed'}, {'a': 'settle-uphold', 's': 'disputed', 'x': 'confirmed'}, {'a': 'settle-uphold', 's': 'withdrawn-confirmed', 'x': 'confirmed'}, {'a': 'settle-uphold', 's': 'disputed-declared', 'x': 'declared'},
  {'a': 'settle-re-assess', 's': 'disputed', 'x': 'confirmed'}, {'a': 'settle-re-assess', 's': 'withdrawn-confirmed', 'x': 'confirmed'}, {'a': 'settle-re-assess', 's': 'disputed-declared', 'x': 'confirmed'}, {'a': 'settle-remove', 's': 'disputed', 'x': 'removed'}, {'a': 'settle-remove', 's': 'withdrawn-confirmed', 'x': 'removed'}, {'a': 'settle-remove', 's': 'disputed-declared', 'x': 'removed'}], recursive := true)),
f AS (SELECT c_custkey AS relation, 0::BIGINT AS n, 0::BIGINT AS seq, '' AS action, '' AS why, 'declared' AS state, 1::BIGINT AS revision, []::VARCHAR[] AS keys, []::VARCHAR[] AS said FROM customer UNION ALL
SELECT relation, n, seq, action, why, CASE WHEN why = '' THEN x ELSE state END, CASE WHEN why = '' THEN revision + 1 ELSE revision END, CASE WHEN why = '' THEN list_append(keys, key) ELSE keys END, CASE WHEN why = '' THEN list_append(said, all_) ELSE said END FROM (
  SELECT m.relation, m.n, m.seq, m.action, f.state, f.revision, f.keys, f.said, t.x, m.revision || ':' || m.action AS key, m.revision || ':' || m.action || ':' || m.actor || ':' || m.role || ':' || m.reason AS all_,
    CASE WHEN bad IS NOT NULL THEN bad WHEN list_contains(f.said, m.revision || ':' || m.action || ':' || m.actor || ':' || m.role || ':' || m.reason) THEN 'replay' WHEN list_contains(f.keys, m.revision || ':' || m.action) THEN 'conflicting-replay' WHEN m.revision <> f.revision THEN 'stale-or-erased'
      WHEN m.action IN ('confirm', 'settle-re-assess') AND NOT captured THEN 'outcome-not-captured' WHEN m.action NOT IN ('dispute', 'withdraw') AND role <> 'operator' THEN 'operator-required'
      WHEN t.x IS NULL THEN CASE m.action WHEN 'confirm' THEN 'needs-settlement' WHEN 'dispute' THEN 'inactive' WHEN 'withdraw' THEN 'not-withdrawable' ELSE 'not-disputed' END WHEN t.x = 'confirmed' AND actor = child THEN 'own-declaration' ELSE '' END AS why
  FROM f JOIN m ON m.relation = f.relation AND m.n = f.n + 1 LEFT JOIN t ON t.a = m.action AND t.s = f.state))"""


@query("G5_commands", f"{COMMANDS} SELECT relation, seq, action, why IN ('', 'replay') AS taken, why, state, revision FROM f WHERE n > 0")
def _(spark, sf):
    return lifecycle.run(*relations_and_commands(spark, sf))


@query("G5_states", f"{COMMANDS} SELECT relation, max_by(state, n) AS state, max(revision) AS revision FROM f GROUP BY 1")
def _(spark, sf):
    known, commands = relations_and_commands(spark, sf)
    return lifecycle.states(known, lifecycle.run(known, commands))


@query("G4_projected_points")
def _(spark, sf):
    """Points by developer as the settled chains have them; every outcome must have its projection."""
    p = settled_chains(spark, sf).select("id", lifecycle.number("points").alias("points"), lifecycle.number("quality").alias("quality"), "eligible", F.lit("event3-v1").alias("rule"))
    o = lifecycle.effective(B.outcomes(spark, sf), p, True)
    return o.groupBy("developer").agg(F.sum("points").alias("points"), F.count("*").alias("outcomes"), F.count(F.when(F.col("eligible") == "eligible", 1)).alias("ranked"))

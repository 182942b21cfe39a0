"""Queries of agents' session logs: orders are records, in a log for each customer and for its two sub-agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.plans.registry import query
from tallyspark.sources import agents
from tallyspark.sources import bridge as B

NOW = "2024-05-10 12:00:00"
#: An order's key says what its record is: a workspace, a branch, an end, a link, a call or a review in the log, two calls of a sub-agent.
LOGS = """l AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 8 AS kind, 'run' || (o_orderkey % 3) AS run, 's' || (o_orderkey // 8 % 2) AS child FROM orders),
r AS (SELECT DISTINCT c, '/w/r' || (c % 5) AS root FROM l WHERE kind = 0), m AS (SELECT c, max(k) AS last FROM l WHERE kind < 6 GROUP BY 1), b AS (SELECT c, run, arg_max(CASE WHEN k % 16 = 1 THEN 'feat/' || k ELSE '' END, k) AS branch FROM l WHERE kind = 1 GROUP BY 1, 2),
t AS (SELECT c, run, max(k) AS ended FROM l WHERE kind = 2 GROUP BY 1, 2), n AS (SELECT c, child, count(DISTINCT run) AS runs, min(run) AS linked FROM l WHERE kind = 3 GROUP BY 1, 2),
x AS (SELECT l.*, kind > 5 AS sub, root, last, runs, CASE WHEN kind > 5 THEN linked ELSE run END AS of FROM l LEFT JOIN r USING (c) LEFT JOIN m USING (c) LEFT JOIN n ON kind > 5 AND n.c = l.c AND n.child = l.child WHERE kind > 3),
y AS (SELECT x.*, CASE WHEN root IS NOT NULL AND x.c % 5 > 2 THEN 'foreign' WHEN sub AND (last IS NULL OR root IS NOT NULL AND coalesce(runs, 0) <> 1) THEN CASE WHEN x.c % 3 = 0 THEN 'unlinked_held' ELSE 'unlinked_excluded' END WHEN root IS NULL THEN 'no_workspace_root'
  WHEN branch IS NULL AND NOT coalesce(last > ended, false) AND x.c % 3 = 0 THEN 'held' ELSE 'emitted' END AS disposition, branch FROM x LEFT JOIN b ON b.c = x.c AND b.run = x.of LEFT JOIN t ON t.c = x.c AND t.run = x.of)"""


def logs(spark, sf):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    text = lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in x))
    kind, run, child = k % 8, text("run", k % 3), text("s", F.floor(k / 8) % 2)
    only = lambda n, x: F.when(kind == n, x)
    billed, reviewed = kind.isin(4, 6, 7), kind == 5
    usage = F.when(kind > 3, F.struct((k % 50 + 20).alias("input_tokens"), F.when(billed, k % 20).alias("cached_tokens"), F.when(reviewed, k % 20).alias("cached_input_tokens"), (k % 9 + 1).alias("output_tokens")))
    event = F.struct(
        F.when(billed, F.lit(agents.COMPLETED)).when(reviewed, F.lit(agents.REVIEWED)).when(kind == 2, F.lit(agents.TERMINAL)).when(kind == 3, F.lit(agents.LINKED)).alias("kind"),
        only(3, run).alias("parent_run_id"), only(3, child).alias("child_session_id"), usage.alias("usage"), F.when(billed, F.lit("m")).alias("model"),
    )
    # a review names its model in an object
    review = F.struct(F.lit(agents.REVIEWED).alias("kind"), usage.alias("usage"), F.struct(F.lit("reviewer").alias("model_id")).alias("model"))
    record = F.struct(only(0, text("/w/r", c % 5)).alias("workspace_root"), only(1, run).alias("command_id"), only(1, F.lit("git")).alias("vcs"), only(1, F.struct(F.when(k % 16 == 1, F.lit("branch")).otherwise(F.lit("tag")).alias("kind"), text("feat/", k).alias("name"))).alias("reference"))
    what = F.when(kind == 0, F.lit(agents.METADATA)).when(kind == 1, F.lit(agents.BRANCH)).when(reviewed, F.lit(agents.APPROVAL)).otherwise(F.lit(agents.RUN))

    def line(e):
        head = (text("k", k).alias("id"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1_000_000).alias("recorded_at"), F.struct(text("s", c).alias("id")).alias("stream"))
        return F.to_json(F.struct(*head, F.struct(what.alias("kind"), F.when(kind > 1, run).alias("run_id"), e.alias("event"), F.when(kind < 2, record).alias("record")).alias("payload")))

    path = F.concat(text("/m/", c), F.when(kind > 5, F.concat(F.lit("/subagent/"), child)).otherwise(F.lit("")), F.lit("/session.jsonl"))
    lines = B.table(spark, sf, "orders").select(path.alias("path"), k.alias("line"), F.when(reviewed, line(review)).otherwise(line(event)).alias("value"), c.alias("c"))
    at = F.lit(NOW).cast("timestamp_ntz")
    files = lines.groupBy("path").agg(F.max(F.when(F.col("c") % 3 == 0, at - F.expr("INTERVAL 5 MINUTES")).otherwise(at - F.expr("INTERVAL 2 DAYS"))).alias("modified_at"))
    regions = B.table(spark, sf, "region").where("r_regionkey < 3").select(text("/w/r", F.col("r_regionkey")).alias("target"), F.col("r_regionkey").alias("place"))
    return agents.sessions(lines.drop("c"), files, regions, spark.createDataFrame([], "root string, main string"), NOW)


@query("S7_agent_calls", f"WITH {LOGS} SELECT 'k' || k AS record_id, of AS run, disposition, CASE WHEN disposition = 'emitted' THEN coalesce(branch, '') END AS branch, CASE WHEN disposition = 'emitted' THEN root END AS target, CASE WHEN disposition LIKE 'unlinked%' THEN CASE WHEN last IS NULL THEN 'no_parent_log' WHEN runs IS NULL THEN 'no_link' ELSE 'ambiguous_link' END END AS reason, k % 50 + 20 - k % 20 AS input_tok, k % 20 AS cache_read, k % 9 + 1 AS output_tok FROM y")
def _(spark, sf):
    return logs(spark, sf).calls.select("record_id", "run", "disposition", "branch", "target", "reason", "input_tok", "cache_read", "output_tok")


@query("J20_child_runs", f"WITH {LOGS} SELECT '/m/' || c || '/session.jsonl' AS top, child, of AS run, coalesce(branch, '') AS branch, count(*) AS calls, sum(k % 9 + 1)::BIGINT AS output_tok FROM y WHERE sub AND disposition = 'emitted' GROUP BY ALL")
def _(spark, sf):
    """The runs that sub-agents worked for, with the branch that the parent's log has for the run."""
    c = logs(spark, sf).calls.where("depth > 0 and disposition = 'emitted'").withColumn("child", F.regexp_extract("path", agents.CHILD, 2))
    return c.groupBy("top", "child", "run", "branch").agg(F.count("*").alias("calls"), F.sum("output_tok").alias("output_tok"))

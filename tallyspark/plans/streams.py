"""Queries that run through streams: growing files, deliveries, held messages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyspark.plans.registry import query
from tallyspark.plans.windows import session_lines
from tallyspark.sources import sessions
from tallyspark.sources.shared import shared_dir
from tallyspark.streaming import jobs, keyed


@query("S3_growing_files", "SELECT 's' || conv_id AS session, conv_id || '-' || floor(turn / 2)::BIGINT AS message_id, max(length(coalesce(text, ''))) AS input_tok, max(turn * 10) AS output_tok, count(*) AS lines, max(CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END) AS runs FROM conversations GROUP BY 1, 2")
def _(spark, sf):
    """Logs are written in two parts, and the tail is run after each, the second time from where it had got to."""
    at = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    value = F.get_json_object("value", "$.sessionId")
    lines, even = session_lines(spark, sf), F.substring(value, 2, 20).cast("long") % 2 == 0
    seen = []
    for part in (lines.where(even), lines.where(~even)):
        part.write.mode("append").text(f"{at}/logs", lineSep="\n")
        rows = jobs.tailed(spark, f"{at}/logs", f"{at}/lines", ".txt")
        seen.append(rows.agg(F.max("batch")).first()[0])
    first = seen[0] if seen[0] is not None else -1
    run = F.when(F.col("batch") <= first, 1).otherwise(2)
    runs = rows.select(value.alias("session"), F.get_json_object("value", "$.message.id").alias("message_id"), run.alias("run")).groupBy("session", "message_id").agg(F.max("run").alias("runs"))
    folded = sessions.folded(sessions.parsed(rows.select("value"))).select("session", "message_id", "input_tok", "output_tok", "lines")
    return folded.join(runs, ["session", "message_id"])


@query("T3_deliveries", """WITH RECURSIVE e AS (SELECT event_id % 700 AS delivery_id, event_id AS place, ts, event_type = 'error' AS failed, row_number() OVER (PARTITION BY event_id % 700 ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT delivery_id, n, CASE WHEN NOT failed THEN ts + INTERVAL 5 DAYS END AS until, place, ts, true AS went FROM e WHERE n = 1 UNION ALL
SELECT e.delivery_id, e.n, CASE WHEN e.ts < w.until THEN w.until WHEN NOT e.failed THEN e.ts + INTERVAL 5 DAYS END, e.place, e.ts, e.ts >= w.until OR w.until IS NULL FROM w JOIN e ON e.delivery_id = w.delivery_id AND e.n = w.n + 1)
SELECT delivery_id, place, ts FROM w WHERE went""")
def _(spark, sf):
    e = jobs.file_stream(spark, f"{sf}/events.parquet")
    d = e.select((F.col("event_id") % 700).alias("delivery_id"), F.col("event_id").alias("place"), "ts", (F.col("event_type") == "error").alias("failed"))
    return keyed.drained(keyed.first_deliveries(d, 5 * 86400), "deliveries").select("delivery_id", "place", "ts")


@query("T13_whole_messages", """WITH l AS (SELECT user_id AS session, CASE WHEN event_type = 'click' THEN 'agent' ELSE 'main' END AS stream, date_trunc('hour', ts) AS h, ts, event_id, floor(value)::BIGINT AS tok FROM events),
g AS (SELECT session, stream, h, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS lines, max(event_id % 1000) AS input_tok, greatest(max(tok), 0) AS output_tok FROM l GROUP BY 1, 2, 3),
n AS (SELECT *, max(h) OVER (PARTITION BY session, stream) AS newest, max(last_ts) OVER (PARTITION BY session) AS seen, max(last_ts) OVER () AS now FROM g)
SELECT session, stream, first_ts, last_ts, lines, input_tok, output_tok FROM n WHERE h < newest OR seen + INTERVAL 10 MINUTES <= now""")
def _(spark, sf):
    e = jobs.file_stream(spark, f"{sf}/events.parquet")
    stream = F.when(F.col("event_type") == "click", F.lit("agent")).otherwise(F.lit("main"))
    lines = e.select(F.col("user_id").cast("string").alias("session"), stream.alias("stream"), F.concat_ws("-", "user_id", stream, F.date_trunc("hour", "ts")).alias("message_id"), F.col("event_id").alias("place"), "ts", (F.col("event_id") % 1000).alias("input_tok"), F.floor("value").alias("output_tok"))
    out = keyed.drained(keyed.held_back(lines), "messages")
    return out.select(F.col("session").cast("long").alias("session"), "stream", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "lines", "input_tok", "output_tok")

"""Session logs, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = """type STRING, timestamp TIMESTAMP, gitBranch STRING, cwd STRING, sessionId STRING, isSidechain BOOLEAN, agentId STRING,
 message STRUCT<id STRING, model STRING, role STRING, usage STRUCT<input_tokens BIGINT, cache_creation_input_tokens BIGINT, cache_read_input_tokens BIGINT, output_tokens BIGINT,
 cache_creation STRUCT<ephemeral_5m_input_tokens BIGINT, ephemeral_1h_input_tokens BIGINT>>>"""


def parsed(lines: DataFrame) -> DataFrame:
    """Rows (value: one line of JSON) as columns; lines that aren't JSON, or hold no message id, are left out."""
    return lines.select(F.from_json("value", LINE, {"mode": "PERMISSIVE"}).alias("x")).select("x.*").where("message.id is not null")


def folded(rows: DataFrame) -> DataFrame:
    """One usage per session and message: a message's lines repeat it, so each count is the largest seen."""
    u = "message.usage"
    most = lambda c, name: F.max(F.coalesce(F.col(f"{u}.{c}"), F.lit(0))).alias(name)
    five, hour = F.col(f"{u}.cache_creation.ephemeral_5m_input_tokens"), F.col(f"{u}.cache_creation.ephemeral_1h_input_tokens")
    return rows.groupBy(F.col("sessionId").alias("session"), F.col("message.id").alias("message_id")).agg(
        F.max("message.model").alias("model"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), most("input_tokens", "input_tok"), most("output_tokens", "output_tok"), most("cache_read_input_tokens", "cache_read"),
        F.max(F.coalesce(five, F.col(f"{u}.cache_creation_input_tokens"), F.lit(0))).alias("cache_write_5m"), F.max(F.coalesce(hour, F.lit(0))).alias("cache_write_1h"), F.count("*").alias("lines"),
    )


STORED = "role STRING, modelID STRING, providerID STRING, tokens STRUCT<total BIGINT, input BIGINT, output BIGINT, reasoning BIGINT, cache STRUCT<read BIGINT, write BIGINT>>"


def stored_messages(messages: DataFrame, after: tuple[str, int], providers: list[str]) -> DataFrame:
    """Rows (id, time_updated, data) of a message store after a cursor, of known providers, whose token classes
    sum to their total. The store is read through JDBC where its driver is at hand, or from an export."""
    at = F.lit(after[0]).cast("timestamp_ntz")
    new = messages.where((F.col("time_updated") > at) | (F.col("time_updated") == at) & (F.col("id") > after[1]))
    m = new.select("id", "time_updated", F.from_json("data", STORED).alias("m")).where(F.col("m.providerID").isin(providers))
    n = lambda c: F.coalesce(F.col(f"m.tokens.{c}"), F.lit(0))
    parts = n("input") + n("output") + n("reasoning") + n("cache.read") + n("cache.write")
    valid = (parts == n("total")) & (n("total") <= 1 << 29)
    return m.where(valid).select("id", "time_updated", F.col("m.modelID").alias("model"), n("input").alias("input_tok"), (n("output") + n("reasoning")).alias("output_tok"), n("cache.read").alias("cache_read"))

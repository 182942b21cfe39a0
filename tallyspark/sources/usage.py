"""Usage as providers report it: responses, event streams, counters of rollouts, daily buckets and billing lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The fields in which providers report usage.
RESPONSE = """model STRING, usage STRUCT<input_tokens BIGINT, output_tokens BIGINT, cache_read_input_tokens BIGINT, cache_creation_input_tokens BIGINT,
 prompt_tokens BIGINT, completion_tokens BIGINT, prompt_tokens_details STRUCT<cached_tokens BIGINT>, input_tokens_details STRUCT<cached_tokens BIGINT>>,
 usageMetadata STRUCT<promptTokenCount BIGINT, candidatesTokenCount BIGINT, thoughtsTokenCount BIGINT, cachedContentTokenCount BIGINT>"""
FRAME = """type STRING, message STRUCT<usage STRUCT<input_tokens BIGINT, output_tokens BIGINT, cache_read_input_tokens BIGINT>>, usage STRUCT<output_tokens BIGINT>"""
ROLLOUT = """type STRING, timestamp TIMESTAMP, payload STRUCT<model STRING, info STRUCT<total_token_usage STRUCT<input_tokens BIGINT, cached_input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT>>>"""
BUCKETS = """data ARRAY<STRUCT<starting_at TIMESTAMP, results ARRAY<STRUCT<model STRING, uncached_input_tokens BIGINT, output_tokens BIGINT, cache_read_input_tokens BIGINT>>>>"""


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("long")


def responses(rows: DataFrame, provider: str = "provider", body: str = "body") -> DataFrame:
    """Model and token classes of responses. Cached tokens are taken out of inputs that hold them; a body that isn't
    JSON, or has no usage, is left out."""
    r = rows.withColumn("r", F.from_json(body, RESPONSE)).where("r.usage is not null or r.usageMetadata is not null")
    p = F.col(provider)
    cached = F.when(p == "openai", F.coalesce("r.usage.prompt_tokens_details.cached_tokens", "r.usage.input_tokens_details.cached_tokens")).when(p == "gemini", F.col("r.usageMetadata.cachedContentTokenCount")).otherwise(F.col("r.usage.cache_read_input_tokens"))
    whole = F.when(p == "openai", F.coalesce("r.usage.prompt_tokens", "r.usage.input_tokens")).otherwise(F.col("r.usageMetadata.promptTokenCount"))
    out = F.when(p == "openai", F.coalesce("r.usage.completion_tokens", "r.usage.output_tokens")).when(p == "gemini", zero("r.usageMetadata.candidatesTokenCount") + zero("r.usageMetadata.thoughtsTokenCount")).otherwise(F.col("r.usage.output_tokens"))
    own = F.when(p == "anthropic", zero("r.usage.input_tokens")).otherwise(F.greatest(zero(whole) - zero(cached), F.lit(0)))
    return r.withColumns({"model": F.col("r.model"), "input_tok": own, "output_tok": zero(out), "cache_read": zero(cached), "cache_write_5m": zero("r.usage.cache_creation_input_tokens")}).drop("r", body)


def streams(rows: DataFrame, key: str, body: str = "body") -> DataFrame:
    """A response's frames (event and data lines, parted by empty lines) folded to one usage: the most of each count."""
    frames = rows.select(key, F.explode(F.split(body, r"\r?\n\r?\n")).alias("frame"))
    data = F.array_join(F.regexp_extract_all("frame", F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    f = frames.select(key, F.from_json(data, FRAME).alias("f")).where("f is not null")
    return f.groupBy(key).agg(
        F.max(zero("f.message.usage.input_tokens")).alias("input_tok"), F.max(zero("f.message.usage.cache_read_input_tokens")).alias("cache_read"), F.max(F.greatest(zero("f.usage.output_tokens"), zero("f.message.usage.output_tokens"))).alias("output_tok"), F.count("*").alias("frames")
    )


def rollouts(lines: DataFrame, session: str = "session", ordinal: str = "ordinal") -> DataFrame:
    """Calls of rollout lines (session, ordinal, value). Counters only grow; a session in which one falls is left out."""
    t = "r.payload.info.total_token_usage"
    c = lines.select(session, ordinal, F.from_json("value", ROLLOUT).alias("r")).where(f"r.type = 'token_count' and {t} is not null")
    w = Window.partitionBy(session).orderBy(ordinal)
    step = lambda f: zero(f"{t}.{f}") - F.coalesce(F.lag(zero(f"{t}.{f}")).over(w), F.lit(0))
    d = c.select(session, ordinal, step("input_tokens").alias("all_in"), step("cached_input_tokens").alias("cache_read"), step("output_tokens").alias("output_tok"))
    falls = F.bool_or((F.col("all_in") < 0) | (F.col("cache_read") < 0) | (F.col("output_tok") < 0) | (F.col("cache_read") > F.col("all_in"))).over(Window.partitionBy(session))
    return d.withColumn("falls", falls).where("not falls").select(session, ordinal, (F.col("all_in") - F.col("cache_read")).alias("input_tok"), "cache_read", "output_tok")


def daily_buckets(pages: DataFrame, now: str, value: str = "value") -> DataFrame:
    """Settled days of a usage report's pages: one row per day and model."""
    d = pages.select(F.explode(F.from_json(value, BUCKETS)["data"]).alias("d")).select(F.to_date("d.starting_at").alias("day"), F.explode("d.results").alias("r"))
    settled = d.where(F.date_add("day", 2).cast("timestamp_ntz") <= F.lit(now).cast("timestamp_ntz"))
    return settled.groupBy("day", F.col("r.model").alias("model")).agg(F.sum(zero("r.uncached_input_tokens")).alias("input_tok"), F.sum(zero("r.output_tokens")).alias("output_tok"), F.sum(zero("r.cache_read_input_tokens")).alias("cache_read"))


def billing_totals(lines: DataFrame, keys: list[str], dollars: str) -> DataFrame:
    """Billing lines of dollars summed in micro-dollars, each line rounded once, halves to even."""
    return lines.groupBy(*keys).agg(F.sum(F.rint(F.col(dollars) * 1e6).cast("long")).alias("total"))

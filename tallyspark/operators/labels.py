"""Measures under small groups, kept folds, closing of months, and what is disclosed about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.operators.scores import K


def census(rows: DataFrame, has: str, k: int = K) -> DataFrame:
    """By label, distinct people and how many of them carry a measure, and whether both sides are k or more."""
    n = rows.groupBy("label").agg(F.countDistinct("developer").alias("people"), F.countDistinct(F.when(F.col(has), F.col("developer"))).alias("carriers"))
    return n.withColumn("clears", (F.col("carriers") >= k) & (F.col("people") - F.col("carriers") >= k))


def prefolded(rows: DataFrame) -> DataFrame:
    """By label, sums and the set of people, to be kept and folded again. A label's people are some thousands at most."""
    return rows.groupBy("label").agg(F.sum("cost_micro").alias("cost_micro"), F.array_sort(F.collect_set("developer")).alias("people"))


def refolded(kept: DataFrame) -> DataFrame:
    """A26/U-4: folds kept earlier, summed, with the union of their people."""
    return kept.groupBy("label").agg(F.sum("cost_micro").alias("cost_micro"), F.size(F.array_distinct(F.flatten(F.collect_list("people")))).alias("people"))


def levers(events: DataFrame, k: int = K) -> DataFrame:
    """The cache-read share of a label, only where k of its people read from a cache and k don't; else null."""
    person = events.groupBy("label", "developer").agg(F.bool_or(F.col("cache_read") > 0).alias("reads"), F.sum("cache_read").alias("r"), F.sum(F.col("input_tok") + F.col("cache_read")).alias("t"))
    n = person.groupBy("label").agg(F.count(F.when(F.col("reads"), 1)).alias("carriers"), F.count(F.when(~F.col("reads"), 1)).alias("others"), F.sum("r").alias("r"), F.sum("t").alias("t"))
    return n.select("label", "carriers", "others", F.when((F.col("carriers") >= k) & (F.col("others") >= k), F.col("r") / F.col("t")).alias("read_share"))


def placements(assignments: DataFrame) -> DataFrame:
    """Dated placements from assignments (developer, team, at): a move closes the open row, the same team changes nothing."""
    w = Window.partitionBy("developer").orderBy("at")
    moves = assignments.withColumn("was", F.lag("team").over(w)).where(F.col("was").isNull() | (F.col("was") != F.col("team")))
    return moves.select("developer", "team", F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to"))


def sealable(months: DataFrame, coverage: DataFrame, now: str, grace_days: int = 14) -> DataFrame:
    """Months (period, ends) that may be closed: the grace has passed, every source is settled beyond the end, and no
    earlier month is still open."""
    settled = coverage.agg(F.min("settled_through").alias("settled")).first().settled  # one value
    at = F.lit(now).cast("timestamp_ntz")
    open_ = months.withColumn("ok", (F.col("ends") + F.expr(f"INTERVAL {grace_days} DAYS") <= at) & F.coalesce(F.lit(settled) >= F.col("ends"), F.lit(False)))
    return open_.withColumn("before", F.min(F.col("ok").cast("int")).over(Window.orderBy("period"))).where("before = 1").select("period", "ends")


def verified(stored: DataFrame, again: DataFrame, key: list[str], measures: list[str]) -> DataFrame:
    """Keys whose measures aren't the same in two results, with what each has; no row means equal."""
    a = stored.select(*key, F.struct(*measures).alias("stored"))
    b = again.select(*key, F.struct(*measures).alias("again"))
    return a.join(b, key, "full_outer").where(~F.col("stored").eqNullSafe(F.col("again")))

"""Files in and out: hierarchies, prices, exports and the event table."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.ledgers import safe_cell
from tallyspark.operators.pricing import Rate, price_table

HIERARCHY = ("developer", "team", "division", "org")


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with the header developer,team,division,org, taken whole or not at all.

    Fails on another header, a broken line, a developer that is empty or named twice.
    """
    found = tuple(spark.read.option("header", True).csv(path).columns)
    if found != HIERARCHY:
        raise ValueError(f"the header is {','.join(found)}")
    rows = spark.read.schema(", ".join(f"{c} string" for c in HIERARCHY)).option("header", True).option("mode", "FAILFAST").csv(path)
    bad = rows.groupBy("developer").count().where("developer is null or trim(developer) = '' or count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"developers that are empty or named twice: {[r.developer for r in bad]}")
    return rows


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A price file as JSON, {"version", "models": {key: {field: value}}}; unknown fields fail. The file is small."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    known = {f.name for f in fields(Rate)}
    models = json.loads(text)["models"]
    if odd := {k for m in models.values() for k in m} - known:
        raise ValueError(f"unknown fields: {sorted(odd)}")
    return price_table(spark, tuple(Rate(key=k, **m) for k, m in sorted(models.items())))


def write_events(events: DataFrame, path: str) -> None:
    """K1: events by month. A month that is written again is replaced; others stay."""
    by_month = events.withColumn("month", F.date_format("ts", "yyyy-MM"))
    by_month.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """K2: rows as CSV, in which no cell of text is taken for a formula."""
    df.select(*(safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes)).write.mode("overwrite").option("header", True).csv(path)

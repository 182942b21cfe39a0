"""What is stored of a person: everything that names them given out, or taken away, with what other rows say of them blanked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.scalars import person_key
from tallyspark.sources.shared import written


@dataclass(frozen=True)
class Stored:
    """A table. Rows whose owner is the subject go; in others, each of blanks (a column that may name a person -> the columns
    that are blanked with it, itself among them) is blanked where it names the subject."""

    rows: DataFrame
    owner: str | None = None
    blanks: tuple[tuple[str, tuple[str, ...]], ...] = ()


def identities(aliases: DataFrame, subject: str) -> list[str]:
    """A person's ids: the one given, and all that aliases (alias, canonical) join it with, over any number of links. They are a few."""
    ids = {subject}
    while True:
        near = aliases.where(F.col("alias").isin(*ids) | F.col("canonical").isin(*ids)).select("alias", "canonical").collect()
        more = ids | {x for r in near for x in r if x is not None}
        if more == ids:
            return sorted(ids)
        ids = more


def _names(ids: list[str], column: str):  # noqa: ANN202
    return F.coalesce(F.col(column).isin(*ids), F.lit(False))


def given_out(tables: dict[str, Stored], ids: list[str]) -> dict[str, DataFrame]:
    """Of each table the rows that are the subject's own or name them."""
    out = {}
    for name, t in tables.items():
        hit = F.lit(False)
        for c in ([t.owner] if t.owner else []) + [c for c, _ in t.blanks]:
            hit = hit | _names(ids, c)
        out[name] = t.rows.where(hit)
    return out


def taken_away(tables: dict[str, Stored], ids: list[str]) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The tables without the subject, written, and how many rows of each were taken or blanked. A second time there are none."""
    out, counts = {}, {}
    for name, found in given_out(tables, ids).items():
        t = tables[name]
        counts[name] = found.count()
        kept = t.rows.where(~_names(ids, t.owner)) if t.owner else t.rows
        blank = {}
        for c, with_it in t.blanks:
            for x in with_it:
                blank[x] = blank.get(x, F.lit(False)) | _names(ids, c)
        out[name] = written(kept.select(*(F.when(~blank[c], F.col(c)).alias(c) if c in blank else c for c in kept.columns)), f"without-{name}")
    return out, counts


def tombstones(persons: DataFrame, ids: list[str], secret: bytes) -> tuple[DataFrame, int]:
    """Sealed keys (period_size, starts, label, person_key, tombstoned) with those of the subject replaced by random ones, so that
    no sealed sum changes and no key leads to them any more; and how many. It is written, since the new keys must stay what they are."""
    own = F.lit(False)
    for size in [r[0] for r in persons.select("period_size").distinct().collect()]:  # month and quarter
        for i in ids:
            own = own | ((F.col("period_size") == size) & (F.col("person_key") == person_key(secret, size, F.col("starts"), F.lit(i))))
    hit = own & ~F.col("tombstoned")
    new = persons.withColumn("hit", hit).withColumn("person_key", F.when(F.col("hit"), F.sha2(F.concat(F.expr("uuid()"), F.expr("uuid()")), 256)).otherwise(F.col("person_key"))).withColumn("tombstoned", F.col("tombstoned") | F.col("hit"))
    done = written(new, "persons")
    return done.drop("hit"), done.where("hit").count()


def erase_partitions(spark: SparkSession, path: str, partition: str, owner: str, ids: list[str]) -> list[str]:
    """A Parquet table at path, partitioned by a column, without the subject's rows: only the partitions that hold some are written
    again. What is kept of them is written apart first, so a run that is broken off can be run again."""
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    value = F.col(partition).cast("string")
    touched = [r[0] for r in rows.where(_names(ids, owner)).select(value).distinct().collect()]
    if not touched:
        return []
    kept = written(rows.where(value.isin(*touched) & ~_names(ids, owner)), "kept")
    left = {r[0] for r in kept.select(value).distinct().collect()}
    if left:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    jvm = spark.sparkContext._jvm
    for empty in set(touched) - left:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={empty}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return sorted(touched)

"""Keyed state: merges by idempotency key, first writers, deltas against what is posted, pages and digests."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.scalars import length_prefixed

VECTOR = ("input_tok", "output_tok", "cache_read", "cache_write_5m", "cache_write_1h")


def upserted(rows: DataFrame) -> DataFrame:
    """Rows (key, developer, ingest, VECTOR) folded by key in order of ingest, ties by the row.

    The first row stands until a later one of the same developer is nowhere less and somewhere more; a row of another
    developer, or one that is more here and less there, is a conflict; others change nothing. A key's rows are
    observations of one call, so they are few, and the fold is a column expression.
    """
    seen = F.array_sort(F.collect_list(F.struct("ingest", *VECTOR, "developer")))
    zero = F.lit(0)
    start = F.struct(*(F.get(F.col("seen"), zero)[c].alias(c) for c in ("developer", *VECTOR)), zero.alias("replaced"), zero.alias("conflicts"))

    def step(held: Column, row: Column) -> Column:
        up, down = (functools.reduce(lambda a, b: a | b, [f(row[c], held[c]) for c in VECTOR]) for f in (operator.gt, operator.lt))
        same = row["developer"] == held["developer"]
        wins, clash = same & up & ~down, ~same | up & down
        new = [F.when(wins, row[c]).otherwise(held[c]).alias(c) for c in ("developer", *VECTOR)]
        return F.struct(*new, (held["replaced"] + wins.cast("int")).alias("replaced"), (held["conflicts"] + clash.cast("int")).alias("conflicts"))

    folded = F.aggregate(F.slice("seen", 2, F.greatest(F.size("seen") - 1, F.lit(1))), start, step)
    return rows.groupBy("key").agg(seen.alias("seen")).select("key", folded.alias("x")).select("key", "x.*")


def first_writer(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with one key, the first in order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rank = 1").drop("rank")


def delta_to_post(totals: DataFrame, posted: DataFrame, key: list[str]) -> DataFrame:
    """What must be posted so that postings sum to the new totals; nothing where they do."""
    p = posted.groupBy(*key).agg(F.sum("amount").alias("posted"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return totals.join(p, key, "full_outer").select(*key, (zero("total") - zero("posted")).alias("delta")).where("delta != 0")


def page(df: DataFrame, limit: int, after: tuple | None = None, columns: tuple[str, str] = ("ts", "id")) -> DataFrame:
    """K2/O3: up to limit rows after a cursor in the order of two columns; more tells whether others follow."""
    ts, key = columns
    if after:
        at = F.lit(after[0]).cast("timestamp_ntz")
        df = df.where((F.col(ts) > at) | (F.col(ts) == at) & (F.col(key) > after[1]))
    top = df.orderBy(ts, key).limit(limit + 1)
    w = Window.orderBy(ts, key)  # over the page's rows only
    return top.withColumns({"place": F.row_number().over(w), "more": F.count("*").over(Window.partitionBy()) > limit}).where(F.col("place") <= limit).drop("place")


def places(rows: DataFrame, ts: str, key: str) -> DataFrame:
    """Every row with its day and its place, from 1, in the order of two columns: the place in its day, and the rows
    of the days before, which are counted first. Only the table of days, a row a day, is in one order."""
    dated = rows.withColumn("day", F.to_date(ts))
    counts = dated.groupBy("day").agg(F.count("*").alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = dated.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(ts, key)))
    return inside.join(earlier, "day").withColumn("place", (F.col("place") + F.col("earlier")).cast("long")).drop("earlier")


def safe_cell(value: Column) -> Column:
    """K2: a CSV cell that no spreadsheet takes for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def day_digests(events: DataFrame, columns: list[str]) -> DataFrame:
    """Per day, rows and a digest of all of them in any order: the sums of the four parts of each row's SHA-256.

    A digest over one global order would need one task; sums of hashes are merged in every partition.
    """
    return digests(events.withColumn("day", F.to_date("ts")), ["day"], columns)


def digests(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """By groups, n and h0 to h3: any row that changes, comes or goes changes the sums.

    A row's hash is made once, ahead of the sums; its parts have six bytes, so that a sum of 32,000 of them fits a long.
    """
    hashed = rows.select(*by, length_prefixed(*(F.col(c) for c in columns)).alias("h"))
    parts = hashed.select(*by, *(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("long").alias(f"h{k}") for k in range(4)))
    return parts.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col(f"h{k}").cast("decimal(18,0)")).cast("string").alias(f"h{k}") for k in range(4)))


def repair_spend(events: DataFrame, children: DataFrame) -> DataFrame:
    """Events of a child's developer in its repository, with kind: pull-request where the event's pull request is the
    child's, and issue where the event has none and the issue is the child's. children: developer, repo, pr_number, issue_id."""
    at = ["developer", "repo"]
    by_pull = children.where("pr_number is not null").select(*at, "pr_number").distinct()
    by_issue = children.where("issue_id != ''").select(*at, "issue_id").distinct()
    with_pull = events.where("pr_number is not null").join(by_pull, [*at, "pr_number"], "left_semi")
    without = events.where("pr_number is null").join(by_issue, [*at, "issue_id"], "left_semi")
    kind = lambda df, name: df.select("cost_micro", F.lit(name).alias("kind"))
    return kind(with_pull, "pull-request").unionByName(kind(without, "issue"))

"""Aggregates over what lies within a span of time of a row, without pairs."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.scalars import micros

COMBINED = {"min": F.least, "max": F.greatest, "sum": lambda *parts: functools.reduce(operator.add, (F.coalesce(p, F.lit(0)) for p in parts))}


def within(probes: DataFrame, facts: DataFrame, key: list[str], at: str, width: int, how: dict[str, str], ahead: bool = False) -> DataFrame:
    """Probes with aggregates (min, max or sum of columns of facts) over the facts of their key from width microseconds
    before their time, and up to it, or as long after it if ahead; both ends in. A null key or time finds nothing.

    Time is cut into bins as wide as the span. What a probe wants of its own bin and of the neighbours, whose facts are
    moved into it, is then the head, the tail or all of one sorted bin: no pair is made, no frame slides, and a hot key
    is as many groups as it has bins.
    """
    names = probes.columns
    time = micros(at)
    moves = [0, width, -width] if ahead else [0, width]
    given = facts.dropna(subset=[*key, at]).select(*key, time.alias("t"), *how)
    moved = given.select(*key, F.explode(F.array(*map(F.lit, moves))).alias("move"), "t", *how).withColumn("t", F.col("t") + F.col("move"))
    asked = probes.select(*key, time.alias("t"), F.struct(*names).alias("row"))
    both = asked.unionByName(moved, allowMissingColumns=True).withColumn("bin", F.floor(F.col("t") / width))
    bins = Window.partitionBy(*key, "bin")
    up, down = (bins.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("t"), F.desc("t")))
    frames = {0: bins, width: down, -width: up} if ahead else {0: up, width: down}

    def part(name: str, move: int) -> Column:
        value = F.when(F.col("move") == move, F.col(name))
        return {"min": F.min, "max": F.max, "sum": F.sum}[how[name]](value).over(frames[move])

    got = both.withColumns({f"{name}_{i}": part(name, move) for name in how for i, move in enumerate(moves)}).where("row is not null")
    return got.select("row.*", *(COMBINED[how[n]](*(F.col(f"{n}_{i}") for i in range(len(moves)))).alias(n) for n in how))

"""Which repository a working folder belongs to: folders meet roots on equal keys, by the folders that they lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.shared import written


def cleaned(path: Column) -> Column:
    """An absolute path without empty parts, dots, and what two dots take back; null for any other path."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(kept, "/")))


def holders(path: Column) -> Column:
    """A clean path and all folders that it lies in, from the root on."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def roots_of(paths: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """paths (distinct, clean) with root and main of the innermost root that each lies in; null in none.

    roots: root, main (the repository that a linked work folder belongs to; the root itself for a repository).
    """
    up = paths.select(column, F.explode(holders(F.col(column))).alias("root"))
    found = up.join(roots.select("root", "main"), "root").groupBy(column).agg(F.max_by(F.struct("root", "main"), F.length("root")).alias("r"))
    return paths.join(found, column, "left").select(column, "r.root", "r.main")


def scoped(folders: DataFrame, targets: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct folders (cwd) with scope and target: direct, worktree or foreign.

    targets: target, place. A folder in a target is direct, unless it lies in a repository of its own inside the target's repository. A
    folder elsewhere whose linked repository lies in a target is a worktree. The first target by place counts, direct ones before
    worktrees. Tables may be of any size: a folder makes as many rows as it is deep. Folders that are no absolute paths are foreign.
    """
    d = folders.select("cwd").distinct().withColumn("path", cleaned(F.col("cwd")))
    r = roots.select(cleaned(F.col("root")).alias("root"), cleaned(F.col("main")).alias("main"))
    t = targets.select(cleaned(F.col("target")).alias("path"), "target", "place")
    at = written(roots_of(d.select("path").distinct(), "path", r), "scopes").withColumnRenamed("main", "own")
    t = t.join(roots_of(t.select("path").distinct(), "path", r).select("path", F.col("main").alias("t_root")), "path").withColumnRenamed("path", "t_path")
    inside = at.select("path", "own", F.explode(holders(F.col("path"))).alias("t_path")).join(t, "t_path")
    nested = F.col("t_root").isNotNull() & F.col("own").isNotNull() & (F.col("own") != F.col("t_root")) & (F.when(F.col("t_root") == "/", F.lit(True)).otherwise(F.col("own").startswith(F.concat("t_root", F.lit("/")))))
    direct = inside.where(~nested).select("path", F.struct(F.lit(0).alias("rank"), "place", "target").alias("found"))
    linked = at.where("own is not null").select("path", F.explode(holders(F.col("own"))).alias("t_path")).join(t, "t_path").join(inside.select("path", "t_path").distinct(), ["path", "t_path"], "left_anti")
    worktree = linked.select("path", F.struct(F.lit(1).alias("rank"), "place", "target").alias("found"))
    best = direct.unionByName(worktree).groupBy("path").agg(F.min("found").alias("found"))
    scope = F.when(F.col("found.rank") == 0, F.lit("direct")).when(F.col("found.rank") == 1, F.lit("worktree")).otherwise(F.lit("foreign"))
    return d.join(best, "path", "left").select("cwd", scope.alias("scope"), "found.target")

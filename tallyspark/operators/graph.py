"""Connected parts of relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.shared import written


def components(edges: DataFrame) -> DataFrame:
    """G1/U-5: id and root, the least id that an edge a-b in either direction leads to, for every node of edges.

    Each round joins every node to the least label near it and then to that label's own label, so paths halve; it ends
    when no label changes. Rounds are written, so a lost executor costs one round.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    label = written(edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct().withColumn("root", F.col("id")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        low = label.join(near, label["id"] == near["a"], "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("low"))
        jumped = low.join(label.select(F.col("id").alias("low"), F.col("root").alias("further")), "low").select("id", F.col("root").alias("was"), F.least("low", "further").alias("root"))
        new = written(jumped, "labels")
        label = new.select("id", "root")
        if new.where("root != was").isEmpty():
            return label

"""Centroid clustering by plain Lloyd rounds, in whole numbers from end to end.

The centroids are broadcast with each round's function. ``mapInPandas`` takes squared differences of a batch to one centroid
after another in NumPy, the lowest index winning a tie, and adds up each cluster's vectors; a partition gives one row for
a component of a centroid at most, and these rows are merged by ``groupBy``. Only the merged rows, clusters x components of
them, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import LONG, fits, floored, table, to_long, written

SUMS = "cluster int, at int, total decimal(38,0), n long"


def kept(vectors: pd.Series, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have so many components, all of them finite, and these vectors in whole numbers."""
    at = np.flatnonzero([v is not None and len(v) == width for v in vectors])
    if not len(at) or not width:
        return at, np.zeros((len(at), width), np.int64)
    x = np.stack(vectors.to_numpy()[at]).astype(np.float64)  # a null among floats has become NaN
    good = np.isfinite(x).all(axis=1)
    return at[good], floored(x[good], scale)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the lowest index among equals, and its squared distance."""
    if not fits(x, centroids):
        x, centroids = x.astype(object), centroids.astype(object)
    label, best = np.zeros(len(x), np.int64), None
    for k, c in enumerate(centroids):
        d = x - c
        d = np.einsum("ij,ij->i", d, d) if d.dtype != object else (d * d).sum(axis=1)
        if best is None:
            best = d
        else:
            closer = d < best
            label[closer], best = k, np.where(closer, d, best)
    return label, best


def sums(x: np.ndarray, label: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Componentwise sums of the rows of each label, and how many rows it has."""
    total = np.zeros((count, x.shape[1]), object if np.abs(x.astype(float)).max(initial=0) * max(len(x), 1) >= 2.0**62 else np.int64)
    order = np.argsort(label, kind="stable")
    found, first = np.unique(label[order], return_index=True)
    if len(found):
        total[found] = np.add.reduceat(x[order].astype(total.dtype), first, axis=0)
    return total, np.bincount(label, minlength=count)


def lloyd(vectors: DataFrame, clusters: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """A written table vec_id, cluster, distance (squared) with a row for every kept vector; and the final centroids.

    Kept are vectors of exactly ``width`` components, none of them null or non-finite; a component x counts as floor(scale x),
    within the range of a long. Centroids start as the kept vectors with the least sha256 of ``1:<id>``, equal ids by their
    components; a row that repeats another is a vector of its own, and rows without an id start a centroid last and are
    assigned like others. Where there are fewer vectors than clusters, there are as many centroids as vectors; an empty table
    gives none. Sums are exact whatever their size; a distance past a long is cut to its range. Other columns are ignored.
    """
    spark = vectors.sparkSession
    pair = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, x = kept(b.v, width, scale)
            if len(at):
                yield pd.DataFrame({"hash": b.hash.iloc[at].to_numpy(), "x": list(x)})

    hashed = pair.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    first = hashed.mapInPandas(starts, "hash string, x array<long>").orderBy(F.asc_nulls_last("hash"), "x").limit(clusters).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(len(first), width)
    shape = "vec_id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], shape), []

    for _ in range(rounds):

        def added(batches: Iterator[pd.DataFrame], centroids: np.ndarray = centroids) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
            for b in batches:
                _, x = kept(b.v, width, scale)
                more = sums(x, nearest(x, centroids)[0], len(centroids))
                total, n = total + more[0], n + more[1]
            k, at = np.nonzero(np.broadcast_to(n[:, None] > 0, total.shape))
            yield pd.DataFrame({"cluster": k, "at": at, "total": [Decimal(int(t)) for t in total[k, at]], "n": n[k]})

        merged = pair.select("v").mapInPandas(added, SUMS).groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in merged.collect():
            centroids[r.cluster, r.at] = int(r.total) // r.n

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, x = kept(b.v, width, scale)
            label, distance = nearest(x, centroids)
            yield pd.DataFrame({"vec_id": b.vec_id.iloc[at].astype("Int64"), "cluster": label, "distance": to_long(distance)})

    return written(pair.mapInPandas(assigned, shape), "clusters"), centroids.tolist()


def clustered(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that lloyd(**settings) keeps.

    Inertias are sums of squared distances over a cluster and over all; they are cut to the range of a long.
    """
    spark = vectors.sparkSession
    rows, centroids = lloyd(vectors, **settings)
    by_cluster = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = min(sum(by_cluster.values()), LONG)
    facts = [(k, min(by_cluster.get(k, 0), LONG), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # as many rows as centroids
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 3) -> str:
    nearest_to = lambda c: f"""SELECT vec_id, rid, e, k, d FROM (SELECT v.*, c.k, dist.d, row_number() OVER (PARTITION BY v.rid ORDER BY dist.d, c.k) AS place
      FROM v CROSS JOIN {c} c, LATERAL (SELECT list_sum(list_transform(list_zip(v.e, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) dist) WHERE place = 1"""  # noqa: E731
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest_to(f'c{r}')})")
        steps.append(f"""u{r} AS MATERIALIZED (SELECT k, list((t - ((t % n) + n) % n) // n ORDER BY p) AS c FROM (
      SELECT k, p, sum(e[p])::HUGEINT AS t, count(*)::HUGEINT AS n FROM a{r}, range(1, 65) g(p) GROUP BY 1, 2) GROUP BY 1)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(u.c::BIGINT[], c.c) AS c FROM c{r} c LEFT JOIN u{r} u USING (k))")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS k, e AS c FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v ORDER BY h NULLS LAST, e LIMIT 16)),
{", ".join(steps)},
f AS MATERIALIZED ({nearest_to(f"c{rounds}")})
SELECT vec_id, f.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY f.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} c USING (k)
"""


OP11_SQL = _sql()

"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt to blocks that meet chunks of queries, so tasks stay of one size. In a block, vectors are sorted by norm
and cut into tiles; each tile keeps one list per dimension, sorted by component. A query walks a tile's lists in the
direction of its own sign, all dimensions in step, scores every vector it meets, and stops when the best score that an
unseen vector could have is under its kth result, which it carries from tile to tile; a tile whose first entries are
already under it isn't walked at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import table

#: Beyond this a product of float64 integers may round, and Python's integers are used.
EXACT = 2.0**52
LONG = (1 << 63) - 1


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(256 x) of rows of a list column, as float64; shorter vectors are filled up with zeros."""
    lists = vectors.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    columns = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, columns] = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of x with q, within the range of a long."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(len(q), 1) < EXACT:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x]
    return np.array([min(max(s, -LONG - 1), LONG) for s in exact], np.int64)


def threshold_top(x: np.ndarray, ids: np.ndarray, up: np.ndarray, down: np.ndarray, q: np.ndarray, own: int, k: int, first: int = 16, kth: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers and scores of the k best rows for q without those of its own id, ties to smaller ids; and the depth reached.

    up[d] are the rows by component d, the smallest first, and down[d] the largest first. Each round walks as deep again as
    all before; once half of the rows are scored, all others are. kth is the score of a kth result found elsewhere: rows
    under it may be left out. A tie with the kth result doesn't stop the walk, since an unseen vector may have the smaller id.
    """
    n, width = x.shape
    exact = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(width, 1) < EXACT
    rising = q > 0
    seen, closed = np.zeros(n, bool), ids == own
    best, scores, depth, met = np.zeros(0, int), np.zeros(0, np.int64), 0, 0

    def beyond(at: int) -> bool:
        """Whether no row from this depth on can be among the k best."""
        least = scores[-1] if len(scores) == k else None
        least = kth if least is None or kth is not None and kth > least else least
        edge = np.where(rising, down[:, at], up[:, at])
        return exact and least is not None and (x[edge, np.arange(width)] * q).sum() < least

    while depth < n and not beyond(max(depth - 1, 0)):
        deeper = min(n, max(first, 2 * depth)) if q.any() and width and 2 * met <= n else n
        fresh = np.zeros(n, bool)
        if deeper == n:
            fresh[:] = True
        else:
            fresh[up[~rising, depth:deeper].ravel()] = True
            fresh[down[rising, depth:deeper].ravel()] = True
        depth = deeper
        new = np.flatnonzero(fresh & ~seen & ~closed)
        seen |= fresh
        met = int(seen.sum())
        got = products(x, q)[new] if exact and 2 * len(new) > n else products(x[new], q)
        best, scores = np.concatenate([best, new]), np.concatenate([scores, got])
        if len(scores) > k:
            good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            best, scores = best[good], scores[good]
        order = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[order], scores[order]
    return best, scores, depth


def search_block(m: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: list[int], k: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """query, id and score of the k best rows of a block for each of queries, and how many tiles were walked."""
    order = np.argsort(-(m * m).sum(axis=1), kind="stable")
    m, ids = m[order], ids[order]
    tops = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
    walked = 0
    for a in range(0, len(m), tile):
        x, these = m[a : a + tile], ids[a : a + tile]
        up = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
        down = np.ascontiguousarray(up[:, ::-1])
        for j, (one, q) in enumerate(zip(own, queries, strict=True)):
            held, scores = tops[j]
            best, more, depth = threshold_top(x, these, up, down, q, one, k, kth=int(scores[-1]) if len(scores) == k else None)
            walked += depth > 0
            if len(best):
                held, scores = np.concatenate([held, these[best]]), np.concatenate([scores, more])
                first = np.lexsort((held, -scores))[:k]
                tops[j] = held[first], scores[first]
    join = lambda xs: np.concatenate([*xs, np.zeros(0, np.int64)]).astype(np.int64)
    return join([np.full(len(t[0]), one) for one, t in zip(own, tops, strict=True)]), join([t[0] for t in tops]), join([t[1] for t in tops]), walked


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 16_384, chunk: int = 16_384, tile: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of vectors for each of queries, which have the same columns.

    Components count as floor(256 x). A query's candidates are all rows with another id; all of them are returned if
    they are fewer than k. Vectors that are null, or hold null or non-finite components, take no part; vectors of
    unequal lengths are filled up with zeros. Rows that repeat an id are candidates each, and so are they for each row
    that repeats a query. Empty tables give none; other columns are ignored. Scores are exact; those beyond a long are cut to its range.

    A vector is copied once for each chunk of queries and a query once for each block of vectors; both hold some MB.
    """

    def valid(df: DataFrame) -> DataFrame:
        finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(F.col(vec_col).isNotNull() & finite & F.col(id_col).isNotNull())

    rows, asked = valid(vectors), valid(queries)
    count = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    many = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    blocks, chunks, width = max(1, -(-count.n // block)), max(1, -(-many.n // chunk)), max(count.w or 0, many.w or 0)
    spread = lambda df, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")))
    cell = F.xxhash64("block", "chunk").alias("cell")
    left = spread(rows, "block", blocks, "chunk", chunks).select(cell, "id", "v")
    right = spread(asked, "chunk", chunks, "block", blocks).select(cell, "id", "v")

    def search(x: pa.Table, q: pa.Table) -> pa.Table:
        a = b = c = np.zeros(0, np.int64)
        if len(x) and len(q):
            a, b, c, _ = search_block(matrix(x.column("v"), width), x.column("id").to_numpy(), matrix(q.column("v"), width), q.column("id").to_pylist(), k, tile)
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

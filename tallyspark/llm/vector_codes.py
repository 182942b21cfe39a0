"""Vector code compression: each of four parts of a vector becomes the index of its nearest codebook entry.

Codebooks are whole numbers, broadcast with each round's function. Arrow batches take the distances of a part to all entries at
once, by |x|^2 - 2 x.c + |c|^2 with int64 matrix products, and the first least of them. A partition adds up the parts of each
entry; the sums are merged by a grouped shuffle, and 256 x components merged rows come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.centroids import sums
from tallyspark.llm.common import LONG, fits, floored, looked_up, table, to_long, written

#: Rows whose distances to all entries are held at a time.
ROWS = 2048


def whole_vectors(lists: pa.ListArray, width: int | None, scale: int) -> tuple[np.ndarray, np.ndarray | list[np.ndarray]]:
    """Places of the vectors that are not null and hold finite numbers only, and their floor(scale x).

    With a width they are the rows of a matrix, shorter ones filled up with zeros; without one, arrays as long as they are.
    """
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(there, np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
    end = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # a null among numbers has become NaN
    good = np.flatnonzero(there & (bad[end] == bad[end - size]))
    values = floored(np.where(np.isfinite(values), values, 0), scale)
    if width is None:
        return good, [values[end[i] - size[i] : end[i]] for i in good]
    out, row = np.zeros((len(good), width), np.int64), np.repeat(np.arange(len(good)), size[good])
    column = np.arange(len(row)) - np.repeat(np.cumsum(size[good]) - size[good], size[good])
    out[row, column] = values[np.repeat(end[good] - size[good], size[good]) + column]
    return good, out


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first of the nearest entries of a codebook, and the squared distance to it."""
    if not fits(x, book):
        x, book = x.astype(object), book.astype(object)
    entries, norms = np.ascontiguousarray(book.T), (book * book).sum(axis=1)
    codes, error = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    for a in range(0, len(x), ROWS):
        b = x[a : a + ROWS]
        product = np.einsum("ij,jk->ik", b, entries) if x.dtype != object else b.dot(entries)
        beyond = norms - 2 * product  # the distances without |x|^2, which all entries share
        codes[a : a + ROWS] = first = beyond.argmin(axis=1)
        error[a : a + ROWS] = beyond[np.arange(len(b)), first] + (b * b).sum(axis=1)
    return codes, error


def codebooks(vectors: DataFrame, entries: int = 256, rounds: int = 4, parts: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Codebooks [part, entry, component], trained on all kept vectors from those with the smallest ids.

    They hold entries x width whole numbers, the width being that of the longest vector, filled up to a multiple of parts.
    """
    pair = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, x = whole_vectors(b.column(1), None, scale)
            yield pa.record_batch({"vec_id": b.column(0).take(good), "x": pa.array(x, pa.list_(pa.int64()))})

    clean = pair.mapInArrow(firsts, "vec_id long, x array<long>")
    first = clean.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    width = clean.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-width // parts) * parts
    books = np.zeros((len(first), width), np.int64)
    for row, r in zip(books, first, strict=True):
        row[: len(r.x)] = r.x
    books = np.ascontiguousarray(books.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    if not books.size:
        return books

    for _ in range(rounds):

        def added(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
            for b in batches:
                _, x = whole_vectors(b.column(0), width, scale)
                for p, (piece, book) in enumerate(zip(np.split(x, parts, axis=1), books, strict=True)):
                    more, count = sums(piece, nearest_entries(piece, book)[0], len(book))
                    total[p] += more
                    n[p] += count
            p, e, at = np.nonzero(np.broadcast_to(n[:, :, None] > 0, books.shape))
            yield pa.record_batch({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "at": pa.array(at, pa.int32()), "total": pa.array([Decimal(int(t)) for t in total[p, e, at]], pa.decimal128(38, 0)), "n": pa.array(n[p, e], pa.int64())})

        merged = pair.select("v").mapInArrow(added, "part int, entry int, at int, total decimal(38,0), n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in merged.collect():
            books[r.part, r.entry, r.at] = int(r.total) // r.n
    return books


def coded(vectors: DataFrame, books: np.ndarray, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code and error of every kept vector by given codebooks; code has two hex digits for each part."""
    parts, width = books.shape[0], books.shape[0] * books.shape[2]
    label = vectors.schema[label_col].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, x = whole_vectors(b.column(2), width, scale)
            found = [nearest_entries(piece, book) for piece, book in zip(np.split(x, parts, axis=1), books, strict=True)]
            digits = np.stack([c for c, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            error = to_long(sum(e.astype(object) if e.dtype != object and parts * float(e.max(initial=0)) >= 2.0**62 else e for _, e in found))
            yield pa.record_batch({"vec_id": b.column(0).take(good), "label": b.column(1).take(good), "code": pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()), "error": pa.array(error, pa.int64())})

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(code, f"vec_id long, label {label}, code string, error long")


def decoded(codes: DataFrame, books: np.ndarray, scale: int = 1024, code_col: str = "code") -> DataFrame:
    """codes with a column vector: the numbers that their codes stand for, each in the middle of its step."""
    parts = books.shape[0]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            at = np.frombuffer(bytes.fromhex("".join(b.column(code_col).to_pylist())), np.uint8).reshape(n, parts)
            v = np.concatenate([books[p][at[:, p]] for p in range(parts)], axis=1)
            yield pa.record_batch([*b.columns, pa.array(list((v + 0.5) / scale), pa.list_(pa.float64()))], names=[*b.schema.names, "vector"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)
    return codes.where(F.col(code_col).isNotNull()).mapInArrow(decode, f"{shape}, vector array<double>")


def compressed(vectors: DataFrame, entries: int = 256, rounds: int = 4, parts: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that isn't null and holds finite numbers only.

    Codebooks start from the smallest ids, equal ids by their components, rows without an id last; a row that repeats another is
    a vector of its own. Vectors shorter than the longest are filled up with zeros, as is a width that the parts don't divide. Where
    there are fewer vectors than entries, there are as many entries as vectors; an empty table gives no rows. Sums are exact; an error or a sum of errors past a
    long is cut to its range. Rows without a label share one sum. Other columns are ignored.
    """
    books = codebooks(vectors, entries, rounds, parts, scale)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = written(coded(vectors, books, scale), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    by_label = written(rows.groupBy("label").agg(total.alias("label_error")), "label-errors")
    return looked_up(rows, by_label, "label", F.col("vec_id")).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int = 4) -> str:
    def nearest_to(b: str) -> str:
        square = "list_sum(list_transform(list_zip(s.e, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"SELECT rid, p, min({square}::BIGINT * 256 + b.k) AS best FROM s JOIN {b} b USING (p) GROUP BY 1, 2"

    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest_to(f'b{r}')})")
        steps.append(f"""u{r} AS MATERIALIZED (SELECT p, k, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
      SELECT p, best % 256 AS k, i, sum(e[i])::HUGEINT AS t, count(*)::HUGEINT AS n FROM a{r} JOIN s USING (rid, p), range(1, 17) g(i) GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(u.c, b.c) AS c FROM b{r} b LEFT JOIN u{r} u USING (p, k))")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS rid, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT rid, p, e[p * 16 + 1 : p * 16 + 16] AS e FROM v, range(4) g(p)),
b0 AS MATERIALIZED (SELECT p, k, c[p * 16 + 1 : p * 16 + 16] AS c FROM (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS k, e AS c FROM v QUALIFY k < 256), range(4) g(p)),
{", ".join(steps)},
f AS MATERIALIZED ({nearest_to(f"b{rounds}")}),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT rid, string_agg(lower(printf('%02x', (best % 256)::INTEGER)), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM f GROUP BY 1)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (rid), h
"""


OP12_SQL = _sql()

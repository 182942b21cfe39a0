"""Centroid clustering and vector codes against plain loops in Python's integers, and against their SQL."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from tallyspark.llm import centroids as c
from tallyspark.llm import vector_codes as v
from tests.compare import differences

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, code string, v int"
LONG = (1 << 63) - 1


def floors(vector, scale):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [min(max(math.floor(x * scale), -LONG - 1), LONG) if math.isfinite(x * scale) else (LONG if x > 0 else -LONG - 1) for x in vector]


def first_nearest(x, entries):
    d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in entries]
    return min(range(len(d)), key=lambda k: (d[k], k)), min(d)


def moved(rows, labels, entries):
    out = []
    for k, e in enumerate(entries):
        mine = [x for x, label in zip(rows, labels, strict=True) if label == k]
        out.append([sum(col) // len(mine) for col in zip(*mine, strict=True)] if mine else e)
    return out


def lloyd(rows, clusters, rounds, width):
    kept = [(i, f) for i, x in rows if x is not None and len(x) == width and (f := floors(x, 64))]
    digest = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    cents = [f for _, f in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    xs = [f for _, f in kept]
    for _ in range(rounds):
        cents = moved(xs, [first_nearest(x, cents)[0] for x in xs], cents)
    last = [first_nearest(x, cents) for x in xs]
    inertia = [sum(d for k, d in last if k == j) for j in range(len(cents))]
    cut = lambda n: min(n, LONG)
    return sorted(((i, k, cut(d), cut(inertia[k]), cut(sum(inertia)), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for (i, _), (k, d) in zip(kept, last, strict=True)), key=repr)


def odd_rows(width, seed=2):
    g = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in g.integers(-30, 31, width) / 37]) for i in range(150)]
    rows += [(200, None), (201, [None] + [1.0] * (width - 1)), (202, [float("nan")] * width), (203, [float("-inf")] * width), (None, [0.5] * width), (None, [0.25] * width)]
    rows += [(7, rows[7][1])] * 4 + [(300 + i, [0.125] * width) for i in range(40)] + [(9, [0.75] * width)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, x, None if i is None else (i * 7) % 5 or None, "clash", "clash", 1) for i, x in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("clusters", [4, 16, 500])
def test_lloyd(spark, clusters):
    rows = odd_rows(8) + [(400, []), (401, [1.0] * 7), (402, [1.0] * 9)]
    got = c.clustered(frame(spark, rows), clusters=clusters, width=8)
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(rows, clusters, 3, 8)


def test_lloyd_past_a_long(spark):
    rows = [(i, [x, -x]) for i, x in enumerate([1e300, -1e300, 2.0**55, 2.0**40, 1.0, 0.0, 3.0, 1e17])]
    got = c.clustered(frame(spark, rows), clusters=3, width=2)
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(rows, 3, 3, 2)


def test_nothing_to_cluster(spark):
    for rows in ([], [(1, None)], [(1, [1.0])]):
        assert c.clustered(frame(spark, rows), width=8).count() == 0


def test_a_very_long_vector_is_no_cluster(spark):
    rows = odd_rows(8)[:20] + [(500, [1.0] * 300_000)]
    assert sorted(map(tuple, c.clustered(frame(spark, rows), clusters=3, width=8).collect()), key=repr) == lloyd(rows, 3, 3, 8)


def compress(rows, entries, rounds=4, parts=4, scale=1024):
    kept = [(i, f, (None if i is None else (i * 7) % 5 or None)) for i, x in rows if (f := floors(x, scale)) is not None]
    width = max((len(f) for _, f, _ in kept), default=0)
    width = -(-width // parts) * parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // parts
    cut = [[(f + [0] * width)[p * w : p * w + w] for _, f, _ in kept] for p in range(parts)]
    books = [xs[:entries] for xs in cut]
    for _ in range(rounds):
        books = [moved(xs, [first_nearest(x, b)[0] for x in xs], b) for xs, b in zip(cut, books, strict=True)]
    found = [[first_nearest(x, b) for x in xs] for xs, b in zip(cut, books, strict=True)]
    digest = hashlib.sha256(",".join(str(n) for b in books for e in b for n in e).encode()).hexdigest()
    out = [(i, "".join(f"{found[p][r][0]:02x}" for p in range(parts)), sum(found[p][r][1] for p in range(parts)), label) for r, (i, _, label) in enumerate(kept)]
    return sorted(((i, code, min(e, LONG), min(sum(min(o[2], LONG) for o in out if o[3] == label), LONG), digest) for i, code, e, label in out), key=repr)


@pytest.mark.parametrize("entries", [3, 256])
def test_codes(spark, entries):
    rows = odd_rows(8) + [(400, []), (401, [1.0] * 7), (402, [1.0] * 10)]
    got = v.compressed(frame(spark, rows), entries=entries)
    assert sorted(map(tuple, got.collect()), key=repr) == compress(rows, entries)


def test_codes_past_a_long(spark):
    rows = [(i, [x, -x, x / 3, 1.0]) for i, x in enumerate([1e300, -1e300, 2.0**55, 2.0**40, 1.0, 0.0, 3.0, 1e17])]
    assert sorted(map(tuple, v.compressed(frame(spark, rows), entries=3).collect()), key=repr) == compress(rows, 3)


def test_nothing_to_compress(spark):
    assert v.compressed(frame(spark, [])).count() == 0
    assert v.compressed(frame(spark, [(1, None), (2, [None])])).count() == 0
    assert [tuple(r)[:4] for r in v.compressed(frame(spark, [(1, [])])).collect()] == [(1, "00000000", 0, 0)]


def test_labels_beyond_a_broadcast(spark):
    rows = v.coded(df := frame(spark, odd_rows(8)), v.codebooks(df, 4))
    sums = v.written(rows.groupBy("label").agg(v.F.sum("error").alias("total")), "sums")
    near, far = (sorted(map(tuple, v.looked_up(rows, sums, "label", v.F.col("vec_id"), most=most, shares=3).select("vec_id", "label", "total").collect()), key=repr) for most in (100, 1))
    assert near == far and len(near) == rows.count()


def test_decoded_vectors_are_within_their_error(spark):
    rows = odd_rows(8)
    df = frame(spark, rows)
    books = v.codebooks(df, 64)
    of = {}
    for r in v.decoded(v.coded(df, books), books).collect():
        of.setdefault((r.vec_id, r.error), []).append(r.vector)
    for i, x in rows:
        if (f := floors(x, 1024)) is not None and i is not None:
            errors = {sum((math.floor(y * 1024) - a) ** 2 for y, a in zip(vec, f, strict=True)) for (j, _), vs in of.items() if j == i for vec in vs}
            assert errors & {e for j, e in of if j == i}


@pytest.mark.parametrize(("name", "run", "sql"), [("op11", c.op11_centroid_clustering, c.OP11_SQL), ("op12", v.op12_vector_codes, v.OP12_SQL)])
def test_against_sql(spark, tmp_path, name, run, sql):
    rows = odd_rows(64)
    df = spark.createDataFrame([(i, x, None if i is None else i % 3 or None) for i, x in rows], "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert not differences(run(spark, str(tmp_path)), con, sql)

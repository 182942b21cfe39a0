"""Top-k search against brute force."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from tallyspark.llm import topk_search as t


def brute(rows, queries, k):
    floor = lambda v: [int(np.floor(256 * float(x))) for x in v]
    good = [(i, floor(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in [x for x in good if x[0] in queries]:
        found = sorted({(-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i})[:k]
        out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_against_brute_force(spark, block):
    g = np.random.default_rng(1)
    rows = [(i, [float(x) for x in g.integers(-3, 4, 5) / 4]) for i in range(120)]
    rows += [(200, None), (201, [None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [0.0] * 5), (205, []), (206, [1.0, 2.0])]
    rows += [(i, [0.5] * 5) for i in range(300, 320)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, id string")
    ids = {0, 50, 100, 200, 204, 205, 206, 300}
    got = t.top_k(df, df.where(df.vec_id.isin(*ids)), k=5, block=block).collect()
    assert {tuple(r) for r in got} == brute(rows, ids, 5)


def test_fewer_than_k_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert sorted(tuple(r) for r in t.top_k(two, two).collect()) == [(0, 1, 1, 256 * 512), (1, 1, 0, 256 * 512)]
    none = spark.createDataFrame([], schema)
    assert t.top_k(none, none).count() == 0
    assert t.top_k(two, none).count() == 0


def test_stops_before_the_end():
    n = 1000
    x = np.zeros((n, 2))
    x[:, 0] = np.arange(n)
    up = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
    best, scores, depth = t.threshold_top(x, np.arange(n), up, np.ascontiguousarray(up[:, ::-1]), np.array([3.0, 0.0]), -1, 5)
    assert best.tolist() == [999, 998, 997, 996, 995] and depth < n
    assert scores.tolist() == [3 * i for i in (999, 998, 997, 996, 995)]


def test_scores_past_float64(spark):
    rows = [(0, [2.0**22, 1.0]), (1, [2.0**21, 1.0]), (2, [2.0**21, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in t.top_k(df, df).collect()} == brute(rows, {0, 1, 2}, 5)


@pytest.mark.parametrize("block", [3, 2048])
def test_repeated_rows(spark, tmp_path, block):
    rows = [(i, [i / 4, 1.0]) for i in range(8)] + [(7, [7 / 4, 1.0])] * 6 + [(6, [9.0, 1.0]), (0, [0.0, 1.0]), (50, [1.0, -1.0])] + [(100, [1.0, 1.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = t.top_k(df, df.where("vec_id % 50 = 0"), block=block)
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(t.OP3_SQL).fetchall())


def test_tiles_that_cannot_win_are_not_walked():
    """Few long vectors ahead of many short ones: all tiles but the first are left out, and nothing is lost."""
    g = np.random.default_rng(3)
    x = np.floor(g.standard_normal((4000, 8)) * 20)
    x[:100] *= 40
    x = g.permutation(x)
    ids = np.arange(4000) * 3
    queries = np.floor(g.standard_normal((30, 8)) * 20)
    own, got, scores, walked = t.search_block(x, ids, queries, list(range(-30, 0)), 5, 500)
    want = []
    for k, q in zip(range(-30, 0), queries, strict=True):
        s = (x @ q).astype(int)
        first = np.lexsort((ids, -s))[:5]
        want += [(k, int(ids[i]), int(s[i])) for i in first]
    assert list(zip(own.tolist(), got.tolist(), scores.tolist(), strict=True)) == want
    assert walked <= 30 * 2

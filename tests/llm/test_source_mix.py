"""Mixing sources: targets against exact fractions, sums, copies, and what many draws come to."""

from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import source_mix as m

SCHEMA = "doc_id long, text string, source string, size string, copies string, _source int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash", 1) for i, t, s in rows], SCHEMA).repartition(4)


def words(text):
    return len((text or "").encode().split())


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    at_limit: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(2 * sizes[s] for s in at_limit)
        open_ = sum(weight[s] for s in order if s not in at_limit)
        fair = {s: Fraction(2 * sizes[s]) if s in at_limit else rest * weight[s] / open_ for s in order}
        above = {s for s in order if fair[s] > 2 * sizes[s]}
        if not above:
            return fair
        at_limit |= above


def corpus(seed=5, n=900):
    g = np.random.default_rng(seed)
    names = ["web", "Web", "a", "é", "𐐷", "￮", None, "one"]
    rows = []
    for i in range(n):
        s = "web" if g.random() < 0.4 else names[g.integers(0, 7)]
        rows.append((i, " ".join(["w"] * int(g.lognormal(3, 1.2))), s))
    rows += [(1000, "a\tb\nc\vd\fe\rf", "one"), (1001, None, "web"), (1002, " \n ", "a"), (1003, "", None), (1004, "no-break space is no space", "a")]
    return rows + [(None, "same words here", "web")] * 30 + [(5, "twice", "a")] * 2 + [(1005, "x " * 30_000, "web"), (1006, None, "nothing"), (1007, "  ", "nothing")]


def by_source(rows):
    out: dict = defaultdict(int)
    for _, t, s in rows:
        out[s] += words(t)
    return dict(out)


@pytest.mark.parametrize("block", [5, 256])
def test_targets_sizes_and_copies(spark, block):
    rows = corpus()
    got = m.mix(frame(spark, rows), block=block).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, words(t)) for i, t, s in rows)
    sizes = by_source(rows)
    want, taken, longest = targets(sizes), Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert rate - 1 < r.copies < rate + 1 and 0 <= r.copies <= 2 and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]


def test_near_the_target_with_blocks_as_in_the_query(spark):
    g = np.random.default_rng(3)
    rows = [(i, "w " * int(g.lognormal(4, 1.3)), f"s{i % 4}") for i in range(4000)]
    got = m.mix(frame(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.target for r in got)


def test_reruns_agree_however_rows_lie(spark):
    df = frame(spark, corpus())
    a, b = (sorted(map(tuple, m.mix(x, block=16).collect()), key=repr) for x in (df, df.repartition(7).orderBy(F.rand(1))))
    assert a == b


def test_every_document_gets_its_expected_copies(spark):
    """Over many sources with the same documents, those of each size come to target / source_size, in the blocks and in what is left of them."""
    g = np.random.default_rng(8)
    sizes, sources = [int(n) for n in g.integers(1, 60, 24)], 400
    rows = [(s * 100 + k, "w " * n, f"s{s}") for s in range(sources) for k, n in enumerate(sizes)]
    for share in (1.3, 0.15):
        total: Counter = Counter()
        for r in m.mix(frame(spark, rows), weights=(1,), share=share, block=4).collect():
            total[r.doc_id % 100] += r.copies
        z = [(total[k] / sources - share) / (share % 1 * (1 - share % 1) / sources) ** 0.5 for k in range(len(sizes))]
        assert max(map(abs, z)) < 4 and np.mean(np.square(z)) < 2


def test_resharing_goes_on_until_none_is_above(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1), ("b", 10), ("c", 3), ("d", 40), ("e", 500), ("f", 90), ("g", 7), ("h", 8), ("i", 2000)])]
    got = {r.source: r.target for r in m.mix(frame(spark, rows)).collect()}
    assert got == {s: pytest.approx(float(t), rel=1e-12) for s, t in targets(by_source(rows)).items()}


def test_many_equal_rows_and_many_sources(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("three words here").alias("text"), F.lit("hot").alias("source"))
    rows = rows.unionByName(spark.range(500).select("id", F.lit("a b").alias("text"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source")).withColumnRenamed("id", "doc_id"))
    got = m.mix(rows)
    hot = got.where("source = 'hot'").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).first()
    assert got.count() == 30_500 and hot.n == 30_000 and abs(hot.taken - hot.target) <= 3


def test_empty_and_wordless(spark):
    assert m.mix(frame(spark, [])).count() == 0
    got = m.mix(frame(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_no_python_in_the_plan(spark):
    plan = m.mix(frame(spark, corpus()[:50]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

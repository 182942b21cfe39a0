"""The n-gram join against brute force over all pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tallyspark.llm import chosen_path as c

WORDS = [f"w{i}" for i in range(3000)]


def shingles(text):
    said = (text or "").encode().split()
    k = min(5, len(said))
    return frozenset(tuple(said[i : i + k]) for i in range(len(said) - k + 1)) if said else frozenset()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links, up = defaultdict(int), {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[a + 1 :]:
            if s and u and 5 * len(s & u) >= 4 * len(s | u):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i, _ in rows}


def corpus():
    r = random.Random(2)
    say = lambda n: [r.choice(WORDS) for _ in range(n)]
    texts = []
    for _ in range(12):  # families of copies with a few words changed, across the threshold
        base = say(r.choice((30, 120, 400)))
        for _ in range(8):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 40))):
                t[r.randrange(len(t))] = r.choice(WORDS)
            texts.append(" ".join(t))
    shared = say(40)
    texts += [" ".join(shared + say(60)) for _ in range(90)]  # one passage in many texts that aren't alike
    dense = say(300)
    texts += [" ".join([*dense[:k], "new", *dense[k + 1 :]]) for k in range(0, 300, 3)]  # a hundred near copies
    texts += ["one two", "one two", "one  two", "one", "", None, " \n", "a b c d e", "a b c d e f"]
    texts += [texts[0]] * 20
    return list(enumerate(texts))


@pytest.mark.parametrize("how", [c.Join(), c.Join(small=8, block=16), c.Join(small=4, depth=1, block=1000), c.Join(small=16, broadcast_ids=3, broadcast_buckets=1)])
def test_against_all_pairs(spark, how):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, key string, weight int").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in c.jaccard_classes(df, how).collect()}
    assert got == brute(rows)


def test_one_of_each(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = c.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root for root, _ in brute(rows).values()})


def test_null_and_repeated_ids(spark):
    a, b, far = " ".join(WORDS[:100]), " ".join([*WORDS[:99], "new"]), " ".join(WORDS[200:300])
    rows = [(1, a), (1, a), (None, b), (5, far), (5, b), (None, None), (None, ""), (None, "all by itself here it stands"), (7, f"{far} "), (None, far), (None, "these have no id at all and are alike"), (None, "these have no id at  all and are alike")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, root int")
    got = sorted(map(tuple, c.jaccard_classes(df).select("doc_id", "class_id", "rep_id", "n_links").collect()), key=str)
    want = [(1, 1, 1, 3), (1, 1, 1, 3), (None, 1, 5, 3), (5, 5, 5, 2), (5, 1, 5, 3), (None, None, None, 0), (None, None, None, 0), (None, None, None, 0), (7, 5, 5, 2), (None, 5, 5, 2), (None, None, None, 1), (None, None, None, 1)]
    assert got == sorted(want, key=str)
    kept = c.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(1, a), (5, far)]
    assert sorted(r.text or "" for r in kept.collect() if not r.doc_id) == ["", "", "all by itself here it stands", "these have no id at  all and are alike"]


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert c.jaccard_classes(none).count() == 0
    assert c.one_of_each(none).count() == 0


def test_runs_meet_the_target():
    assert c.Join().runs() >= 3
    assert c.Join(recall=0.9).runs() == 1


def test_recall_over_given_documents(spark):
    """Queries are the documents whose id is divisible by 50, against all rows: at least 0.9 of their links are found."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.n_links for r in c.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 50 = 0").collect()}
    sets = [(i, shingles(t)) for i, t in rows]
    holders = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    true = {}
    for i, s in sets:
        if i % 50 == 0:
            common = defaultdict(int)
            for x in s:
                for k in holders[x]:
                    common[k] += 1
            true[i] = sum(5 * n >= 4 * (len(s) + len(sets[k][1]) - n) for k, n in common.items()) - bool(s)
    assert all(got[i] <= n for i, n in true.items())
    assert sum(got.values()) >= 0.9 * sum(true.values())

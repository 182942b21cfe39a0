"""Archives, language-model scores and the pipeline."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tallyspark.llm import neural_lm, warc

LONG = "<p>" + "x" * 200 + "</p>"
PAGES = [(1, "http://www.Example.com:8080/a?b=c", LONG), (2, "http://example.com/b c\n", LONG), (0, "https://example.com/b", LONG + "é"), (3, None, None), (4, "", "short"), (5, "http://example.com/b", "short"), (7, "http://example.com/z", LONG), (9, "http://[bad", "")]


def test_archives(spark):
    df = spark.createDataFrame([(*x, "clash") for x in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.archived(df)
    every = warc.range_reads(warc.find(index, warc.keys_of(df).select("key").distinct()), index.size).collect()
    got = {r.page_id: r for r in every}
    assert len(got) == len(every) == len(PAGES) == warc.all_entries(index).count()
    first = {}
    for i, _, html in sorted(PAGES, key=lambda x: x[0]):
        data = (html or "").encode()
        digest = hashlib.sha256(data).hexdigest()
        r = got[i]
        first.setdefault(digest, i)
        again = len(data) >= 100 and first[digest] != i
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), digest, "revisit" if again else "response", first[digest] if again else None)
        assert again or bytes(r.payload) == data


def test_look_up(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p/{i % 40}", f"page {i} " * 5) for i in range(500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    path = f"{warc.shared_dir(spark)}/look-up-{np.random.default_rng().integers(1 << 40)}"
    warc.write_archives(df, path, per_file=60)
    index = warc.capture_index(warc.entries(spark, path), lines=16)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert index.blocks.count() >= 500 // 16
    asked = spark.createDataFrame([("http://h3.example.com/p/3",), ("http://h0.example.com/p/0",), ("http://h3.example.com/none",)], "url string")
    found = warc.range_reads(warc.look_up(index, asked)).collect()
    want = {i for i, u, _ in rows if u in ("http://h3.example.com/p/3", "http://h0.example.com/p/0")}
    assert {r.page_id for r in found} == want and len(found) == len(want)


def test_archives_of_nothing(spark):
    index = warc.archived(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.range_reads(warc.all_entries(index)).count() == 0
    assert warc.find(index, warc.keys_of(spark.createDataFrame([("http://a/",)], "url string")).select("key")).count() == 0


def test_null_and_repeated_ids_and_a_long_page(spark):
    huge = "".join(f"<p>{i}</p>" for i in range(700_000))
    rows = [(1, "http://a/1", LONG), (1, "http://a/1", LONG), (None, "http://a/2", LONG), (None, None, "alone" * 30), (None, None, None), (2, "http://a/3", huge), (3, "https://a/3", huge)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    index = warc.archived(df)
    got = warc.range_reads(warc.find(index, warc.keys_of(df).select("key").distinct()), index.size).collect()
    said = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    n, h = len(LONG), len(huge)
    assert said == sorted([(1, "response", None, n), (1, "response", None, n), (None, "revisit", 1, n), (None, "response", None, 150), (None, "response", None, 0), (2, "response", None, h), (3, "revisit", 2, h)], key=str)
    assert {bytes(r.payload) for r in got if r.page_id == 2} == {huge.encode()}


def test_members_across_reads():
    import io

    parts = [warc.record(i, "http://a/", bytes([i]) * (i * 997), "d", None, "2024") for i in range(20)]
    data = warc.EMPTY.join(parts)
    found = list(warc.members(io.BytesIO(data).read, 100))
    assert [data[at : at + n] for at, n, _ in found] == parts
    assert [warc.read_record(data[at : at + n]).payload for at, n, _ in found] == [bytes([i]) * (i * 997) for i in range(20)]


def test_surt():
    assert warc.surt("http://www.example.com/a?b") == "com,example,www)/a?b"


def lm_docs():
    g = np.random.default_rng(4)
    words = ["red", "Green", "blue", "cat", "dog", "runs"]
    step = {w: words[(i + 1) % 6] for i, w in enumerate(words)}
    out = []
    for i in range(300):  # a word mostly decides the next one
        w, text = g.choice(words), []
        for _ in range(60):
            text.append(w if g.random() < 0.95 else f"rare{g.integers(500)}")
            w = step[w] if g.random() < 0.9 else g.choice(words)
        out.append((i, " ".join(text)))
    return [*out, (300, None), (301, ""), (301, ""), (302, "never seen words"), (303, " \n")]


def test_scores(spark):
    rows = lm_docs()
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, block string").repartition(3)
    how = neural_lm.Settings(spread=0.3, block_chars=20_000, tokens_a_step=64, batch=256, rounds=3, rate=0.2)
    got = neural_lm.lm_scores(df, how).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    base = score = 0.0
    for r in got:
        said = tokens(dict(rows)[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(said), sum(count[w] > 0 for w in said), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in said), rel_tol=1e-9)
        base, score = base + r.base_score * r.held_out, score + r.score * r.held_out
    assert score > base * 0.8  # log probabilities of held-out texts: at least a fifth less surprised


def test_training_meets_every_token(monkeypatch):
    v, how = 64, neural_lm.Settings()
    pairs = np.arange(3000)  # each context once, beside one of nearly all tokens
    triples = np.append((2 + pairs // 60) * v + 2 + pairs % 60, 0) * v + 5
    weights = np.append(np.ones(3000, np.int64), 100_000)
    met, whole = set(), neural_lm.Model.predicted
    monkeypatch.setattr(neural_lm.Model, "predicted", lambda m, w2, w1: (met.update(zip(w2.tolist(), w1.tolist(), strict=True)), whole(m, w2, w1))[1])
    words = neural_lm.Vocabulary({}, np.full(v, 1 / v))
    neural_lm.trained(neural_lm.Model.start(words, how.width), triples, weights, words, how, 1)
    assert met == {(t // v // v, t // v % v) for t in triples.tolist()}


def test_triples_of_a_large_vocabulary():
    v = 3_000_000  # past 2 ** 21, whose third power isn't within a long
    g = np.random.default_rng(5)
    w2, w1, w = (np.append(g.integers(0, v, 2000), [v - 1, v - 1, v - 1]).astype(np.int32) for _ in range(3))
    triples, weights, contexts = neural_lm.numbered(w2, w1, w, v)
    got = Counter(dict(zip(zip(*(x.tolist() for x in neural_lm.words_of(triples, v, contexts)), strict=True), weights.tolist(), strict=True)))
    assert got == Counter(zip(w2.tolist(), w1.tolist(), w.tolist(), strict=True)) and got[v - 1, v - 1, v - 1] == 3
    small = neural_lm.numbered(w2 % 50, w1 % 50, w % 50, 50)
    codes, counts = np.unique(((w2 % 50).astype(np.int64) * 50 + w1 % 50) * 50 + w % 50, return_counts=True)
    assert counts.tolist() == small[1].tolist()
    assert [x.tolist() for x in neural_lm.words_of(codes, 50, None)] == [x.tolist() for x in neural_lm.words_of(small[0], 50, small[2])]


def test_scores_of_null_ids_and_a_very_long_text(spark):
    """Rows without an id are scored each by itself, and a text much longer than a block is scored whole."""
    long = "one two three four five " * 200_000
    rows = [(None, "one two three"), (None, None), (7, long), (8, "one two three"), (8, "one two three"), (9, "")]
    how = neural_lm.Settings(block_chars=100_000)
    got = neural_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    want = [(i, len((t or "").split()) + 1) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert len({(r.score, r.base_score) for r in got if r.doc_id == 8}) == 1


def test_probabilities_sum_to_one():
    g = np.random.default_rng(1)
    words = neural_lm.Vocabulary({}, np.append([0.1, 0.2], 0.7 * 0.5 ** np.arange(1, 19) / (1 - 0.5**18)))
    v, c = 20, len(words.by_class)
    assert 4 < c < v and words.starts[-1] == v and np.allclose([words.sums[x - 1] for x in words.starts[1:]], np.arange(1, c + 1))
    m = neural_lm.Model(*(g.standard_normal(s).astype(np.float32) for s in ((v, 4), (v, 4), v, (c, 4), c, (4, 4), (4, 4))))
    w = np.arange(v, dtype=np.int32)
    p = np.exp(m.log_probability(np.full(v, 3, np.int32), np.full(v, 7, np.int32), w, words))
    assert abs(p.sum() - 1) < 1e-5
    assert np.allclose(p, [brute_probability(m, words, 3, 7, k) for k in range(v)], rtol=1e-4)


def test_equal_triples_are_scored_once(monkeypatch):
    """However often a triple is said, a row of scores is made for it once, and each of its places gets the result."""
    g = np.random.default_rng(2)
    words = neural_lm.Vocabulary({}, np.append([0.1, 0.2], np.full(30, 0.7 / 30)))
    v, c = 32, len(words.by_class)
    m = neural_lm.Model(*(g.standard_normal(s).astype(np.float32) for s in ((v, 4), (v, 4), v, (c, 4), c, (4, 4), (4, 4))))
    w2, w1, w = (np.tile(x, 500).astype(np.int32) for x in ([3, 3, 4], [7, 7, 1], [9, 12, 1]))
    rows, whole = [], neural_lm.log_sum
    monkeypatch.setattr(neural_lm, "log_sum", lambda s: (rows.append(len(s)), whole(s))[1])
    got = m.log_probability(w2, w1, w, words).reshape(500, 3)
    assert sum(rows) == 2 + 2  # two contexts, and two triples whose class has other words
    assert (got == got[0]).all() and np.allclose(np.exp(got[0]), [brute_probability(m, words, *x) for x in ((3, 7, 9), (3, 7, 12), (4, 1, 1))], rtol=1e-4)


def test_places_and_numbers():
    g = np.random.default_rng(3)
    for top in (1, 70_000, 1 << 40):
        x = np.append(g.integers(0, top, 500), [0, 0, top - 1, top - 1])
        assert (neural_lm.places(x) == np.argsort(x, kind="stable")).all()
    assert len(neural_lm.places(np.zeros(0, np.int32))) == 0
    words = neural_lm.Vocabulary({b"a": 2, b"\xff": 3}, np.full(4, 0.25))
    assert words.numbers(pa.array([b"\xff", b"", b"b", b"a"], pa.binary())).tolist() == [3, 0, 0, 2]
    assert neural_lm.Vocabulary({}, np.full(2, 0.5)).numbers(pa.array([b"a"], pa.binary())).tolist() == [0]


def brute_probability(m, words, w2, w1, w):
    """One word after two others, in plain loops."""
    d = m.r.shape[1]
    q = [sum(float(m.r[w1, i]) * float(m.c1[i, j]) + float(m.r[w2, i]) * float(m.c2[i, j]) for i in range(d)) for j in range(d)]
    weight = lambda t, b, k: math.exp(sum(x * float(y) for x, y in zip(q, t[k], strict=True)) + float(b[k]))
    k = int(words.of_class[w])
    mates = [x for x in range(len(words.unigram)) if words.of_class[x] == k]
    return weight(m.tc, m.bc, k) / sum(weight(m.tc, m.bc, x) for x in range(len(words.by_class))) * weight(m.t, m.b, w) / sum(weight(m.t, m.b, x) for x in mates)


def test_score_against_loops(spark):
    rows = lm_docs()[:40] + lm_docs()[-6:]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    how = neural_lm.Settings(spread=0.5, block_chars=2_000, rounds=1)
    corpus = neural_lm.gathered(df, how, "doc_id", "text", neural_lm.seventh)
    model = neural_lm.train(corpus, how)
    got = Counter((r.doc_id, round(r.score, 2)) for r in neural_lm.score(corpus, model, how).collect())
    count = Counter(w for i, t in rows if not neural_lm.seventh(i) for w in (t or "").encode().lower().split())
    tail = [n for w, n in count.items() if w not in corpus.words.frequent]
    assert corpus.others == sum(tail) and corpus.kinds == len(tail) and len(corpus.words.frequent) < len(count)
    want = Counter()
    for i, t in rows:
        w2 = w1 = neural_lm.END
        total = 0.0
        for word in [*(t or "").encode().lower().split(), None]:
            w = neural_lm.END if word is None else corpus.words.frequent.get(word, neural_lm.OTHER)
            total += math.log10(brute_probability(model, corpus.words, w2, w1, w))
            if w == neural_lm.OTHER:
                total += math.log10((count[word] + 1) / (sum(tail) + len(tail) + 1))
            w2, w1 = w1, w
        want[i, round(total, 2)] += 1
    assert sum((got - want).values()) <= 2  # at most a rounding apart


def test_no_training_text(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = neural_lm.lm_scores(df, held_out=lambda i: True).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)
    assert neural_lm.lm_scores(df.limit(0)).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}

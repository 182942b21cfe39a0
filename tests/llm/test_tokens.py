"""Token counts, byte-level BPE and packing against the libraries, on awkward texts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import byte_bpe, packing, token_counts

r = random.Random(5)
ALPHABET = [*list("abSt'. ,\n\t.é日1 ́\x1c\x85<\x01ΣİK"), "<|endoftext|>", "'RE", " The", "<|ENDOFTEXT|>", "É.", "word.", "don't,"]
TEXTS = [None, "", " ", "a", "x" * 30_000, "word " * 9000, *("".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(400))]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "clash", 1) for i, t in enumerate(TEXTS)] + [(0, "again", "en", "x", 1), (None, "no id", "en", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens string, offset int").repartition(3)


def test_token_counts(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        text = {None: "no id"}.get(row.doc_id, TEXTS[row.doc_id or 0] or "")
        if row.doc_id == 0 and row.n_bytes:
            text = "again"
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 1024)


def test_sentencepiece_counts(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    for row in token_counts.token_counts(docs.where("doc_id > 5"), path).collect():
        assert row.n_tokens == len(m.encode(TEXTS[row.doc_id]))


def test_byte_bpe_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.bpe_round_trip(docs.where("doc_id != 0"), path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(TEXTS) - 1
    for row in got:
        text = TEXTS[row.doc_id]
        ids = e.encode_ordinary(text)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_null_empty_and_one_long_word(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = [(1, None), (2, ""), (3, "xyzzy" * 60), (3, "xyzzy" * 60)]
    got = byte_bpe.bpe_round_trip(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    n = len(e.encode_ordinary("xyzzy" * 60))
    assert sorted((x.doc_id, x.n_tokens, x.ids_sha256 == empty) for x in got) == [(1, 0, True), (2, 0, True), (3, n, False), (3, n, False)]
    assert byte_bpe.bpe_round_trip(spark.createDataFrame([], "doc_id long, text string"), path, public_tokenizers.PATTERN).count() == 0


def test_folds_agree(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = [w.encode() for w in {*(" thndention", "eringsh", "Grüße", "日本語", "aaaaaaaaa", "a", "\x00"), *("".join(r.choice("abcdeth ñ日") for _ in range(r.randint(1, 30))) for _ in range(200))}]
    native = {bytes(x.word): x.ids for x in byte_bpe.native_encode(spark.createDataFrame([(w,) for w in words] + [(b"",), (None,)], "word binary").where("word is not null"), ranks).collect()}
    assert native.pop(b"") == []
    tables = byte_bpe.merges(ranks)
    for w in words:
        ids = e._core_bpe.encode_single_piece(w)
        assert (byte_bpe.fold(w, *tables) if w not in ranks else ids) == ids
        assert (native[w] if w not in ranks else ids) == ids
        if w not in ranks:
            assert byte_bpe.heap_fold(w, ranks) == ids


def test_decode(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "Grüße, 日本 and 12 €"
    df = spark.createDataFrame([(e.encode_ordinary(text),), ([],)], "ids array<int>")
    assert [bytes(x[0]).decode() for x in df.select(byte_bpe.decode(F.col("ids"), ranks)).collect()] == [text, ""]


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = defaultdict(int)
    for i, text in [*enumerate(TEXTS), (0, "again"), (None, "no id")]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())] += 1
    rows = packing.pack_documents(docs, path).collect()
    got = defaultdict(int)
    bins = defaultdict(list)
    for x in rows:
        got[x.doc_id, x.piece, x.start, x.length, x.ids_crc32] += 1
        bins[x.sequence_id].append((x.offset, x.length))
    assert got == want
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(x.length for x in rows) // 4096)


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bounds_never_pass_what_best_fit_needs(seed):
    g = np.random.default_rng(seed)
    lengths = g.integers(1, 101, g.integers(1, 60))
    bins, offsets, made = packing.best_fit(lengths, 100)
    assert packing.bound(lengths, 100) <= made
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 100 and fill.sum() == lengths.sum()
    assert packing.bound(np.full(10, 51), 100) == 10
    assert packing.bound(np.full(9, 34), 100) == 5


def test_exchange_closes_gaps(spark):
    g = np.random.default_rng(3)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(g.integers(1, 40, 3000))]
    items = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long")
    out = packing.best_fit_pack(items, 100, per_group=200)
    alone = sum(packing.best_fit(np.array([x[3] for x in rows[a : a + 200]]), 100)[2] for a in range(0, 3000, 200))
    used, least = out.select("sequence_id").distinct().count(), -(-sum(x[3] for x in rows) // 100)
    assert least <= used < alone and used <= least + 2
    assert out.count() == 3000


def test_equal_rows_do_not_gather(spark, monkeypatch):
    """100,000 rows that are equal in all columns, with null ids, are dealt to groups of about the asked size."""
    items = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS id", "0 AS piece", "CAST(0 AS LONG) AS start", "CAST(7 AS LONG) AS length", "CAST(5 AS LONG) AS ids_crc32")
    out = packing.best_fit_pack(items, 100, per_group=2000)
    first = out.where("sequence_id < 1L << 56").groupBy((F.col("sequence_id") / (1 << 24)).cast("long").alias("part")).count()
    assert first.agg(F.max("count")).first()[0] < 3000
    bins = out.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count_distinct("offset").alias("places"), F.count("*").alias("n"))
    assert bins.where("used > 100 OR places <> n").count() == 0
    assert out.count() == 100_000 and bins.count() <= -(-100_000 // 14) + 50


def test_repacking_of_what_can_hardly_be_packed(spark):
    """Lengths of a quarter to a half: most bins move, and groups follow what moves until a turn saves nothing."""
    g = np.random.default_rng(5)
    lengths = np.concatenate([g.integers(1025, 1366, 4000), g.integers(1366, 2048, 4000)])
    items = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES.format(id="long"))
    rows = packing.best_fit_pack(items, 4096, per_group=500).collect()
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert sorted(r.id for r in rows) == list(range(len(lengths))) and max(fill.values()) <= 4096
    assert len(fill) <= 1.03 * packing.best_fit(lengths, 4096)[2]


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["Some  words, and\nMore", "", "X" * 40]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.length for r in rows} == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(texts)}
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    rows = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0

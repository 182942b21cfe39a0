"""Byte-level BPE: ranked merges folded over the bytes of distinct words; decoding sets binary pieces together.

The fold is written twice. native_encode() and decode() are Spark's higher-order functions over a literal rank map.
They are exact, but an interpreted fold takes some 85 microseconds a word, and with them op4 can't meet its limit of
CPU seconds (the README has the figures). So the query folds the same distinct words over the same ranks inside Arrow
tasks; the tests hold both against the library.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import by_bytes, spaced, table, whole

#: Buckets of the literal rank map: Spark searches a map from its start, so pairs are spread over many short lists.
BUCKETS = 1 << 16


#: No rank; words from this length on are folded with a heap; cuts of texts that a Python worker keeps, some 500 bytes each.
NEVER, LONG, KEPT = 1 << 60, 64, 500_000


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return ranks_of(f.read())


def pair_ranks(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """All (left id, right id, id of both together) in a vocabulary; a token's id is its rank."""
    return [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]


def literal(value, schema: str) -> Column:
    """A literal of a nested type: the optimizer folds the parse of a constant once, on the driver."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal rank map: BUCKETS short lists of pairs of ids (k: left * 2**20 + right) and of merged ids (v)."""
    held: dict[str, list[list[int]]] = {"k": [[] for _ in range(BUCKETS)], "v": [[] for _ in range(BUCKETS)]}
    for a, b, r in pair_ranks(ranks):
        at = (a * 31 + b) & (BUCKETS - 1)
        held["k"][at].append((a << 20) | b)
        held["v"][at].append(r)
    return literal(held, "struct<k:array<array<bigint>>,v:array<array<int>>>")


def merged(parts: Column, table: Column) -> Column:
    """Ids after the merge of lowest rank, the leftmost of equals; the same ids where no pair has a rank."""

    def rank(a: Column, b: Column) -> Column:
        bucket = (a * 31 + b).bitwiseAND(BUCKETS - 1)
        place = F.array_position(F.get(table["k"], bucket), F.shiftleft(a.cast("long"), 20).bitwiseOR(b.cast("long")))
        return F.get(F.get(table["v"], bucket), (place - 1).cast("int"))

    found = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts)), rank)

    def joined(found: Column) -> Column:
        at = F.array_position(found, F.array_min(found)).cast("int")
        return F.when(F.array_min(found).isNull(), parts).otherwise(F.concat(F.slice(parts, 1, at - 1), F.array(F.array_min(found)), F.slice(parts, at + 2, F.size(parts))))

    return F.get(F.transform(F.array(found), joined), F.lit(0))


def bpe_fold(word: Column, byte_ids: Column, table: Column) -> Column:
    """The ids of one word, an array of its byte values: at most as many merges as it has bytes, less one."""
    first = F.transform(word, lambda b: F.get(byte_ids, b))
    return F.aggregate(F.slice(word, 2, F.size(word)), first, lambda parts, _: F.when(F.size(parts) > 1, merged(parts, table)).otherwise(parts))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that an array of ids stands for: the tokens' binary pieces set together."""
    pieces = [""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        pieces[r] = t.hex()
    table = literal(pieces, "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def native_encode(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word") -> DataFrame:
    """Distinct binary words with their ids, by higher-order functions alone; null words give null, empty ones no ids."""
    byte_ids, table = literal([ranks[bytes([b])] for b in range(256)], "array<int>"), rank_map(ranks)
    places = F.sequence(F.lit(1), F.octet_length(word_col))
    values = F.transform(places, lambda i: F.conv(F.hex(F.substring(F.col(word_col), i, F.lit(1))), 16, 10).cast("int"))
    ids = F.when(F.octet_length(word_col) == 0, F.array().cast("array<int>")).otherwise(bpe_fold(values, byte_ids, table))
    return words.select(word_col).distinct().withColumn("ids", ids)


def merges(ranks: dict[bytes, int]) -> tuple[list[int], dict[int, int]]:
    """The ids of the 256 bytes, and the merged id of each pair (left * 2**20 + right); a token's id is its rank."""
    return [ranks[bytes([b])] for b in range(256)], {(a << 20) | b: r for a, b, r in pair_ranks(ranks)}


def fold(word: bytes, byte_ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The ids of a word: its bytes, merged pair by pair, the pair of lowest rank first and the leftmost of equals."""
    get = pairs.get
    ids = [byte_ids[b] for b in word]
    found = [get((a << 20) | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
    while found and (best := min(found)) < NEVER:
        at = found.index(best)
        ids[at : at + 2] = (best,)
        del found[at]
        if at:
            found[at - 1] = get((ids[at - 1] << 20) | best, NEVER)
        if at < len(found):
            found[at] = get((best << 20) | ids[at + 1], NEVER)
    return ids


def heap_fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """fold() for long words: the same merges, found with a heap, so that time doesn't grow with the square of the length."""
    n = len(word)
    ends, left, right, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if not (alive[a] and right[a] == b and ends[a] == b and ends[b] == end):
            continue  # one of the two has been merged since
        ends[a], right[a], alive[b] = end, right[b], False
        if right[a] >= 0:
            left[right[a]] = a
            if (r := ranks.get(word[a : ends[right[a]]])) is not None:
                heapq.heappush(heap, (r, a, right[a], ends[right[a]]))
        if left[a] >= 0 and (r := ranks.get(word[left[a] : end])) is not None:
            heapq.heappush(heap, (r, left[a], a, end))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


@lru_cache(maxsize=1)
def encoder(data: bytes, pattern: str):
    """A function that gives each text's number of ids, ids (decimal, comma-joined) and their bytes set together again.

    Texts are cut where no match of the pattern crosses; a cut's words are folded once, and a Python worker keeps what
    it has folded for the tasks that follow.
    """
    import regex

    ranks = ranks_of(data)
    pieces = {r: t for t, r in ranks.items()}
    byte_ids, pairs = merges(ranks)
    words_in = regex.compile(pattern).findall
    counts: dict[str, int] = {}
    said: dict[str, str] = {}
    back: dict[str, bytes] = {}

    folded: dict[str, list[int]] = {}

    def ids_of(text: str) -> list[int]:
        out: list[int] = []
        for w in words_in(text):
            ids = folded.get(w)
            if ids is None:
                data = w.encode()
                one = ranks.get(data)
                ids = [one] if one is not None else fold(data, byte_ids, pairs) if len(data) < LONG else heap_fold(data, ranks)
                if len(data) < LONG:
                    folded[w] = ids
            out += ids
        return out

    def learn(cuts: set[str]) -> None:
        for x in cuts:
            ids = ids_of(whole(x))
            counts[x], said[x], back[x] = len(ids), ",".join(map(str, ids)), b"".join([pieces[i] for i in ids])

    def encode(texts: list[str]) -> list[tuple[int, str, bytes]]:
        cut = [spaced(x) for x in texts]
        if len(counts) > KEPT:
            for kept in (counts, said, back, folded):
                kept.clear()
        learn(set().union(*(x[1:] for x in cut)).difference(counts))
        out = []
        for first, *rest in cut:
            ids = ids_of(first)
            text = ",".join([*map(str, ids), *map(said.__getitem__, rest)])
            out.append((len(ids) + sum(map(counts.__getitem__, rest)), text, b"".join([*(pieces[i] for i in ids), *map(back.__getitem__, rest)])))
        return out

    return encode


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """Per row of docs: id_col, n_tokens, and the SHA-256 of its ids (decimal, comma-joined) and of the decoded bytes.

    A null or empty text has no ids (the digest of nothing). Ids may repeat or be null; an empty table gives none;
    other columns are ignored. Whole texts are encoded, of any length, and no row moves.
    """
    with open(path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary's file: fixed, some MB

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(held.value, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for a, b in by_bytes(batch.column(1), batch_bytes):
                part = batch.slice(a, b - a)
                rows = [(n, sha(ids.encode()), sha(data)) for n, ids, data in encode([x or "" for x in part.column(1).to_pylist()])]
                n, own, decoded = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(own), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(digests, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

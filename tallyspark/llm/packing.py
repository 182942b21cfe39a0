"""Best-fit packing of tokenised documents into sequences, with certified bin counts.

Pieces are dealt to partitions at random; each partition packs its own best-fit decreasing and compares its bins
with lower bounds from dual feasible functions. A partition that meets its bound is final: nobody can pack its
pieces into fewer sequences, but for the one that it has begun last. A partition keeps its fullest bins and gives the
pieces of that one, and of as many emptiest ones as a gap to its bound needs, to an exchange, where they are dealt to fewer
tasks and packed again, until nothing moves, one group is left or a turn saves no sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import balanced, parts, table, written

PIECES = "id {id}, piece int, start long, length long, ids_crc32 long"
PACKED = ", part long, bin long, fill long, offset long, bins long, bound long, moves boolean"
#: Token ids of this many distinct words are kept by a Python worker, some 250 bytes each.
KEPT = 500_000
#: A character that is a token by itself between words, and the start of special tokens.
MARK, SPECIAL = "\x01", "<|"
#: Where case counts, texts aren't lower-cased ahead of the tokenizer: special tokens, and letters whose lower case has two
#: characters or depends on what follows.
CASED = re.compile(r"<\||\u0130|\u03a3").search
#: Words of precomposed Latin letters, and those before a stop.
PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
STOPPED = re.compile(r".*[a-z\u00df-\u00f6\u00f8-\u00ff][,.]", re.S).fullmatch


@lru_cache(maxsize=1)
def ids_of(data: bytes):
    """A function that gives the ids of texts as little-endian unsigned 32-bit bytes.

    Tokenizers that lower-case, drop white space, cut between letters, digits and the rest and mark ends of words, as
    word_bpe_49k.json does, get texts in words, any other gets them whole. Texts are cut at spaces and line feeds; a comma or stop after a Latin letter at a word's
    end is a token of its own, so that distinct words are few, and each of them is encoded once. A Python worker
    keeps what it has encoded for the tasks that follow.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data.decode())
    t.no_truncation()
    t.no_padding()
    rules = json.loads(data)
    lowers = {"type": "Lowercase"} in ((rules["normalizer"] or {}).get("normalizers") or [])
    if not lowers or rules["model"].get("end_of_word_suffix") != "</w>":
        return lambda texts: [array("I", t.encode(x, add_special_tokens=False).ids).tobytes() for x in texts]
    # For words of lower-case letters alone, normalising and the pattern change nothing and may be left out.
    rules |= {"normalizer": None, "truncation": None, "padding": None, "added_tokens": []}
    rules["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]}
    bare = Tokenizer.from_str(json.dumps(rules))
    (mark,) = t.encode(MARK, add_special_tokens=False).ids
    ids: dict[str, bytes] = {}

    def many(by: Tokenizer, words: list[str]) -> None:
        """Encode words in texts of many, with a mark between them, which is cheaper than one by one."""
        for batch in balanced(words, 1 << 16):
            got = np.array(by.encode_batch_fast([f" {MARK} ".join(batch)], add_special_tokens=False)[0].ids, "<u4")
            at, data = (np.flatnonzero(got == mark) * 4).tolist(), got.tobytes()
            ids.update(zip(batch, [data[a:b] for a, b in zip([0, *(k + 4 for k in at)], [*at, len(data)], strict=True)], strict=True))

    def learn(words: set[str]) -> None:
        stopped = [w for w in words if STOPPED(w)]
        missing = words.difference(stopped)
        missing.update(w[:-1] for w in stopped)
        missing.update(",.")
        missing = missing.difference(ids)
        odd = [w for w in missing if MARK in w or SPECIAL in w]
        missing.difference_update(odd)
        ids.update((w, array("I", x.ids).tobytes()) for w, x in zip(odd, t.encode_batch_fast(odd, add_special_tokens=False), strict=True))
        plain = [w for w in missing if PLAIN(w)]
        many(bare, plain)
        many(t, list(missing.difference(plain)))
        ids.update((w, ids[w[:-1]] + ids[w[-1]]) for w in stopped)

    def encode(texts: list[str]) -> list[bytes]:
        cut = [(x if CASED(x) else x.lower()).replace("\n", " ").split(" ") for x in texts]
        if len(ids) > KEPT:
            ids.clear()
        if new := set().union(*cut).difference(ids):
            learn(new)
        return [b"".join(map(ids.__getitem__, x)) for x in cut]

    return encode


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every document, then end_id, cut into pieces of at most size: id, piece, start, length, ids_crc32."""
    with open(tokenizer, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a tokenizer's file: fixed, some MB
    last = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(held.value)
        for part in parts(batches):
            rows = []
            for i, ids in enumerate(encode([x or "" for x in part.column(1).to_pylist()])):
                ids += last
                rows += [(i, k, at // 4, len(p := ids[at : at + 4 * size]) // 4, zlib.crc32(p)) for k, at in enumerate(range(0, len(ids), 4 * size))]
            i, k, start, length, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(cut, PIECES.format(id=docs.schema[id_col].dataType.simpleString()))


def bound(lengths: np.ndarray, size: int) -> int:
    """A lower bound of the number of bins: the best of the sum and of the dual feasible functions below.

    f_k raises lengths over size - k to size and drops those under k (for k up to half of size); u_k rounds a share
    x of the bin to floor((k + 1) x) / k where (k + 1) x is no integer, and keeps it otherwise.
    """
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=size + 1)
    x = np.arange(size + 1)
    best = -(-int((n * x).sum()) // size)
    count, total = np.cumsum(n), np.cumsum(n * x)
    k = np.arange(1, size // 2 + 1)
    raised = (count[size] - count[size - k]) * size + total[size - k] - total[k - 1]
    best = max(best, int((-(-raised // size)).max()))
    for k in range(1, 64):
        t = (k + 1) * x
        v = np.where(t % size == 0, k * x, t // size * size)  # in parts of k * size
        best = max(best, -(-int((n * v).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: each piece's bin and offset, and the number of bins. Open bins are held by the room left."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0  # bit r: some bin has r left
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = open_rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b, made = size, made, made + 1
        bins[i], offsets[i] = b, size - room
        if left := room - n:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, made


def packed(size: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        b, offset, made = best_fit(lengths, size)
        least = bound(lengths, size)
        fill = np.bincount(b, weights=lengths, minlength=made).astype(np.int64)
        moves = np.zeros(made, bool)
        # the emptiest bins, as many as it takes for their room to hold the bins over the bound, and one more for the last
        # bin that each partition has begun
        order = np.argsort(fill, kind="stable")
        room = np.cumsum(size - fill[order])
        moves[order[: int(np.searchsorted(room, (made - least) * size)) + 1]] = True
        moves &= (fill < size) | (made > least)
        return pdf.assign(bin=b, fill=fill[b], offset=offset, bins=made, bound=least, moves=moves[b])

    return pack


def best_fit_pack(items: DataFrame, size: int = 4096, per_group: int = 20_000) -> DataFrame:
    """Pack pieces (id, piece, start, length, ids_crc32) into sequences: adds sequence_id, offset, bins and bound.

    Every piece is in one sequence; a sequence's pieces stand gapless from offset 0 and sum to at most size. bins and
    bound are the counts of the partition that closed the sequence. About per_group pieces are packed by a task, dealt
    by a hash of the row's number in its table, so that not even rows that are equal in all columns gather. What moves is
    dealt anew to as many tasks as its own number asks for, and packed again as long as that saves sequences. An empty
    table gives none. items are read twice and numbered as they lie, so they must be a written table.
    """
    kind = items.schema["id"].dataType.simpleString()
    schema = PIECES.format(id=kind) + PACKED
    groups = max(1, -(-items.count() // per_group))
    deal = lambda rows, groups: rows.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    dealt = deal(items, groups)
    done, turn, before = None, 0, None
    numbered = lambda rows, turn: rows.withColumn("sequence_id", (F.lit(turn).cast("long") * (1 << 56)) + (F.col("part") * (1 << 24)) + F.col("bin"))
    while True:
        turned = written(dealt.groupBy("part").applyInPandas(packed(size), schema), "packed")
        begun = F.col("offset") == 0  # one piece of each sequence
        now = turned.agg(F.count_if(begun).alias("bins"), F.count_if(begun & F.col("moves")).alias("moving"), F.count_if("moves").alias("pieces")).first()
        if groups == 1 or not now.pieces or before is not None and now.bins >= before:
            final = numbered(turned, turn)
            return final if done is None else done.unionByName(final)
        stay = numbered(turned.where("not moves"), turn)
        done = stay if done is None else done.unionByName(stay)
        groups, turn, before = -(-now.pieces // per_group), turn + 1, now.moving
        dealt = deal(turned.where("moves").select("id", "piece", "start", "length", "ids_crc32"), groups)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack documents: id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound.

    A null or empty text is one piece with the end id alone. Documents longer than size are cut into pieces of size,
    the last one shorter. Rows with equal or null ids are packed each by itself; other columns are ignored.
    """
    out = best_fit_pack(written(pieces(docs, tokenizer, size, end_id, id_col, text_col), "pieces"), size)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

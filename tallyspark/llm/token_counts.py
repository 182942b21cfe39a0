"""Token counts: whole texts encoded in Arrow batches, of which only lengths come back."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import balanced, by_bytes, spaced, table, whole

#: Lengths of this many distinct pieces are kept by a task, and pieces of this many bytes go to one encoding call.
KEPT, BATCH_BYTES = 400_000, 1 << 20


def counter(name: str, data: bytes):
    """A function that gives the token counts of a list of texts, by the library for the file's kind."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data.decode())
    t.no_truncation()
    t.no_padding()
    lengths: dict[str, int] = {}

    def encode(texts: list[str]) -> list[int]:
        return [len(x) for batch in balanced(texts, BATCH_BYTES) for x in t.encode_batch_fast(batch, add_special_tokens=False)]

    rules = json.loads(data)
    byte_level = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
    if rules["normalizer"] is not None or not byte_level.items() <= (rules["pre_tokenizer"] or {}).items():
        return encode  # nothing is known of where its tokens may end

    def count(texts: list[str]) -> list[int]:
        cut = [spaced(x) for x in texts]
        if len(lengths) > KEPT:
            lengths.clear()
        if new := list(set().union(*(x[1:] for x in cut)).difference(lengths)):
            lengths.update(zip(new, encode([whole(x) for x in new]), strict=True))
        firsts = encode([x[0] for x in cut])
        return [n + sum(map(lengths.__getitem__, x[1:])) for n, x in zip(firsts, cut, strict=True)]

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of docs: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    tokenizer is the path of a .json (tokenizers) or .model (sentencepiece) file, read on the driver. Texts are cut at
    boundaries that no token crosses; equal pieces of a batch are encoded once. A null text counts as empty (0
    tokens), ids may repeat or be null, an empty table gives an empty result, and other columns are ignored. A text
    without a safe boundary is encoded whole, and so are all texts where the file's rules aren't plain byte-level ones. No row moves: each partition is mapped by itself.
    """
    with open(tokenizer, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # a tokenizer's file: fixed, some MB

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, held.value)
        for batch in batches:
            for a, b in by_bytes(batch.column(1), batch_bytes):
                part = batch.slice(a, b - a)
                texts = part.column(1)
                n = count([x or "" for x in texts.to_pylist()])
                sizes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

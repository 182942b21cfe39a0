"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.bridge import table
from tallyspark.sources.shared import forget, shared_dir, written

__all__ = ["LONG", "balanced", "by_bytes", "fits", "floored", "forget", "looked_up", "parts", "shared_dir", "spaced", "table", "to_long", "whole", "written"]

LONG = (1 << 63) - 1

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same six bytes.
ASCII_SPACE = " \t\n\v\f\r"
TWO_SPACES = re.compile(r"\s\s|\A\s|\s\Z")
#: In ASCII texts without these, every space and line feed inside stands between other characters.
ODD_SPACES = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f")
SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def spaced(text: str) -> list[str]:
    """Cut a text before single spaces and line feeds that stand between other characters.

    The first piece is as it stands; of the others, one that began with a space has lost it, and one that
    begins with a line feed has kept it. A byte-level tokenizer whose pattern joins at most one leading space to
    a word never makes a token across such a cut.
    """
    if (any(map(text.__contains__, ODD_SPACES)) or text[:1] in " \n" or text[-1:] in " \n") if text.isascii() else TWO_SPACES.search(text):
        first, *rest = SAFE_CUT.split(text)
        return [first, *(p[1:] if p[0] == " " else p for p in rest)]
    return text.replace("\n", " \n").split(" ")


def whole(piece: str) -> str:
    """A piece after the first of spaced(), as it stood in the text."""
    return piece if piece[:1] == "\n" else " " + piece


def balanced(pieces: list[str], limit: int) -> list[list[str]]:
    """Lists of pieces, each of about limit bytes."""
    out, held, room = [], [], limit
    for p in pieces:
        held.append(p)
        room -= (len(p) if p.isascii() else len(p.encode())) + 8
        if room <= 0:
            out.append(held)
            held, room = [], limit
    return [*out, held] if held else out


def by_bytes(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes each, so that a batch of long texts isn't larger than one of short texts."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        held += n
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def parts(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a task holds some MB of a text column as Python strings at a time."""
    for batch in batches:
        for a, b in by_bytes(batch.column(column)):
            yield batch.slice(a, b - a)


def floored(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) of finite numbers; what is past a long is cut to its range."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    over, under = y >= 2.0**63, y < -(2.0**63)
    out = np.where(over | under, 0, y).astype(np.int64)
    out[over], out[under] = LONG, -LONG - 1
    return out


def fits(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether squared distances between rows of x and of y, and what they are expanded to, are within a long."""
    reach = np.abs(x.astype(float)).max(initial=0) + np.abs(y.astype(float)).max(initial=0)
    return reach * reach * max(x.shape[1], 1) < 2.0**62


def to_long(x: np.ndarray) -> np.ndarray:
    """Whole numbers of any size, cut to the range of a long."""
    return x if x.dtype != object else np.array([min(max(int(n), -LONG - 1), LONG) for n in x], np.int64)


def looked_up(rows: DataFrame, facts: DataFrame, key: str, deal: Column, most: int = 100_000, shares: int = 32) -> DataFrame:
    """rows with the columns of facts, a written table with one row for each value of key, nulls being one value.

    Facts of at most ``most`` rows, which are counted, are broadcast. Others are copied ``shares`` times and meet rows that are
    dealt by the hash of ``deal`` as well, so that a key that a third of all rows have is spread over so many tasks.
    """
    named = facts.withColumnRenamed(key, "_key")
    if facts.count() <= most:
        return rows.join(F.broadcast(named), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    left = rows.withColumn("_share", F.pmod(F.xxhash64(deal), F.lit(shares)).cast("int"))
    right = named.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return left.join(right, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_share") == F.col("_part"))).drop("_key", "_share", "_part")

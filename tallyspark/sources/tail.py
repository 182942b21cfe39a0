"""Lines of files that grow, as a streaming source: ``spark.readStream.format("tail").load(folder)``.

An offset holds for each file its size, and checksums of its first 1, 2, 4, ... 4096 bytes. What a batch reads follows from two
offsets alone, so a batch that is run again reads the same bytes: a file whose head is as it was is read on from its old size,
any other (replaced, cut short, new) from its beginning. Offsets needn't be at the ends of lines: a line belongs to the range of
bytes that its line feed lies in, and a task looks back for its beginning. So the driver looks at no more than heads, a large
file is read by several tasks, and a line that is still being written is read once it has ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a file's head that are known again, and of the longest line that is read.
HEAD = 4096
LONGEST = 10 << 20
BLOCK = 1 << 20
MARKS = [1 << i for i in range(HEAD.bit_length())]


@dataclass
class Span(InputPartition):
    """Bytes [start, end) of a file with a given head."""

    path: str
    start: int
    end: int
    head: int
    mark: int

    def __init__(self, path: str, start: int, end: int, head: int, mark: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.head, self.mark = path, start, end, head, mark


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def begin_of_line(f: pa.NativeFile, at: int, longest: int) -> int | None:
    """Where the line begins that the byte at ``at`` is in; None if that is more than ``longest`` bytes before."""
    lo = at
    while lo > 0:
        if at - lo > longest:
            return None
        size = min(64 << 10, lo)
        f.seek(lo - size)
        cut = f.read(size).rfind(b"\n")
        if cut >= 0:
            return lo - size + cut + 1
        lo -= size
    return 0


def lines(f: pa.NativeFile, start: int, end: int, longest: int = LONGEST) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines whose line feed lies in [start, end). Lines longer than longest are left out; no more is held."""
    at = begin_of_line(f, start, longest)
    over = at is None  # within a line that is left out
    at = start if over else at
    f.seek(at)
    held = b""
    while at + len(held) < end:
        block = f.read(min(BLOCK, end - at - len(held)))
        if not block:
            return
        *whole, rest = (held + block).split(b"\n")
        for line in whole:
            if not over and len(line) < longest:
                yield at, line
            at, over = at + len(line) + 1, False
        held = rest
        if len(held) >= longest or over:
            at, held, over = at + len(held), b"", True


def found(root: str, suffix: str, known: dict) -> dict:
    """The offset of now: for each file its size and head. known holds those of the last call, by path."""
    fs, at = opened(root)
    out = {}
    for info in fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True)):
        hidden = any(part[:1] in "_." for part in info.path[len(at) :].split("/") if part)
        if info.type != pafs.FileType.File or hidden or not info.path.endswith(suffix):
            continue
        seen = (info.size, info.mtime_ns)
        if known.get(info.path, (None,))[0] != seen:
            try:
                with fs.open_input_file(info.path) as f:
                    head = f.read(min(HEAD, info.size))
            except FileNotFoundError:
                continue
            known[info.path] = seen, [info.size, [crc32(head[:n]) for n in MARKS if n <= len(head)]]
        out[info.path] = known[info.path][1]
    for gone in known.keys() - out.keys():
        del known[gone]
    return out


def spans(start: dict, end: dict, split: int) -> list[Span]:
    """What is new from one offset to another, in ranges of at most split bytes."""
    out = []
    for path, (size, marks) in sorted(end.items()):
        before, old = start.get(path, (0, []))
        first = before if size >= before and marks[: len(old)] == old else 0
        cuts = [*range(first, size, split), size] if size > first else []
        out += [Span(path, a, b, MARKS[len(marks) - 1], marks[-1]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def read_span(root: str, span: Span, longest: int) -> Iterator[pa.RecordBatch]:
    """path, offset, value of a range's lines. A file that has been replaced since has lost these bytes: it gives none, and is read anew later."""
    fs, _ = opened(root)
    try:
        f = fs.open_input_file(span.path)
    except FileNotFoundError:
        return
    with f:
        if crc32(f.read(span.head)) != span.mark or f.size() < span.end:
            return
        held, size = [], 0
        for at, line in lines(f, span.start, span.end, longest):
            text = line.strip()
            if text:
                held.append((at, text.decode("utf-8", "replace")))
                size += len(text)
            if size > 4 << 20 or len(held) >= 10_000:
                yield batch(span.path, held)
                held, size = [], 0
        if held:
            yield batch(span.path, held)


def batch(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.record_batch({"path": pa.array([path] * len(rows), pa.string()), "offset": pa.array([r[0] for r in rows], pa.int64()), "value": pa.array([r[1] for r in rows], pa.string())})


class _Tail:
    def __init__(self, options: dict) -> None:
        self.root, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.split, self.longest = int(options.get("split", 64 << 20)), int(options.get("longest", LONGEST))
        self.known: dict = {}

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return read_span(self.root, partition, self.longest)


class TailStream(_Tail, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return found(self.root, self.suffix, self.known)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return spans(start, end, self.split)


class TailReader(_Tail, DataSourceReader):
    def partitions(self) -> list[Span]:
        return spans({}, found(self.root, self.suffix, self.known), self.split)


class Tail(DataSource):
    """S3. Options: path (a folder, by any URI that Arrow's file systems read), suffix, split (bytes of a task), longest (bytes of a line).

    Rows: path, offset of the line in its file, value (the line without white space around it; empty lines are left out, bytes that
    aren't UTF-8 are replaced). As a batch source it reads what is there. Files and folders whose names
    begin with a dot or an underscore are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def streamReader(self, schema) -> TailStream:  # noqa: ANN001
        return TailStream(self.options)

    def reader(self, schema) -> TailReader:  # noqa: ANN001
        return TailReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Tail)
    return spark

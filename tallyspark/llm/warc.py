"""WARC archives written and read by Spark, with a two-level capture index.

Archives are files of one gzip member per record, as in .warc.gz files (Spark's text writer names them .txt). The index
is made from the archives: entries (reversed-host URL key, record id, archive, offset, length) are sorted into compressed
blocks, and a sparse directory keeps each block's first key. A look-up finds its blocks by binary search in the directory,
its entries by binary search in the block, and its records by range reads.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import by_bytes, shared_dir, table, written

#: Payloads under this size are always written whole.
LEAST = 100
#: A gzip member of nothing. Spark's text writer puts it between records, which keeps a file a run of gzip members.
EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31)
EMPTY = EMPTY.compress(b"") + EMPTY.flush()
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, record_id string, archive string, offset long, length long"


def surt(url: str) -> str:
    """The key of a URL: host labels reversed and comma-joined, a bracket, then path and query."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return ")" + url
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def header(text: str) -> str:
    """A header's value: white space and control characters would end it, so they are written as percent codes."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {header(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def read_record(member: bytes) -> Record:
    """A record from its gzip member; raises ValueError where it isn't one."""
    head, found, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    named = lambda lines: dict(x.decode().split(": ", 1) for x in lines)
    version, *lines = head.split(b"\r\n")
    if not found or not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = named(lines)
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    return Record(headers, named(http.split(b"\r\n")[1:]), payload)


def members(read, size: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive that hold something; read(n) gives its next n bytes."""
    at, held = 0, b""
    while held := held or read(size):
        z, parts, length = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not (held := held or read(size)):
                raise ValueError("the archive is cut off")
            parts.append(z.decompress(held))
            length += len(held) - len(z.unused_data)
            held = z.unused_data
        if any(parts):
            yield at, length, b"".join(parts)
        at += length


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z", per_file: int = 50_000, broadcast_digests: int = 100_000) -> None:
    """Write a record per row of pages to files of gzip members under path, in Spark's own output commit.

    Of rows with equal payloads of LEAST bytes or more, those with the least id are responses and the others revisits
    that refer to it. A null page has the empty payload; a null id's payload is a revisit if others have it.
    Repeated digests are counted in the tasks before they are shuffled; they are broadcast if they are at most
    broadcast_digests, and joined by adaptive execution, which splits hot ones, beyond that. A task begins a new file
    after per_file records; whatever a file's size, it is read as a stream.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= LEAST)
    again = written(long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"), "digests")
    few = again.limit(broadcast_digests + 1).count() <= broadcast_digests
    joined = rows.join(F.broadcast(again) if few else again, "digest", "left").select("id", "url", "payload", "digest", F.when(F.octet_length("payload") >= LEAST, F.col("first")).alias("first"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in by_bytes(batch.column(2)):
                out = [record(i, u, p, d, None if f == i else f, date) for i, u, p, d, f in zip(*(c.to_pylist() for c in batch.slice(a, b - a).columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    packed = joined.mapInArrow(pack, "record binary").select(F.col("record").cast("string"))
    packed.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", per_file).text(path)


def opened(archive: str):
    """An archive's bytes by Arrow's file systems (file, hdfs, s3 and gs paths), for reading at any place."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(archive)
    return system.open_input_file(at)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """archive, size: the files under path, as Spark lists them; their bytes aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("archive"), F.col("length").alias("size"))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ENTRY, read as a stream from the archives under path, a task for each archive or two."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with opened(archive) as f:
                    out = []
                    for at, length, content in members(f.read):
                        headers = dict(x.split(": ", 1) for x in content.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
                        out.append((surt(headers.get("WARC-Target-URI", "")), headers["WARC-Record-ID"], archive, at, length))
                        if len(out) == 10_000:
                            yield entry_batch(out)
                            out = []
                    if out:
                        yield entry_batch(out)

    files = archive_files(spark, path)
    return files.select("archive").repartition(max(1, files.count()), "archive").mapInArrow(scan, ENTRY)


def entry_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["key", "record_id", "archive", "offset", "length"])


@dataclass
class CaptureIndex:
    """blocks: shard, block, first (key), data (compressed lines); directory: shard, lowest, firsts (of its blocks); size: bytes of
    the archives."""

    blocks: DataFrame
    directory: DataFrame
    size: int = 0


def line(*values) -> str:
    return "\t".join(map(str, values))


def capture_index(found: DataFrame, lines: int = 512, size: int = 0) -> CaptureIndex:
    """Sort entries by key into blocks of so many lines, and keep the first key of each.

    Shards are ranges of keys; one key may span several shards, in which case the look-up reads them all. Keys hold
    no tabs or line feeds, since headers don't.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = 0

        def done(rows: list[tuple]) -> pa.RecordBatch:
            data = zlib.compress("\n".join(line(*r[:5]) for r in rows).encode(), 6)
            return pa.RecordBatch.from_arrays([pa.array([rows[0][5]], pa.int32()), pa.array([number], pa.int32()), pa.array([rows[0][0]]), pa.array([data], pa.binary())], ["shard", "block", "first", "data"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(held) > lines:
                yield done(held[:lines])
                held, number = held[lines:], number + 1
        if held:
            yield done(held)

    placed = found.repartitionByRange("key", "record_id").sortWithinPartitions("key", "record_id").withColumn("shard", F.spark_partition_id())
    blocks = written(placed.mapInArrow(block, "shard int, block int, first string, data binary"), "capture-blocks")
    firsts = F.transform(F.array_sort(F.collect_list(F.struct("block", "first"))), lambda x: x["first"])
    return CaptureIndex(blocks, written(blocks.groupBy("shard").agg(F.min("first").alias("lowest"), firsts.alias("firsts")), "capture-directory"), size)


def decoded(data: bytes) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(data).decode().split("\n")]


def keys_of(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """url and key of each of urls; a null URL has the key of captures without one."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([surt(header(x or "")) for x in batch.column(0).to_pylist()], pa.string())], ["url", "key"])

    return urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(keyed, "url string, key string")


def find(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """ENTRY's columns of all captures of keys (a column key, without repeats).

    Two binary searches number a key by shard and block: over the lowest keys of shards (one per range partition of the
    index, so they are few and go to all tasks), and over the first keys of a shard's blocks. Blocks and keys then meet in
    order, each block ahead of its keys; it is unpacked once, and each key finds its entries by binary search in it.
    """
    shards = sorted((r.lowest, r.shard, r.n) for r in index.directory.select("lowest", "shard", F.size("firsts").alias("n")).collect())
    lowest, numbers = [x for x, _, _ in shards], [n for _, n, _ in shards]

    def to_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, numbers[k]) for key in batch.column(0).to_pylist() for k in range(max(bisect_left(lowest, key) - 1, 0), bisect_right(lowest, key))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.int32())], ["key", "shard"])

    def to_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last, firsts = [], None, []
            for k, (key, shard) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if shard != last:
                    last, firsts = shard, batch.column(2)[k].as_py()
                out += [(key, shard, n) for n in range(max(bisect_left(firsts, key) - 1, 0), bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.string(), pa.int32(), pa.int32()))], ["key", "shard", "block"])

    def to_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = [], []
        for batch in batches:
            out = []
            for data, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is not None:
                    rows = decoded(data)
                    known = [r[0] for r in rows]
                else:
                    out += [(*r[:3], int(r[3]), int(r[4])) for r in rows[bisect_left(known, key) : bisect_right(known, key)]]
            if out:
                yield entry_batch(out)

    asked = keys.select("key").mapInArrow(to_shard, "key string, shard int")
    at = asked.join(index.directory.select("shard", "firsts"), "shard").select("key", "shard", "firsts").mapInArrow(to_block, "key string, shard int, block int")
    both = index.blocks.select("shard", "block", "data", F.lit(None).cast("string").alias("key")).unionByName(at.select("shard", "block", F.lit(None).cast("binary").alias("data"), "key"))
    tasks = max(1, -(-sum(n for _, _, n in shards) // 32))
    return both.repartition(tasks, "shard", "block").sortWithinPartitions("shard", "block", F.col("key").asc_nulls_first()).select("data", "key").mapInArrow(to_entry, ENTRY)


def look_up(index: CaptureIndex, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Entries of all captures of each of urls: the URL and ENTRY's columns. A null URL finds those without one."""
    asked = keys_of(urls.distinct(), url_col)
    return asked.join(find(index, asked.select("key").distinct()), "key").select("url", "key", "record_id", "archive", "offset", "length")


def all_entries(index: CaptureIndex) -> DataFrame:
    """Every entry of the index, block by block."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [(*r[:3], int(r[3]), int(r[4])) for r in decoded(data)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["key", "record_id", "archive", "offset", "length"])

    return index.blocks.select("data").mapInArrow(unpack, ENTRY)


def range_reads(found: DataFrame, size: int = 0, stretch: int = 2 << 20) -> DataFrame:
    """Records at the places of entries (archive, offset, length): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Places are dealt by archive and stretch of it, sorted, and read by range. size, the bytes of the archives, sets the
    number of tasks; without it Spark does. A response's digest is computed from what is read and must equal its header's.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            out, held = [], 0
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    name, f = archive, opened(archive)
                r = read_record(f.read_at(length, offset))
                revisit = r.headers["WARC-Type"] == "revisit"
                digest = r.headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if not revisit and hashlib.sha256(r.payload).hexdigest() != digest:
                    raise ValueError(f"{archive} at {offset}: the payload isn't what was written")
                number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">") or -1) if x else None
                page = r.headers["WARC-Record-ID"]
                out.append((None if page == "<urn:page:>" else number(page), r.headers.get("WARC-Target-URI"), int(r.http["Content-Length"]), digest, r.headers["WARC-Type"], number(r.headers.get("WARC-Refers-To")), None if revisit else r.payload))
                held += int(r.http["Content-Length"])
                if held > 8 << 20:
                    yield read_batch(out)
                    out, held = [], 0
            yield read_batch(out)

    def read_batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    by = ("archive", F.floor(F.col("offset") / stretch))
    places = found.select("archive", "offset", "length")
    dealt = places.repartition(-(-size // stretch), *by) if size else places.repartition(*by)
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(fetch, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archived(pages: DataFrame, **columns: str) -> CaptureIndex:
    """Write pages to archives in the shared folder and index them."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **columns)
    size = archive_files(spark, path).agg(F.sum("size")).first()[0] or 0
    return capture_index(entries(spark, path), size=size)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of the table, written to archives and read back by looking up the key of every page's URL."""
    pages = table(spark, sf_dir, "pages")
    index = archived(pages)
    found = find(index, keys_of(pages).select("key").distinct())
    return range_reads(found, index.size).drop("payload", "url")


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

"""Streams with state by key: deliveries seen before, and messages that are held until they are whole."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyspark.sources.shared import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Streams of a session that are open at once, and finished messages that are remembered.
MOST_OPEN, MOST_RECENT = 16, 64


def drained(stream: DataFrame, name: str, at: str = "") -> DataFrame:
    """A stream run to what is there now, its rows appended to a table in the shared folder. With the same folder a later run goes on."""
    spark = stream.sparkSession
    at = at or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # the state store that keeps state by key and timers
    try:
        stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def micros(t: dt.datetime) -> int:
    """Microseconds since 1970 of a time without a zone, or in the session's."""
    return round((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) if t.tzinfo is None else round(t.timestamp() * 1_000_000)


class FirstDelivery(StatefulProcessor):
    """By delivery id: when it was let through last, kept for the window and then forgotten by a timer."""

    def __init__(self, window_seconds: int, names: list[str]) -> None:
        self.window, self.names = window_seconds * 1_000_000, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        until = self.seen.get()[0] if self.seen.exists() else None
        before = until
        for r in sorted(rows, key=lambda r: (r.micro, r.place)):
            if until is None or r.micro >= until:
                yield Row(**{n: r[n] for n in self.names})
                until = None if r.failed else r.micro + self.window
        if until == before:
            return
        if before is not None:
            self.handle.deleteTimer(-(-before // 1000))
        if until is None:
            self.seen.clear()
        else:
            self.seen.update((until,))
            self.handle.registerTimer(-(-until // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_deliveries(deliveries: DataFrame, window_seconds: int, late_minutes: int = 0) -> DataFrame:
    """Of a stream (delivery_id, place, ts, failed, ...) the deliveries that are to be handled.

    A delivery goes through if its id hasn't gone through within the window before; one that doesn't go through doesn't
    prolong the window. A delivery whose handling failed is not remembered, so that it can be sent again. Within an id the
    order is that of ts and place. Rows later than the watermark are left to the guard on content (one outcome for a merge).
    State is one number for each id of the last window.
    """
    rows = deliveries.withColumn("micro", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", f"{late_minutes} minutes")
    keyed = rows.where("delivery_id is not null").groupBy("delivery_id")
    return keyed.transformWithState(statefulProcessor=FirstDelivery(window_seconds, deliveries.columns), outputStructType=deliveries.schema, outputMode="Append", timeMode="EventTime")


#: What the processor is given of a line, packed, and what it gives: lists of a session's messages, at most so many in a row.
LINE = ("stream", "message_id", "place", "micro", "input_tok", "output_tok")
MESSAGES = "session string, streams array<string>, ids array<string>, firsts array<long>, lasts array<long>, lines array<long>, inputs array<long>, outputs array<long>"
MOST_IN_A_ROW = 4096


class HeldBack(StatefulProcessor):
    """By session: the messages still open, one a stream, and the ids of those finished last, as one value.

    A cell of a row and a call to the state store cost more than what is done with them, so lines come in packed, messages
    go out as lists, and a session's state is read and written once.
    """

    def __init__(self, idle_seconds: int) -> None:
        self.idle = idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "packed string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        stored = self.held.get()
        open_, recent, last, started = json.loads(stored[0]) if stored else ((), [], None, 0)
        open_, before, out = dict(open_), last, []

        def finish(stream: str | None) -> None:
            m = open_.pop(stream)
            if m[0] is not None:
                recent.append(m[0])
                del recent[:-MOST_RECENT]
            out.append((stream, m))

        lines = json.loads(f"[{','.join(r.line for r in rows)}]")
        for r in sorted(lines, key=lambda r: (r["micro"], r.get("place", -1))):
            micro, mid, at = r["micro"], r.get("message_id"), []
            last = micro if last is None else max(last, micro)
            if mid is not None:
                if mid in recent:
                    continue  # a line of a message that is out already
                at = [s for s, m in open_.items() if m[0] == mid]
            if at:
                at = at[0]
            else:
                at = r.get("stream")
                if at in open_:
                    finish(at)
                if len(open_) == MOST_OPEN:
                    finish(min(open_, key=lambda s: open_[s][1]))
                open_[at] = [mid, started, micro, micro, 0, 0, 0]
                started += 1
            m = open_[at]
            m[2:] = min(m[2], micro), max(m[3], micro), m[4] + 1, max(m[5], r.get("input_tok", 0)), max(m[6], r.get("output_tok", 0))
            if len(out) >= MOST_IN_A_ROW:
                yield messages(key[0], out)
                out.clear()

        if out:
            yield messages(key[0], out)
        self.held.update((json.dumps([[*open_.items()], recent, last, started]),))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(-(-(before + self.idle) // 1000))
            self.handle.registerTimer(-(-(last + self.idle) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        """The session has been idle: what is open goes out, and nothing of it is kept."""
        yield messages(key[0], sorted(json.loads(self.held.get()[0])[0], key=lambda x: x[1][1]))
        self.held.clear()

    def close(self) -> None:
        pass


def messages(session: str, out: list[tuple[str | None, list]]) -> Row:
    of = lambda n: [m[n] for _, m in out]
    return Row(session=session, streams=[s for s, _ in out], ids=of(0), firsts=of(2), lasts=of(3), lines=of(4), inputs=of(5), outputs=of(6))


def held_back(rows: DataFrame, idle_seconds: int = 600, late_minutes: int = 0) -> DataFrame:
    """Of a stream of lines (session, stream, message_id, place, ts, input_tok, output_tok) the messages, each once it is whole.

    A message's lines repeat its counts, so the largest are kept. It is whole when a line of another message comes on its stream (a
    sub-agent has one of its own), or when its session has been idle; a line without a message id is a message of its own.
    A line that comes after its message went out is dropped. A session holds no more than so many open messages and
    finished ids, and nothing once it is idle.
    """
    timed = rows.withColumn("micro", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", f"{late_minutes} minutes")
    keyed = timed.where("session is not null").select("session", "event_time", F.to_json(F.struct(*LINE), {"ignoreNullFields": "true"}).alias("line")).groupBy("session")
    out = keyed.transformWithState(statefulProcessor=HeldBack(idle_seconds), outputStructType=MESSAGES, outputMode="Append", timeMode="EventTime")
    each = out.select("session", F.inline(F.arrays_zip("streams", "ids", "firsts", "lasts", "lines", "inputs", "outputs")).alias("stream", "message_id", "first", "last", "lines", "input_tok", "output_tok"))
    return each.select("session", "stream", "message_id", F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("last").alias("last_ts"), "lines", "input_tok", "output_tok")

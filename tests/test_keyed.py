"""Deliveries and held messages as streams, in several batches with restarts, against plain loops."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row

from tallyspark.sources.shared import shared_dir
from tallyspark.streaming import keyed

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, folder, schema, waves, job, name):
    """Rows that a job has written after each wave of input files, each wave by a query started anew."""
    at, out = f"{shared_dir(spark)}/{name}-{random.random()}", []
    for n, rows in enumerate(waves):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/in")
        source = spark.readStream.schema(schema).json(f"{folder}/in")
        out.append([r.asDict() for r in keyed.drained(job(source), name, at).collect()])
    return out


DELIVERY = "delivery_id string, place long, ts timestamp_ntz, failed boolean, extra string"


def test_deliveries_against_a_loop(spark, tmp_path):
    g = random.Random(4)
    rows = [(f"d{g.randrange(12)}", i, T0 + dt.timedelta(minutes=i + g.random()), g.random() < 0.2, "x") for i in range(300)]
    rows.append((None, 999, T0, False, "x"))
    waves = [rows[:100], rows[100:101], rows[101:220], rows[220:]]
    got = stream_of(spark, tmp_path, DELIVERY, waves, lambda s: keyed.first_deliveries(s, 90 * 60), "deliveries")
    until, want = {}, []
    for d, place, ts, failed, _ in rows[:300]:
        if d not in until or ts >= until[d]:
            want.append(place)
            until.pop(d, None)
            if not failed:
                until[d] = ts + dt.timedelta(minutes=90)
    assert sorted(r["place"] for r in got[-1]) == want
    assert set(got[-1][0]) == {"delivery_id", "place", "ts", "failed", "extra"}
    assert [len(x) for x in got] == [sum(p < n for p in want) for n in (100, 101, 220, 300)]


def test_forgotten_deliveries_leave_no_state(spark, tmp_path):
    """Ids beyond the window are gone from the state store, by their timers."""
    rows = [(f"d{i}", i, T0 + dt.timedelta(minutes=i), False, "x") for i in range(50)]
    at = f"{shared_dir(spark)}/state-{random.random()}"
    for wave in (rows, [("late", 99, T0 + dt.timedelta(days=9), False, "x")], [("end", 100, T0 + dt.timedelta(days=9, minutes=1), False, "x")]):
        spark.createDataFrame(wave, DELIVERY).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        keyed.drained(keyed.first_deliveries(spark.readStream.schema(DELIVERY).json(f"{tmp_path}/in"), 3600), "state", at)
    state = spark.read.format("statestore").option("stateVarName", "seen").load(f"{at}/progress")
    assert {r.key.delivery_id for r in state.select("key").collect()} <= {"late", "end"}


LINE = "session string, stream string, message_id string, place long, ts timestamp_ntz, input_tok long, output_tok long"


def held_by_loop(rows, end, idle):
    """What is out when the stream's time is end."""
    out, sessions = [], {}
    flush = lambda s: [out.append((s, k, *m)) for k, m in sorted(sessions.pop(s)["open"].items())]
    for session, stream, mid, _, ts, a, b in rows:
        s = sessions.setdefault(session, {"open": {}, "recent": [], "last": ts})
        s["last"] = max(s["last"], ts)
        if mid is not None and mid in s["recent"]:
            continue
        at = next((k for k, m in s["open"].items() if mid is not None and m[0] == mid), stream)
        m = s["open"].get(at)
        if m and (mid is None or m[0] != mid):
            out.append((session, at, *m))
            s["recent"] = [*s["recent"], *([m[0]] if m[0] else [])][-64:]
            m = None
        m = m or (mid, ts, ts, 0, 0, 0)
        s["open"][at] = (mid, min(m[1], ts), max(m[2], ts), m[3] + 1, max(m[4], a or 0), max(m[5], b or 0))
    for s in list(sessions):
        if sessions[s]["last"] + idle <= end:
            flush(s)
    return sorted(out, key=repr)


def test_messages_against_a_loop(spark, tmp_path):
    g = random.Random(9)
    rows, at = [], T0
    for i in range(400):
        at += dt.timedelta(seconds=g.randrange(1, 20))
        s = f"s{i // 100}-{g.randrange(3)}"  # sessions end as others begin
        rows.append((s, g.choice(["main", "main", "agent"]), g.choice([None, *[f"m{i // 8}-{k}" for k in range(2)]]), i, at, g.choice([None, g.randrange(100)]), g.randrange(50)))
    got = stream_of(spark, tmp_path, LINE, [rows[:150], rows[150:155], rows[155:300], rows[300:]], lambda s: keyed.held_back(s, 900), "held")
    plain = lambda r: (r["session"], r["stream"], r["message_id"], r["first_ts"], r["last_ts"], r["lines"], r["input_tok"], r["output_tok"])
    assert sorted(map(plain, got[-1]), key=repr) == held_by_loop(rows, at, dt.timedelta(seconds=900))
    assert [len(x) for x in got] == sorted(len(x) for x in got) and len(got[0]) < len(got[-1])


def test_a_session_without_more_lines_is_released_by_time(spark, tmp_path):
    line = lambda s, m, minute, n=0: (s, "main", m, n, T0 + dt.timedelta(minutes=minute), 5, 7)
    got = stream_of(spark, tmp_path, LINE, [[line("a", "m1", 0), line("a", "m1", 1)], [line("b", "m2", 5)], [line("b", "m2", 20)]], lambda s: keyed.held_back(s, 600), "idle")
    assert [len(x) for x in got] == [0, 0, 1]
    assert (got[2][0]["session"], got[2][0]["lines"]) == ("a", 2)


@pytest.mark.parametrize("n", [keyed.MOST_OPEN + 3])
def test_open_messages_are_bounded(spark, tmp_path, n):
    rows = [("a", f"agent{i}", f"m{i}", i, T0 + dt.timedelta(seconds=i), 1, 1) for i in range(n)]
    got = stream_of(spark, tmp_path, LINE, [rows], lambda s: keyed.held_back(s, 600), "open")
    assert sorted(r["message_id"] for r in got[0]) == ["m0", "m1", "m2"]


def test_one_state_value_is_read_and_written_once():
    """However many lines a session has in a batch, the processor makes three calls to the state store, or four with a timer to move."""
    calls = []

    class Value:
        packed = None

        def get(self):
            calls.append("get")
            return self.packed

        def update(self, value):
            calls.append("update")
            self.packed = value

    class Handle:
        value = Value()

        def getValueState(self, *_):  # noqa: N802
            return self.value

        def registerTimer(self, at):  # noqa: N802
            calls.append("register")

        def deleteTimer(self, at):  # noqa: N802
            calls.append("delete")

    job = keyed.HeldBack(600)
    job.init(Handle())
    line = lambda i: Row(session="a", line=json.dumps({"stream": f"s{i % 3}", "message_id": f"m{i // 3}-{i % 3}", "place": i, "micro": i * 1000}))
    first = [*job.handleInputRows(("a",), map(line, range(15_000)), None)]
    assert calls == ["get", "update", "register"]
    assert [len(r.ids) for r in first] == [4096, 4096, 4096, 14_997 - 3 * 4096]
    assert [x for r in first for x in r.firsts] == [i * 1000 for i in range(14_997)]
    calls.clear()
    again = [*job.handleInputRows(("a",), map(line, range(15_000, 15_006)), None)]
    assert calls == ["get", "update", "delete", "register"] and [len(r.ids) for r in again] == [6]


def test_messages_without_a_stream_and_with_any_text(spark, tmp_path):
    line = lambda stream, m, n: ("a", stream, m, n, T0 + dt.timedelta(seconds=n), None, n)
    odd = 'm "1"\\, \u2028[é\n'
    got = stream_of(spark, tmp_path, LINE, [[line(None, odd, 0), line("x", odd, 1), line(None, odd, 2)], [line(None, odd, 3), line(None, "m2", 4)]], lambda s: keyed.held_back(s, 600), "odd")
    assert got[0] == []
    assert [(r["stream"], r["message_id"], r["lines"], r["output_tok"]) for r in got[1]] == [(None, odd, 4, 3)]

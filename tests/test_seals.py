"""Sealing once: races, erasures in between, gaps, floor, clock; bodies that are altered are found."""

from __future__ import annotations

import threading
from datetime import datetime, timedelta

import pytest

from tallyspark.operators import seals as s

NOW = datetime(2024, 6, 20)
HORIZON = datetime(2024, 1, 1)


@pytest.fixture
def root(tmp_path):
    return tmp_path.as_uri()


def figures(spark, factor=1, calls=None):
    def compute(periods):
        if calls is not None:
            calls.append(list(periods))
        rows = [(p, label, factor * int(p[-2:])) for p in periods if p != "2024-03" for label in ("a", "b")]
        return spark.createDataFrame(rows, "period string, label string, cost long")

    return compute


def everything(periods):
    return periods


def body(log):
    return {(r.period, r.label): r.cost for r in s.sealed(log).collect()}


def test_months_seal_in_order_once(spark, root):
    log = s.SealLog(spark, root)
    assert s.sealed(log) is None and s.altered(log) == []
    assert s.seal_through(log, figures(spark), everything, HORIZON, NOW) == ["2024-01", "2024-02", "2024-03", "2024-04", "2024-05"]
    assert s.seal_through(log, figures(spark, 7), everything, HORIZON, NOW) == []
    assert s.seal_through(s.SealLog(spark, root), figures(spark, 7), everything, HORIZON, NOW + timedelta(days=30)) == ["2024-06"]
    assert {e["rows"] for p, e in log.of("seal").items() if p == "2024-03"} == {0}
    log.read()
    assert body(log)["2024-02", "a"] == 2 and body(log)["2024-06", "b"] == 42 and len(body(log)) == 10
    assert s.altered(log) == []


@pytest.mark.parametrize(("now", "horizon", "first", "last"), [(datetime(2024, 6, 15), HORIZON, "2024-01", "2024-05"), (datetime(2024, 6, 14, 23), HORIZON, "2024-01", "2024-04"), (NOW, datetime(2024, 1, 1, 0, 0, 1), "2024-02", "2024-05")])
def test_grace_and_floor(spark, root, now, horizon, first, last):
    assert s.seal_through(s.SealLog(spark, root), figures(spark), everything, horizon, now) == s.months(first, last)


def test_the_floor_is_pinned_by_the_first_seal(spark, root):
    log = s.SealLog(spark, root)
    s.seal_through(log, figures(spark), lambda p: p[:1], datetime(2024, 2, 1), NOW)
    assert s.seal_through(log, figures(spark), lambda p: p[:1], HORIZON, NOW) == ["2024-03"]
    assert {e["floor"] for e in log.entries} == {"2024-02"}


def test_a_loser_reads_the_winners_body(spark, root):
    log = s.SealLog(spark, root)

    def slow(periods):
        s.seal_through(s.SealLog(spark, root), figures(spark, 100), everything, HORIZON, NOW)
        return figures(spark)(periods)

    assert s.seal_through(log, slow, everything, HORIZON, NOW) == []
    assert body(log)["2024-01", "a"] == 100 and len(log.entries) == 5


def test_many_writers_leave_one_seal_a_month(spark, root):
    won, failed = [], []

    def run(factor):
        try:
            won.append(s.seal_through(s.SealLog(spark, root), figures(spark, factor), everything, HORIZON, NOW))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(n,)) for n in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = s.SealLog(spark, root)
    log.read()
    assert not failed and sorted(p for w in won for p in w) == s.months("2024-01", "2024-05") == [e["period"] for e in log.entries]
    assert s.altered(log) == []


def test_an_erasure_in_between_makes_figures_anew(spark, root):
    log, calls = s.SealLog(spark, root), []

    def raced(periods):
        if len(calls) == 0:
            s.SealLog(spark, root).erased("subject", NOW)
        return figures(spark, 1 + len(calls), calls)(periods)

    assert s.seal_through(log, raced, everything, HORIZON, NOW) == s.months("2024-01", "2024-05")
    assert len(calls) == 2 and body(log)["2024-01", "a"] == 2
    assert {e["epoch"] for e in log.of("seal").values()} == {1}


def test_erasures_without_end_are_refused(spark, root):
    calls = []

    def raced(periods):
        s.SealLog(spark, root).erased("subject", NOW)
        return figures(spark, 1, calls)(periods)

    log = s.SealLog(spark, root)
    with pytest.raises(s.SealRefused) as e:
        s.seal_through(log, raced, everything, HORIZON, NOW)
    assert e.value.code == "erase_raced" and len(calls) == s.ATTEMPTS and not log.of("seal")


def test_gaps(spark, root):
    log = s.SealLog(spark, root)
    refused = lambda *a: pytest.raises(s.SealRefused, match=a[0])
    with refused("not_next"):
        log.gap("2024-01", "internal", "nothing is sealed yet", NOW)
    s.seal_through(log, figures(spark), lambda p: [x for x in p if x < "2024-03"], HORIZON, NOW)
    for period, category, reason, code in [("2024-02", "internal", "x", "sealed"), ("2024-04", "internal", "x", "not_next"), ("2024-03", "odd", "x", "invalid"), ("2024-03", "internal", "  ㅤ", "invalid"), ("2024-03", "internal", "a\nb", "invalid"), ("2024-06", "internal", "still open", "invalid")]:
        with refused(code):
            log.gap(period, category, reason, NOW)
    with refused("clock_behind"):
        log.gap("2024-03", "source_behind", "poller lost a day", NOW - timedelta(days=1))
    log.gap("2024-03", "source_behind", "poller lost a day", NOW)
    with refused("gapped"):
        log.gap("2024-03", "source_behind", "again", NOW)
    assert s.seal_through(log, figures(spark), everything, HORIZON, NOW) == ["2024-04", "2024-05"]
    with refused("clock_behind"):
        s.seal_through(log, figures(spark), everything, HORIZON, NOW - timedelta(days=3))


def test_altered_bodies_are_found(spark, root):
    log = s.SealLog(spark, root)
    s.seal_through(log, figures(spark), everything, HORIZON, NOW)
    e = log.of("seal")["2024-02"]
    spark.createDataFrame([("a", 2), ("b", 3)], "label string, cost long").coalesce(1).write.mode("overwrite").parquet(f"{root}/bodies/body={e['body']}/period=2024-02")
    assert s.altered(log) == ["2024-02"]


def test_sources_certify_months(spark):
    runs = [("a", datetime(2024, 1, 1), datetime(2024, 4, 1)), ("a", datetime(2024, 4, 2), datetime(2024, 7, 1)), ("b", datetime(2023, 1, 1), datetime(2024, 6, 30))]
    coverage = spark.createDataFrame(runs, "source string, covered_from timestamp_ntz, settled_through timestamp_ntz")
    assert s.certified(coverage, s.months("2024-01", "2024-06")) == s.months("2024-01", "2024-03")
    assert s.certified(coverage, s.months("2024-05", "2024-06")) == ["2024-05"]
    lost = spark.createDataFrame([("b", datetime(2024, 2, 3), datetime(2024, 2, 4))], "source string, lost_from timestamp_ntz, lost_through timestamp_ntz")
    assert s.certified(coverage, s.months("2024-01", "2024-03"), lost) == ["2024-01"]
    assert s.certified(coverage, []) == []

"""Aggregates over spans of time against all pairs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyspark.operators import ledgers, quality, recovery
from tallyspark.operators.ranges import within

DAY = datetime(2024, 1, 1)


def sample(n: int, seed: int) -> list[tuple]:
    draw = random.Random(seed)
    return [(i, draw.choice(["a", "a", "a", "b", None]), DAY + timedelta(minutes=draw.randrange(600)) if draw.random() < 0.95 else None) for i in range(n)]


def test_within(spark):
    probes, facts = sample(300, 1), sample(300, 2)
    p = spark.createDataFrame(probes, "id long, key string, ts timestamp_ntz")
    f = spark.createDataFrame(facts, "low long, key string, ts timestamp_ntz").withColumns({"high": F.col("low"), "total": F.col("low")})
    how = {"low": "min", "high": "max", "total": "sum"}
    for ahead in (False, True):
        got = {r.id: (r.low, r.high, r.total) for r in within(p, f, ["key"], "ts", 30 * 60_000_000, how, ahead=ahead).collect()}
        assert len(got) == 300
        for i, key, ts in probes:
            near = [j for j, k, t in facts if None not in (key, ts, t) and k == key and timedelta(0) <= ts - t <= timedelta(minutes=30)]
            if ahead:
                near += [j for j, k, t in facts if None not in (key, ts, t) and k == key and timedelta(0) < t - ts <= timedelta(minutes=30)]
            assert got[i] == ((min(near), max(near), sum(near)) if near else (None, None, 0))


def test_within_empty(spark):
    p = spark.createDataFrame(sample(5, 1), "id long, key string, ts timestamp_ntz")
    assert within(p, p.limit(0).withColumnRenamed("id", "low"), ["key"], "ts", 1000, {"low": "min"}).where("low is null").count() == 5
    assert within(p.limit(0), p.withColumnRenamed("id", "low"), ["key"], "ts", 1000, {"low": "min"}).count() == 0


def test_reruns_with_equal_times(spark):
    rows = [("ci_fail", "s", "w", 1, DAY), ("ci_pass", "s", "w", 2, DAY), ("ci_pass", "s", "w", 1, DAY), ("ci_pass", "s", "w", 3, DAY + timedelta(minutes=30)), ("ci_pass", "s", "w", 4, DAY + timedelta(minutes=31)), ("ci_pass", None, "w", 2, DAY)]
    e = spark.createDataFrame(rows, "event_type string, head_sha string, workflow_id string, attempt int, event_ts timestamp_ntz")
    assert sorted(r.attempt for r in quality.reruns(e).collect()) == [2, 3]


def test_reverted_outcome(spark):
    o = spark.createDataFrame([(1, "r", DAY, "x"), (2, "r", DAY + timedelta(days=50), "y")], "id long, repo string, ts timestamp_ntz, merge_sha string")
    asked = [(1, "r", DAY + timedelta(days=40), None), (2, "r", DAY + timedelta(days=55), None), (3, "r", DAY + timedelta(days=90), None), (4, "r", DAY + timedelta(days=55), "x"), (5, "r", DAY + timedelta(days=40), "gone")]
    rv = spark.createDataFrame(asked, "event long, repo string, ts timestamp_ntz, sha string")
    got = {r.event: (r.candidates, r.outcome_id) for r in recovery.reverted_outcome(rv, o, ["repo"]).collect()}
    assert got == {1: (1, 1), 2: (2, None), 3: (1, 2), 4: (1, 1), 5: (0, None)}


def test_followed_needs_another_outcome(spark):
    rows = [(1, "r", "b", DAY), (2, "r", "b", DAY + timedelta(days=14)), (3, "r", "c", DAY), (3, "r", "c", DAY), (4, "r", "d", DAY), (5, "r", "d", DAY)]
    o = spark.createDataFrame(rows, "id long, repo string, head_branch_hash string, merged_at timestamp_ntz")
    assert sorted(r.id for r in recovery.followed(o).collect()) == [1, 4, 5]


def test_places(spark):
    rows = [(i, DAY + timedelta(hours=i * 7 % 100)) for i in range(60)]
    got = {r.id: r.place for r in ledgers.places(spark.createDataFrame(rows, "id long, ts timestamp_ntz"), "ts", "id").collect()}
    assert [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))] == sorted(got, key=got.get)


def test_claims_against_all_pairs(spark):
    draw = random.Random(5)
    at = lambda: DAY + timedelta(days=draw.randrange(40))
    merges = [(i, "r", draw.choice(["m", "n", None]), i % 7, f"issue-{i % 9}", (t := at()) - timedelta(days=draw.randrange(12)), t) for i in range(60)]
    o = spark.createDataFrame(merges, "id long, repo string, head_branch_hash string, pr_number long, issue_id string, created_at timestamp_ntz, merged_at timestamp_ntz")
    spent = [(i, "r", draw.choice(["m", "n", "gone", None]), i % 9, draw.choice(["unattributed:main", "issue-1"]), at(), 1) for i in range(200)]
    e = spark.createDataFrame(spent, "id long, repo string, branch_hash string, pr_number long, issue_id string, ts timestamp_ntz, cost_micro long")
    start = {r.id: r.window_start for r in recovery.branch_windows(o).collect()}
    want = sorted(
        (x[0], m[0])
        for x in spent
        for m in merges
        if x[4].startswith("un") and start[m[0]] <= x[5] <= m[6] and (x[2] == m[2] if x[2] else x[3] == m[3])
    )
    assert want and sorted((r.id, r.outcome_id) for r in recovery.claims(e, o).collect()) == want


def test_source_runs_over_days(spark):
    hour = lambda h: DAY + timedelta(hours=h)
    rows = [("a", 0, 1), ("a", 0, 60), ("a", 23, 23), ("a", 50, 55), ("a", 60, 61), ("a", 62, 63), ("a", 90, 91), ("b", 5, 6), ("b", 6, 7)]
    runs = spark.createDataFrame([(s, hour(x), hour(y)) for s, x, y in rows], "source string, covered_from timestamp_ntz, settled_through timestamp_ntz")
    got = {(r.source, r.island): (r.covered_from, r.settled_through, r.runs) for r in recovery.source_runs(runs).collect()}
    assert got == {("a", 1): (hour(0), hour(61), 5), ("a", 2): (hour(62), hour(63), 1), ("a", 3): (hour(90), hour(91), 1), ("b", 1): (hour(5), hour(7), 2)}

"""Decisions on reverts against a reading one by one."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import reverts as R

REVERTS = "sha string, repo string, issue_id string, ts timestamp_ntz, message string, merge_push boolean"
OUTCOMES = "id long, repo string, issue_id string, ts timestamp_ntz, merge_sha string"
PRIOR = "outcome_id long, event_type string, source_ref string"
T = datetime(2024, 5, 1)
WINDOW = timedelta(days=60)


def sha(n):
    return f"{n:040x}"


def one_by_one(reverts, outcomes, prior):
    out, marks = {}, {}
    for s, repo, issue, ts, message, merges in reverts:
        near = [o for o in outcomes if repo and repo != R.UNQUALIFIED and o[1] == repo and issue and o[2] == issue and ts and ts - WINDOW <= o[3] <= ts]
        legacy = [o for o in outcomes if (o[1] or R.UNQUALIFIED) == R.UNQUALIFIED and issue and o[2] == issue and ts and ts - WINDOW <= o[3] <= ts]
        m = re.search(R.FOOTER, message or "")
        if m:
            o = min((o for o in outcomes if o[4] == m[1]), default=None)
            out[s] = (None, "footer_unresolved", 0) if o is None else (None, "late", 1) if ts and ts > o[3] + WINDOW else (o[0], "resolved", 1)
        elif merges:
            out[s] = (None, "merge_push", 0)
        elif len(near) > 1:
            out[s] = (None, "ambiguous", len(near))
            for o in near:
                marks.setdefault(o[0], []).append((ts, s))
        elif near:
            out[s] = (None, "ambiguous", 1) if (near[0][0], "revert_ambiguous", s) in prior else (near[0][0], "resolved", 1)
        else:
            out[s] = (None, "legacy_only" if legacy else "no_candidate", 0)
    return out, {i: (len(v), min(v)[1]) for i, v in marks.items()}


def check(spark, reverts, outcomes, prior=()):
    r, o = spark.createDataFrame(reverts, REVERTS).withColumn("id", F.lit("x")), spark.createDataFrame(outcomes, OUTCOMES)
    d = R.decided(r.unionAll(r), o, spark.createDataFrame(list(prior), PRIOR))
    got = {x.sha: x for x in d.collect()}
    want, marks = one_by_one(reverts, outcomes, prior)
    assert {s: (x.outcome_id, x.reason, x.candidates) for s, x in got.items()} == want
    assert {x.id: (x.reverts, x.first_revert) for x in R.doubted(d, r, o).collect()} == marks
    return got


def test_rules(spark):
    day = lambda n: T + timedelta(days=n)
    outcomes = [(1, "a/x", "i1", day(0), sha(1)), (2, "a/x", "i2", day(0), sha(2)), (3, "a/x", "i2", day(60), sha(3)), (4, None, "i3", day(0), None), (5, R.UNQUALIFIED, "i4", day(0), sha(5))]
    reverts = [
        ("in", "a/x", "i1", day(60), "a regression", False), ("out", "a/x", "i1", day(60) + timedelta(microseconds=1), "", False), ("two", "a/x", "i2", day(60), "", False), ("foot", "b/y", None, day(60), f"this REVERTS commit {sha(1)}.", True),
        ("late", "a/x", "i2", day(61), f"This reverts commit {sha(1)}", False), ("gone", "a/x", "i1", day(1), f"This reverts commit {sha(9)}", False), ("push", "a/x", "i1", day(1), "", True), ("old", "a/x", "i3", day(1), "", False),
        ("self", R.UNQUALIFIED, "i4", day(1), "", None), ("none", "a/x", None, day(1), None, False), ("when", "a/x", "i1", None, None, False), ("long", "a/x", "i1", day(1), f"This reverts commit {sha(1)}0", False), ("seen", "a/x", "i1", day(2), "", False),
    ]
    got = check(spark, reverts, outcomes, [(1, "revert_ambiguous", "seen"), (1, "revert_quality", "in")])
    assert {s: x.reason for s, x in got.items()} == {"in": "resolved", "out": "no_candidate", "two": "ambiguous", "foot": "resolved", "late": "late", "gone": "footer_unresolved", "push": "merge_push", "old": "legacy_only", "self": "legacy_only", "none": "no_candidate", "when": "no_candidate", "long": "resolved", "seen": "ambiguous"}
    assert got["in"].event_type == "revert_quality" and got["two"].event_type is None


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    r = random.Random(seed)
    when = lambda: T + timedelta(days=r.randrange(400))
    outcomes = [(i, r.choice(["a/x", "a/y", R.UNQUALIFIED, None]), f"i{r.randrange(9)}", when(), sha(i) if r.random() < 0.7 else None) for i in range(300)]
    reverts = [(f"v{i}", r.choice(["a/x", "a/y", None]), f"i{r.randrange(9)}", when(), r.choice(["", "", f"This reverts commit {sha(r.randrange(330))}"]), r.random() < 0.1) for i in range(240)]
    prior = [(r.randrange(300), "revert_ambiguous", f"v{r.randrange(240)}") for _ in range(2000)]
    got = check(spark, reverts, outcomes, prior)
    assert {x.reason for x in got.values()} >= {"resolved", "ambiguous", "late", "no_candidate"}
    assert sum(x.candidates > 1 for x in got.values()) > 20


def test_empty(spark):
    assert check(spark, [], []) == {}

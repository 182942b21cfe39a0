"""Commands on relations: each transition, each refusal, replays; and points that refuse a missing projection."""

from __future__ import annotations

import datetime as dt

import pytest

from tallyspark.operators import lifecycle as c

T0 = dt.datetime(2024, 1, 1)
RELATIONS = "relation long, state string, child_developer string, captured boolean"
COMMANDS = "relation long, seq long, at timestamp_ntz, action string, actor string, role string, reason string, revision long, review struct<original:string,own:string,before:string,after:string,pure:boolean,revision:long,reviewer:string>"


def review(revision, who="olga", sizes=("5", "1", "3", "5"), pure=False):
    return (*sizes, pure, revision, who)


def told(spark, commands, state="declared", child="ada", captured=True):
    rows = [(1, k, T0 + dt.timedelta(minutes=k), *x) for k, x in enumerate(commands)]
    got = c.run(spark.createDataFrame([(1, state, child, captured)], RELATIONS), spark.createDataFrame(rows, COMMANDS)).collect()
    return [(r.why or r.state) for r in sorted(got, key=lambda r: r.seq)]


def cmd(action, revision, actor="olga", role="operator", reason="because", **sizes):
    sized = action in ("confirm", "settle-re-assess")
    return action, actor, role, reason, revision, review(revision, actor, **sizes) if sized else None


def test_a_life(spark):
    life = [cmd("confirm", 1), cmd("dispute", 2, "ben", "author"), cmd("settle-uphold", 3), cmd("withdraw", 4, "ada", "author"), cmd("settle-re-assess", 5), cmd("dispute", 6), cmd("settle-remove", 7), cmd("dispute", 8), cmd("confirm", 8)]
    assert told(spark, life) == ["confirmed", "disputed", "confirmed", "withdrawn-confirmed", "confirmed", "disputed", "removed", "inactive", "needs-settlement"]
    assert told(spark, [cmd("dispute", 1), cmd("confirm", 2), cmd("withdraw", 2), cmd("settle-uphold", 2), cmd("withdraw", 3), cmd("settle-remove", 4)]) == ["disputed-declared", "needs-settlement", "not-withdrawable", "declared", "withdrawn", "not-disputed"]


def test_what_is_refused(spark):
    off = {"sizes": ("5", "2", "3", "5")}
    commands = [
        cmd("confirm", 1, role="author"), cmd("confirm", 1, "ADA"), cmd("confirm", 2), cmd("confirm", 1, **off), cmd("confirm", 1, sizes=("5", "1", None, None)), cmd("erase", 1), cmd("dispute", 1, reason=" "), cmd("dispute", 1, actor=""),
        cmd("dispute", 0), ("confirm", "olga", "operator", "", 1, None), ("confirm", "olga", "operator", "", 1, review(1, "eve")), ("dispute", "olga", "operator", "x", 1, review(1)), cmd("dispute", 1, actor="x" * 129), cmd("confirm", 1, sizes=("5", "1", "3", "5"), pure=True),
    ]
    assert told(spark, commands) == [
        "operator-required", "own-declaration", "stale-or-erased", "review-off-scale", "review-off-scale", "unknown-action", "reason-required", "actor-and-role-required",
        "revision-required", "review-required", "review-of-another", "review-not-accepted", "actor-and-role-required", "review-off-scale",
    ]
    assert told(spark, [cmd("confirm", 1)], captured=False) == ["outcome-not-captured"]
    assert told(spark, [cmd("dispute", 1)], child=None) == ["stale-or-erased"]
    assert told(spark, [cmd("confirm", 1, sizes=("5", "1", None, None), pure=True)]) == ["confirmed"]


def test_a_command_sent_twice_is_known_again(spark):
    assert told(spark, [cmd("dispute", 1), cmd("dispute", 1), cmd("dispute", 1, reason="other"), cmd("settle-uphold", 2), cmd("dispute", 1)]) == ["disputed-declared", "replay", "conflicting-replay", "declared", "replay"]


def test_relations_are_apart_and_states_are_last(spark):
    relations = spark.createDataFrame([(i, "declared", "ada", True) for i in range(40)], RELATIONS)
    rows = [(i, k, T0 + dt.timedelta(minutes=k), *cmd("dispute" if (i + k) % 2 else "withdraw", k + 1, "ben", "author")) for i in range(1, 41) for k in range(3)]
    done = c.run(relations, spark.createDataFrame(rows, COMMANDS))
    got = {r.relation: (r.state, r.revision) for r in c.states(relations, done).collect()}
    assert got[0] == ("declared", 1) and got[1] == ("disputed-declared", 2) and got[2] == ("withdrawn", 2)
    assert [r.why for r in done.where("relation = 40").collect()] == ["no-relation"] * 3
    assert c.run(relations, spark.createDataFrame([], COMMANDS)).count() == 0


def test_points_by_projection(spark):
    o = spark.createDataFrame([(1, 5.0, 0.7), (2, 1.0, 1.0)], "id long, weight double, quality double")
    p = lambda rows: spark.createDataFrame(rows, "id long, points double, quality double, eligible string, rule string")
    good = [(1, 2.25, 0.55, "ineligible", "event3-v2"), (2, 0.0, 1.0, "eligible", "event3-v1")]
    assert {r.id: r.points for r in c.effective(o, p([]), False).collect()} == {1: 3.5, 2: 1.0}
    assert {r.id: (r.points, r.eligible) for r in c.effective(o, p(good), True).collect()} == {1: (2.25, "ineligible"), 2: (0.0, "eligible")}
    for bad in (good[:1], [good[0], (2, -1.0, 1.0, "eligible", "event3-v1")], [good[0], (2, 1.0, 1.5, "eligible", "event3-v1")], [good[0], (2, float("nan"), 1.0, "eligible", "event3-v1")], [good[0], (2, 1.0, 1.0, "maybe", "event3-v1")], [good[0], (2, 1.0, 1.0, "eligible", "other")]):
        with pytest.raises(Exception, match="no sound projection for outcome 2"):
            c.effective(o, p(bad), True).collect()

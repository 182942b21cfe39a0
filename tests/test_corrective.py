"""Stories of repairs with fractions worked by hand."""

from __future__ import annotations

import datetime as dt
from fractions import Fraction as Q

import pytest

from tallyspark.operators import corrective as c


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def change(id_, who, weight, links=(), day=None, quality="1", effort=None):
    return c.Change(id_, who, at(id_ - 100 if day is None else day), Q(weight), Q(quality), effort, list(links), ("r", id_, ""))


def points(*changes):
    return {r.id: str(r.points) for r in c.settled(changes)}


def link(state, own="1", before="5", after="5", pure=False, parent=101):
    return c.Link(parent, state, c.Review(Q(own), Q(before), Q(after), pure=pure))


@pytest.mark.parametrize(("state", "first", "second"), [("confirmed", "13/4", "1"), ("disputed", "13/4", "1"), ("withdrawn-confirmed", "13/4", "1"), ("declared", "5", "1"), ("removed", "5", "1")])
def test_another_authors_repair_charges_once_confirmed(state, first, second):
    assert points(change(101, "ada", 5), change(102, "ben", 1, [link(state)])) == {101: first, 102: second}


def test_own_repair_counts_while_declared():
    sized = [change(101, "ada", 5, effort=900), change(102, "ada", 1, [c.Link(101, "declared")], effort=10)]
    assert points(*sized) == {101: "13/4", 102: "1"}
    assert points(change(101, "ada", 5), change(102, "ada", 1, [c.Link(101, "declared")])) == {101: "5", 102: "1"}


def test_the_fixers_own_quality_is_its_own():
    assert points(change(101, "ada", 5), change(102, "ben", 1, [link("confirmed")], quality="7/10")) == {101: "13/4", 102: "7/10"}


def test_growth_is_credited_and_late_repairs_leave_quality():
    grown = [change(101, "ada", 3), change(102, "ben", 3, [link("confirmed", "3", "3", "5")], day=30)]
    assert points(*grown) == {101: "2", 102: "3"}  # 3 + 2 of growth - 3 owned
    assert [r.eligible for r in c.settled(grown)] == ["eligible", "eligible"]


def test_a_tenth_is_kept():
    assert points(change(101, "ada", 1), change(102, "ben", 5, [link("confirmed", "5", "1", "1")])) == {101: "1/10", 102: "3/4"}


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ([change(101, "a", 5, [c.Link(102, "confirmed")], day=1), change(102, "a", 5, [c.Link(101, "confirmed")], day=1)], "cycle"),
        ([change(102, "a", 5, [c.Link(101, "confirmed")])], "missing-or-excluded-parent"),
        ([change(101, "a", 5, day=9), change(102, "a", 1, [c.Link(101, "confirmed")], day=1)], "parent-after-child"),
        ([change(101, "a", 5), change(102, "a", 2, [c.Link(101, "confirmed")])], "unsupported-allocation-shape"),
        ([change(101, "a", 5), change(102, "a", 1, [c.Link(101, "odd")])], "unsupported-relation-state"),
    ],
)
def test_what_is_wrong_stays_pending_with_its_own_points(changes, reason):
    last = {r.id: r for r in c.settled(changes)}[102]
    assert (last.status, last.reason, last.points) == ("pending", reason, last.share * last.quality)


def test_several_originals_take_the_least_for_their_developer():
    story = [change(101, "ada", 8, effort=5000), change(102, "ada", 1, effort=20), change(103, "ada", 1, [c.Link(101, "declared"), c.Link(102, "declared")], effort=1)]
    results = {r.id: r for r in c.settled(story)}
    assert results[103].reason == "multiple-originals" and results[103].eligible == "unknown"
    assert sum(r.points for r in results.values()) <= 10


def test_spark_groups(spark):
    schema = "component long, id long, repo string, pr int, sha string, developer string, merged_at timestamp, weight string, quality string, effort long, links array<struct<parent:long,state:string,own:string,before:string,after:string,original:string,pure:boolean>>"
    rows = [(1, 101, "r", 1, "a", "ada", at(1), "5", "1", None, []), (1, 102, "r", 2, "b", "ben", at(2), "1", "1", None, [(101, "confirmed", "1", "5", "5", None, False)]), (7, 9, "r", 3, "c", "eve", None, "1/2", "7/10", None, None)]
    got = {r.id: (r.points, r.status) for r in c.settle_components(spark.createDataFrame(rows, schema)).collect()}
    assert got == {101: ("13/4", "resolved"), 102: ("1", "resolved"), 9: ("7/20", "resolved")}


def test_a_long_chain_is_walked_without_recursion():
    """Parents merged after their children, so that the walk begins at the chain's end."""
    n = 3000
    story = c.Story([change(i, "ada", 1, [c.Link(i - 1, "confirmed")] if i > 1 else [], day=n - i) for i in range(1, n + 1)])
    assert set(story.origins.values()) == {frozenset({1})}
    assert {i for i, why in story.problem.items() if why == "parent-after-child"} == set(range(2, n + 1))


def test_a_cycle_reaches_all_that_build_on_it():
    on = lambda i, parent: change(i, "ada", 1, [c.Link(parent, "confirmed")], day=0)
    story = c.Story([on(1, 3), on(2, 1), on(3, 2), on(4, 3)])
    assert story.problem == dict.fromkeys((1, 2, 3, 4), "cycle")

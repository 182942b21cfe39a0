"""Inputs, bounds and comparison of interval estimates."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import intervals

ROWS = "developer string, id long, points double, cost double"
FIXED = "developer string, fixed double, fixed_points double, shown boolean"


def events(spark, rows):
    return spark.createDataFrame(rows, "developer string, issue_id string, repo string, cost_micro long").withColumn("fidelity", F.lit("realtime"))


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "id long, developer string, issue_id string, repo string, points20 long, eligible boolean")


def test_costs_are_scaled_to_the_total(spark):
    o = outcomes(spark, [(1, "d", "i", "a/x", 20, True), (2, "d", "i", "a/y", 20, True)])
    got = intervals.issue_shares(o, events(spark, [("d", "i", "unqualified", 100)])).collect()
    assert [(r.each_micro, r.fixed_micro, r.shown) for r in got] == [(50.0, 0.0, True)] * 2


def test_ineligible_outcomes_are_fixed(spark):
    o = outcomes(spark, [(1, "d", "i", "a/x", 20, True), (2, "d", "i", "a/x", 7, False), (3, "e", "j", "a/x", 5, False)])
    e = events(spark, [("d", "i", "a/x", 100), ("d", "other", "a/x", 30), ("e", "j", "a/x", 10)])
    got = {r.developer: (r.each_micro, r.fixed_micro, r.fixed20, r.shown) for r in intervals.issue_shares(o, e).collect()}
    assert got == {"d": (50.0, 80.0, 7, False), "e": (10.0, 10.0, 5, False)}
    rows, fixed = intervals.interval_rows(o, e)
    assert [r.id for r in rows.collect()] == [1]


def test_no_cost_and_no_rows(spark):
    fixed = spark.createDataFrame([("d", 0.0, 0.0, False)], FIXED)
    rows = spark.createDataFrame([("d", 1, 3.0, 0.0), ("d", 2, 1.0, 0.0)], ROWS)
    assert [(r.n, r.lo, r.hi, r.cpp_lo) for r in intervals.intervals(rows, fixed).collect()] == [(2, 0.0, 0.0, 0.0)]
    assert intervals.intervals(rows.limit(0), fixed).count() == 0


@pytest.mark.parametrize("part", [intervals.PART, 50])
def test_parts_draw_like_the_whole(spark, part):
    rng = np.random.default_rng(3)
    points, cost = rng.integers(1, 160, 600) / 20, rng.gamma(2.0, 3.0, 600)
    rows = spark.createDataFrame([("d", i, float(p), float(c)) for i, (p, c) in enumerate(zip(points, cost))] + [("few", 1, 2.0, 5.0)], ROWS)
    fixed = spark.createDataFrame([("d", 400.0, 10.0, True), ("few", 5.0, 0.0, True)], FIXED)
    got = {r.developer: r for r in intervals.intervals(rows, fixed, part).collect()}
    at = rng.integers(0, 600, (4000, 600))
    ratios = (points[at].sum(axis=1) + 10) / (cost[at].sum(axis=1) + 400) * 1000
    lo, hi = np.quantile(ratios, [0.025, 0.975])
    assert got["d"].n == 600 and abs(got["d"].lo - lo) < 0.1 * (hi - lo) and abs(got["d"].hi - hi) < 0.1 * (hi - lo)
    assert (got["few"].lo, got["few"].hi, got["few"].cpp_hi) == (200.0, 200.0, 5.0)
    assert got["d"].cpp_lo == 1000 / got["d"].hi


def test_significant_needs_rank_and_share(spark):
    side = lambda rows: spark.createDataFrame(rows, "developer string, ranked boolean, shown boolean, lo double, hi double")
    a = side([("apart", True, True, 1.0, 2.0), ("meet", True, True, 1.0, 2.0), ("unranked", False, True, 1.0, 2.0), ("hidden", True, True, 1.0, 2.0), ("once", True, True, 1.0, 2.0)])
    b = side([("apart", True, True, 2.5, 3.0), ("meet", True, True, 2.0, 3.0), ("unranked", True, True, 5.0, 6.0), ("hidden", True, False, 5.0, 6.0)])
    assert {r.developer: r.disjoint for r in intervals.significant(a, b).collect()} == {"apart": True, "meet": False, "unranked": False, "hidden": False}

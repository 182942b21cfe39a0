"""Merge-time figures under the floor of people."""

from __future__ import annotations

from datetime import datetime, timedelta

from tallyspark.operators import scores

DAY = datetime(2024, 1, 1)
SHAPE = "id long, label string, developer string, created_at timestamp_ntz, merged_at timestamp_ntz, ts timestamp_ntz, source string, author_type string"


def merged(spark, rows):
    """Rows (label, developer, seconds to merge), or None for no time of opening."""
    made = [(i, label, dev, None if s is None else DAY, DAY + timedelta(seconds=s or 0), DAY, "api-outcome", "Bot" if dev == "bot" else "User") for i, (label, dev, s) in enumerate(rows)]
    return spark.createDataFrame(made, SHAPE)


def figures(spark, rows, named=("a", "b"), **more):
    o = merged(spark, rows)
    got = scores.time_to_merge(o, spark.createDataFrame([(x,) for x in named], "label string"), **more).collect()
    return {(r.kind, r.name): (r.n, r.median_s, r.p90_s, r.null_reason) for r in got}


def test_medians_percentiles_and_exclusions(spark):
    a = [("a", f"p{i % 3}", i + 0.9) for i in range(10)]
    got = figures(spark, a + [("b", "x", 10), ("b", "y", 20.5), ("b", "z", 41), ("b", "z", 50), ("a", "bot", 5), ("a", "p1", None), ("a", "p1", -5)])
    assert got[("group", "a")] == (10, 5, 8, None)
    assert got[("group", "b")] == (4, 30, None, "n<10")
    assert got[("total", "")] == (14, 7, 41, None)
    assert got[("excluded", "bot")][0] == 1 and got[("excluded", "no_created_at")][0] == 2


def test_a_hidden_cohort_withholds_the_total(spark):
    got = figures(spark, [("a", p, 5) for p in "xyz"] + [("c", "only", 9)])
    assert got[("residual", "other")] == (None, None, None, "authors<k")
    assert got[("total", "")] == (None, None, None, "withheld_with_group")
    assert got[("group", "a")][:2] == (3, 5)


def test_unsafe_scores_show_nothing(spark):
    got = figures(spark, [("a", p, 5) for p in "xyz"] + [("a", "bot", 1)], safe=False)
    assert set(got) == {("total", ""), ("excluded", "bot")} and got[("total", "")][3] == "withheld_with_group" and got[("excluded", "bot")][0] is None


def test_no_outcomes(spark):
    assert figures(spark, []) == {}

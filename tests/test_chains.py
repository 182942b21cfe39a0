"""Chains as dataflow against stories settled whole, on random stories of all kinds."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyspark.operators import chains, corrective

SCHEMA = "id long, repo string, pr int, sha string, developer string, merged_at timestamp, weight string, quality string, effort long, links array<struct<parent:long,state:string,own:string,before:string,after:string,original:string,pure:boolean>>"
T0 = dt.datetime(2024, 1, 1)


def stories(seed, count, odd):
    """Rows of count stories; odd are the chances of what is wrong in them."""
    g = random.Random(seed)
    rows, id_ = [], 0
    for _ in range(count):
        first, n = id_ + 1, g.choice([1, 1, 2, 3, 5, 9])
        for k in range(n):
            id_ += 1
            links = []
            if k:
                for p in g.sample(range(first, id_), min(k, g.choice([1, 1, 1, 1, 2, 3]) if g.random() < odd else 1)):
                    state = g.choice(["confirmed"] * 6 + ["declared", "disputed", "removed", "withdrawn-confirmed", "disputed-declared"] + (["pending", "strange"] if g.random() < odd else []))
                    size = lambda: g.choice(["1/2", "1", "3", "5", "8"])
                    before = size()
                    review = (size(), before, g.choice([before, size()]), g.choice([size(), None]), False) if g.random() < 0.5 else (None, None, None, None, False)
                    if review[0] and g.random() < 0.2:
                        review = (review[0], before, before, review[3], True)
                    links.append((p + (10_000 if g.random() < odd / 20 else 0), state, *review))
                if g.random() < odd / 10:
                    links.append((g.randrange(first, first + n), "confirmed", None, None, None, None, False))
            at = T0 + dt.timedelta(days=k * g.choice([1, 1, 5, 20]) if g.random() > odd / 10 else 0, seconds=id_)
            if g.random() < odd / 10:
                at = None
            rows.append((id_, "r", id_ % 7, "s", g.choice(["ada", "ada", "ben"]), at, g.choice(["1/2", "1", "3", "5", "8", "10/2"] + (["7/3"] if g.random() < odd / 2 else [])), g.choice(["1", "1", "7/10", "1/10", "4/5", "20/20"]), None if g.random() < odd / 3 else g.randrange(600), links))
    return rows


def whole(rows):
    """The same rows by stories: all in one, as stories don't touch each other."""
    Q = corrective.Q
    size = lambda x: Q(x) if x is not None else Q(0)
    review = lambda x: None if x[2] is None else corrective.Review(Q(x[2]), size(x[3]), size(x[4]), size(x[5]), x[6])
    of, parts = {}, {}
    for r in rows:
        of[r[0]] = r[0]
    def root(i):
        while of[i] != i:
            i = of[i]
        return i
    for r in rows:
        for x in r[9]:
            if x[0] in of:
                of[root(r[0])] = root(x[0])
    for r in rows:
        parts.setdefault(root(r[0]), []).append(corrective.Change(r[0], r[4], r[5], Q(r[6]), Q(r[7]), r[8], [corrective.Link(x[0], x[1], review(x)) for x in r[9]], (r[1], r[2], r[3])))
    names = [x.split()[0] for x in corrective.OUT.split(", ")]
    return {res.id: tuple(str(v) if isinstance(v := getattr(res, k), Q) else v for k in names) for p in parts.values() for res in corrective.settled(p)}


@pytest.mark.parametrize(("seed", "odd"), [(4, 1.0)])
def test_against_whole_stories(spark, seed, odd):
    rows = stories(seed, 120, odd)
    got = {r.id: tuple(r) for r in chains.settle(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = whole(rows)
    assert got.keys() == want.keys()
    assert not {i: (want[i], got[i]) for i in want if want[i] != got[i]}


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    one = [(None if i == 1 else [(i - 1, "confirmed", None, None, None, None, False)]) for i in range(1, n + 1)]
    rows = [(i, "r", 1, "s", "ada" if i % 3 else "ben", T0 + dt.timedelta(hours=i), "1", "1", 1 if i < 50 else 0, links) for i, links in enumerate(one, 1)]
    got = {r.id: r for r in chains.settle(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == n and {got[i].status for i in range(2, n + 1)} == {"provisional"}
    assert got[2].points and all(got[i].parent == i - 1 for i in range(2, n + 1))


def test_two_changes_with_one_id_are_refused(spark):
    rows = stories(5, 3, 0)
    with pytest.raises(ValueError, match="same id"):
        chains.settle(spark.createDataFrame([*rows, rows[0]], SCHEMA))


def test_nothing(spark):
    assert chains.settle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_what_orders_changes_is_kept_once(spark, monkeypatch):
    """Merge commits and repositories only order the changes; a table of every step with them was most of what was written."""
    seen, written = [], chains.written
    monkeypatch.setattr(chains, "written", lambda df, name: (seen.append((name, df.schema.simpleString())), written(df, name))[1])
    rows = [(i, "r", 1, "s" * 64, "ada", T0 + dt.timedelta(days=i), "1", "1", 10, [(i - 1, "confirmed", None, None, None, None, False)] if i % 3 else []) for i in range(1, 10)]
    got = {r.id: tuple(r) for r in chains.settle(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == whole(rows)
    assert seen and not [name for name, schema in seen if "sha:" in schema or "repo:" in schema]

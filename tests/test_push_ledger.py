"""Day rows of direct pushes against commands that are carried out one by one."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import push_ledger as P

BASE = datetime(2024, 5, 1)


def one_by_one(commands, ledger=(), unlisted=()):
    """Statuses, ledger, day rows and audit of commands in order: ('push', seq, repo, sha, issue, day, dev, ts, at) or ('merge', seq, sha)."""
    entries = {(r, s): [issue, day, dev, ts, order, i - P.EARLIER] for i, r, s, issue, day, dev, ts, order in ledger}
    rows, merged, statuses, audit = {}, set(), {}, []
    for i, r, issue, day, dev, ts in unlisted:
        rows[r, issue, day] = [dev, ts, i]

    def of(day):
        return {k: e for k, e in entries.items() if (k[0], e[0], e[1]) == day}

    def owner(day):
        e = min(of(day).items(), key=lambda x: (x[1][4], x[1][5] if x[1][4] == P.UNKNOWN else 0, x[1][3], x[0][1]))[1]
        return [e[2], e[3]]

    for day in {(k[0], e[0], e[1]) for k, e in entries.items()}:
        rows[day] = [*owner(day), None]

    def settled(day, seq, sha, dev):
        old, new = rows[day][:2], owner(day)
        if old != new:
            audit.append((*day, seq, "rederived_from", *old, sha, dev))
            audit.append((*day, seq, "rederived_to", *new, sha, dev))
            rows[day][:2] = new

    for c in commands:
        if c[0] == "merge":
            _, seq, sha = c
            merged.add(sha)
            for k in [k for k in entries if k[1] == sha]:
                e = entries.pop(k)
                day = (k[0], e[0], e[1])
                if of(day):
                    settled(day, seq, sha, e[2])
                else:
                    audit.append((*day, seq, "superseded", *rows.pop(day)[:2], sha, e[2]))
            continue
        _, seq, repo, sha, issue, day_, dev, ts, at = c
        order = int((at - datetime(1970, 1, 1)).total_seconds()) if at else P.UNKNOWN
        if not sha or ":" in sha:
            statuses[seq] = "refused"
        elif sha in merged:
            statuses[seq] = "pr_captured"
        elif (repo, sha) in entries:
            statuses[seq] = "duplicate"
            e = entries[repo, sha]
            if order < e[4]:
                e[4] = order
                settled((repo, e[0], e[1]), seq, sha, e[2])
        else:
            statuses[seq] = "recorded"
            day = (repo, issue, day_)
            if day in rows and not of(day):
                entries[repo, P.MARKER + str(rows[day][2])] = [issue, day_, rows[day][0], rows[day][1], P.FIRST, 0]
            rows.setdefault(day, [dev, ts, None])
            entries[repo, sha] = [issue, day_, dev, ts, order, seq]
            settled(day, seq, sha, dev)
    book = sorted((r, e[0], e[1], s, e[2], e[3], e[4]) for (r, s), e in entries.items())
    days = sorted((*day, v[0], v[1], len(of(day))) for day, v in rows.items())
    return statuses, book, days, sorted(audit)


def check(spark, commands, ledger=(), unlisted=()):
    pushes = [c[1:] for c in commands if c[0] == "push"]
    merges = [c[1:] for c in commands if c[0] == "merge"]
    d = spark.createDataFrame(pushes, P.DELIVERY).withColumn("extra", F.lit(1))
    done = P.pushed(d, spark.createDataFrame(merges, "seq long, sha string"), spark.createDataFrame(list(ledger), P.ENTRY), spark.createDataFrame(list(unlisted), P.ROW))
    statuses, book, days, audit = one_by_one(commands, ledger, unlisted)
    assert dict(map(tuple, done.statuses.collect())) == statuses
    assert sorted(map(tuple, done.ledger.select("repo", "issue_id", "day", "commit_sha", "developer", "ts", "push_order").collect())) == book
    assert sorted(map(tuple, done.days.select("repo", "issue_id", "day", "developer", "ts", "commits").collect())) == days
    assert sorted(map(tuple, done.audit.select("repo", "issue_id", "day", "seq", "action", "developer", "ts", "commit_sha", "commit_developer").collect())) == audit
    return statuses, days, audit


@pytest.mark.parametrize("seed", range(4))
def test_random_commands(spark, seed):
    r = random.Random(seed)
    when = lambda: BASE + timedelta(seconds=r.randrange(500))
    shas = [f"c{i}" for i in range(25)] + ["", "a:b"]
    commands = []
    for seq in range(1, 121):
        if r.random() < 0.2:
            commands.append(("merge", seq, r.choice(shas[:25])))
        else:
            commands.append(("push", seq, r.choice("xy"), r.choice(shas), r.choice(["1", "2"]), r.choice(["d1", "d2"]), r.choice(["ada", "ben", "cy"]), when(), when() if r.random() < 0.7 else None))
    ledger = [(i, "x", f"c{20 + i}", "1", "d1", r.choice(["ada", "ben"]), when(), r.choice([0, P.UNKNOWN, 1714521700])) for i in range(1, 4)]
    unlisted = [(90, "y", "2", "d2", "old", when()), (91, "z", "9", "d9", "old", when())]
    _, _, audit = check(spark, commands, ledger, unlisted)
    assert {a[4] for a in audit} >= {"rederived_from", "rederived_to"}


def test_last_commit_takes_its_row_along(spark):
    push = ("push", 1, "x", "c1", "1", "d", "ada", BASE, BASE)
    _, days, audit = check(spark, [push, ("merge", 2, "c1"), (*push[:1], 3, *push[2:])])
    assert days == [] and [a[4] for a in audit] == ["superseded"]


def test_a_hot_day_and_empty_tables(spark):
    commands = [("push", i, "x", f"c{i}", "1", "d", f"dev{i}", BASE, BASE + timedelta(seconds=1000 - i)) for i in range(1, 301)]
    commands += [("merge", 301 + i, f"c{300 - i}") for i in range(150)]
    _, days, _ = check(spark, commands)
    assert days[0][3] == "dev150" and days[0][5] == 150
    assert check(spark, []) == ({}, [], [])


def test_nulls_and_repeated_rows(spark):
    rows = [(1, "x", "c1", "1", "d", None, None, None), (1, "x", "c1", "1", "d", None, None, None), (2, None, "c2", "1", "d", "a", BASE, BASE), (3, "x", None, "1", "d", "a", BASE, BASE), (None, "x", "c3", "1", "d", "a", BASE, BASE), (4, "x", "c4", None, "d", "a", BASE, BASE)]
    done = P.pushed(spark.createDataFrame(rows, P.DELIVERY), spark.createDataFrame([(None, "c1"), (5, None)], "seq long, sha string"))
    assert dict(map(tuple, done.statuses.collect())) == {1: "recorded", 2: "refused", 3: "refused", 4: "refused"}
    assert [tuple(r) for r in done.days.collect()] == [("x", "1", "d", None, None, 1)] and done.audit.isEmpty()


@pytest.mark.parametrize("width", [0, 2, 5])
def test_days_are_cut_into_spans(spark, monkeypatch, width):
    """A day's owner is the same whatever part of its lives begins, ends or goes on in a span of commands."""
    monkeypatch.setattr(P, "SPAN", width)
    r = random.Random(width)
    commands = [("push", i, "x", f"c{r.randrange(30)}", "1", "d", r.choice(["ada", "ben", None]), None, BASE + timedelta(seconds=r.randrange(99)) if r.random() < 0.7 else None) if r.random() < 0.7 else ("merge", i, f"c{r.randrange(30)}") for i in range(1, 91)]
    commands = [c[:6] + (f"dev{c[1]}", datetime(9000 if c[1] % 2 else 1000, 1, 1), c[8]) if c[0] == "push" else c for c in commands]
    _, _, audit = check(spark, commands, unlisted=[(90, "x", "1", "d", "old", BASE)] if width == 2 else ())
    assert audit or width == 2


def test_growing_sides_are_not_broadcast(spark):
    """Files say little of the rows that are made of them: at 0.9 M orders a broadcast by their size was past a driver of 1 GB."""
    rows = [(i, "x", f"c{i % 7}", "1", "d", "ada", BASE, BASE) for i in range(1, 40)]
    done = P.pushed(spark.createDataFrame(rows, P.DELIVERY), spark.createDataFrame([(40, "c1")], "seq long, sha string"), unlisted=spark.createDataFrame([(9, "x", "1", "d", "old", BASE)], P.ROW))
    for df in (done.statuses, done.days, done.audit):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


def test_blocks_make_up_the_span(spark):
    spans = [(a, b) for a in range(0, 16) for b in range(a + 1, 17)]
    found = spark.createDataFrame(spans, "a long, b long").select("a", "b", P.blocks(F.col("a"), F.col("b"), 4).alias("x")).collect()
    for r in found:
        inside = [t for x in r.x for t in range(x.block << x.level, (x.block + 1) << x.level)]
        assert sorted(inside) == list(range(r.a, r.b)) and len(r.x) <= 8

"""A person taken out of all tables, once and again; and folders against roots by plain loops."""

from __future__ import annotations

import datetime as dt
import posixpath
import random

from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import privacy, scopes

SECRET = bytes(range(32))


def tables(spark):
    events = spark.createDataFrame([(1, "ada", 5, "2024-01"), (2, "ben", 6, "2024-01"), (3, "ada-gh", 7, "2024-02"), (4, "eve", 8, "2024-03"), (5, None, 9, "2024-03")], "id long, developer string, cost long, period string")
    relations = spark.createDataFrame([(1, "ada", "acme/x", "ben", "acme/y", "text"), (2, "ben", "acme/x", "eve", "acme/y", "text"), (3, None, None, "AL", "acme/y", None)], "id long, child string, child_repo string, parent string, parent_repo string, note string")
    audit = spark.createDataFrame([(1, "eve", "operator"), (2, "al", "operator")], "id long, actor string, role string")
    return {
        "events": privacy.Stored(events, "developer"),
        "relations": privacy.Stored(relations, None, (("child", ("child", "child_repo", "note")), ("parent", ("parent", "parent_repo", "note")))),
        "audit": privacy.Stored(audit, None, (("actor", ("actor",)),)),
    }


def test_a_person_with_all_their_ids(spark):
    aliases = spark.createDataFrame([("ada-gh", "ada"), ("al", "ada-gh"), ("benny", "ben")], "alias string, canonical string")
    ids = privacy.identities(aliases, "ada-gh")
    assert ids == ["ada", "ada-gh", "al"] == privacy.identities(aliases, "al") and privacy.identities(aliases, "eve") == ["eve"]
    t = tables(spark)
    assert {k: sorted(r.id for r in v.collect()) for k, v in privacy.given_out(t, ids).items()} == {"events": [1, 3], "relations": [1], "audit": [2]}
    new, counts = privacy.taken_away(t, ids)
    assert counts == {"events": 2, "relations": 1, "audit": 1}
    assert sorted(r.id for r in new["events"].collect()) == [2, 4, 5]
    assert {tuple(r) for r in new["relations"].collect()} == {(1, None, None, "ben", "acme/y", None), (2, "ben", "acme/x", "eve", "acme/y", "text"), (3, None, None, "AL", "acme/y", None)}
    assert {tuple(r) for r in new["audit"].collect()} == {(1, "eve", "operator"), (2, None, "operator")}
    again = {k: privacy.Stored(new[k], v.owner, v.blanks) for k, v in t.items()}
    assert set(privacy.taken_away(again, ids)[1].values()) == {0}


def test_sealed_keys_become_tombstones(spark):
    july, august = dt.datetime(2026, 7, 1), dt.datetime(2026, 8, 1)
    base = spark.createDataFrame([("month", july, "a", "ada", 5), ("month", july, "a", "ben", 6), ("month", august, "b", "ada-gh", 7), ("quarter", july, "a", "ada", 5)], "period_size string, starts timestamp_ntz, label string, who string, cost long")
    key = F.when(F.col("period_size") == "month", S.person_key(SECRET, "month", F.col("starts"), F.col("who"))).otherwise(S.person_key(SECRET, "quarter", F.col("starts"), F.col("who")))
    persons = base.withColumn("person_key", key).withColumn("tombstoned", F.lit(False))
    new, n = privacy.tombstones(persons.drop("who"), ["ada", "ada-gh"], SECRET)
    assert n == 3
    sums = lambda df: sorted(map(tuple, df.groupBy("period_size", "starts", "label").agg(F.sum("cost"), F.countDistinct("person_key")).collect()))
    assert sums(new) == sums(persons)
    assert new.join(persons.where("who like 'ada%'").select("person_key"), "person_key").count() == 0
    assert new.where("not tombstoned").count() == 1 and [tuple(r) for r in new.orderBy("person_key").collect()] == [tuple(r) for r in new.orderBy("person_key").collect()]
    assert privacy.tombstones(new, ["ada", "ada-gh"], SECRET)[1] == 0


def test_only_touched_partitions_are_written_again(spark, tmp_path):
    path = (tmp_path / "events").as_uri()
    tables(spark)["events"].rows.repartition(1).write.partitionBy("period").parquet(path)
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "events").rglob("*.parquet")}
    before = files()
    assert privacy.erase_partitions(spark, path, "period", "developer", ["ada", "ada-gh"]) == ["2024-01", "2024-02"]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 4, 5]
    after = files()
    assert after["period=2024-03"] == before["period=2024-03"] and after["period=2024-01"] != before["period=2024-01"] and "period=2024-02" not in after
    assert privacy.erase_partitions(spark, path, "period", "developer", ["ada", "ada-gh"]) == []


def within(path, holder):
    return path == holder or path.startswith(holder.rstrip("/") + "/")


def by_loop(cwds, targets, roots):
    def root(path):
        got = [(len(r), m) for r, m in roots if within(path, r)]
        return max(got)[1] if got else None

    out = {}
    for cwd in cwds:
        out[cwd] = ("foreign", None)
        if not cwd or not cwd.startswith("/"):
            continue
        path = posixpath.normpath(cwd).replace("//", "/")
        own, best = root(path), []
        for target, place in targets:
            t_root = root(target)
            if within(path, target):
                if not (t_root and own and own != t_root and within(own, t_root)):
                    best.append((0, place, target))
            elif own and within(own, target):
                best.append((1, place, target))
        if best:
            rank, _, target = min(best)
            out[cwd] = (("direct", "worktree")[rank], target)
    return out


def test_folders_against_loops(spark):
    g = random.Random(6)
    parts = ["w", "a", "b", "ab", "x"]
    path = lambda n: "/" + "/".join(g.choice(parts) for _ in range(n))
    roots = {path(g.randrange(1, 4)): None for _ in range(25)}
    roots = [(r, r if g.random() < 0.7 else g.choice(list(roots))) for r in roots]
    targets = [(t, i) for i, t in enumerate({path(g.randrange(1, 4)) for _ in range(12)})]
    cwds = {path(g.randrange(0, 6)) for _ in range(400)} | {"/", "", "relative/a", "/w/./a//b/", "/w/a/../b/x", "/../w"}
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    got = scopes.scoped(frame([(c,) for c in cwds] * 2, "cwd string"), frame(targets, "target string, place int"), frame(roots, "root string, main string")).collect()
    assert {r.cwd: (r.scope, r.target) for r in got} == by_loop(cwds, targets, roots)
    assert len(got) == len(cwds)

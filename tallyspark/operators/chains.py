"""Corrective work as dataflow: chains of follow-ups over tables of changes and links, in exact fractions.

Nothing is gathered by story. A follow-up with one link points to its parent; pointers are doubled, so a chain of any length takes
the logarithm of it in joins. Follow-ups with several links are settled level by level above these chains. What a follow-up
adds comes from running sums of effort, what siblings take before it from a window over them, and the shares, which pass
down a tree, are taken in one ordered pass over each tree's rows, where a row needs its parent's alone.

Three kinds of story don't follow from tables alone, as the order in which they are walked decides: those with a cycle, those in
which somebody may choose among several originals of their own, and those in which a parent follows its child in the
order of merges at one instant. These stories, and no others, are settled whole by ``corrective``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction as Q

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.operators import graph
from tallyspark.operators.corrective import CORRECTED, DISPUTED, FLOOR, GONE, KEPT, LADDER, OUT, QUALITIES, STATES, WEIGHTS, WINDOW, settle_components
from tallyspark.sources.shared import forget, written

#: Levels of follow-ups with several links above each other; stories beyond them are settled whole.
MOST_LEVELS = 64
FIRST = "0001-01-01"


def halves(fraction: str) -> Column:
    """Twice a size on the scale, as a whole number; null for any other fraction in text, or for none."""
    return F.when(F.col(fraction).isNotNull(), _among(fraction, [w * 2 for w in WEIGHTS], 2))


def on_scale(fraction: str, scale: tuple) -> Column:
    return _among(fraction, [q * 20 for q in scale], 20).isNotNull()


def _among(fraction: str, wanted: list, by: int) -> Column:
    part = F.split(F.col(fraction), "/")
    up, down = F.get(part, F.lit(0)).try_cast("decimal(18,0)"), F.coalesce(F.get(part, F.lit(1)).try_cast("decimal(18,0)"), F.lit(1))
    found = F.lit(None).cast("long")
    for w in wanted:
        found = F.when(up * by == down * int(w), F.lit(int(w))).otherwise(found)
    return found


def ladder2(effort: Column) -> Column:
    out = F.lit(16)
    for limit, w in reversed(LADDER):
        out = F.when(effort <= limit, F.lit(int(w * 2))).otherwise(out)
    return out


def followed(pointers: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame], bool]:
    """Of pointers (id, at, note, sound) the ends: id, at, note, sound, steps; tables of 1, 2, 4, ... steps; and whether any goes in a circle.

    An end is a node without a pointer. note is that of the pointer nearest the end that has one; sound holds if all are.
    """
    now = written(pointers.select("id", "at", "note", "sound", F.lit(1).cast("long").alias("steps")), name)
    tables, most = [now], now.count()
    for _ in range(most.bit_length() + 1 if most else 0):
        further = now.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("note").alias("note2"), F.col("sound").alias("sound2"), F.col("steps").alias("steps2"))
        joined = now.join(further, "at", "left").select("id", F.coalesce("at2", "at").alias("at"), F.coalesce("note2", "note").alias("note"), (F.col("sound") & F.coalesce("sound2", F.lit(True))).alias("sound"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("at2").isNotNull().alias("more"))
        new = written(joined, name)
        now = new.drop("more")
        if new.where("more").isEmpty():
            return now, tables, False
        tables.append(now)
    return now, tables, most > 0


def settle(changes: DataFrame) -> DataFrame:
    """Rows (id, repo, pr, sha, developer, merged_at, weight, quality, effort, links) to OUT, a row for each change.

    weight, quality and sizes are fractions as text; links are structs (parent, state, own, before, after, original, pure), in the order in
    which they count. An id that two changes have is refused.
    """
    base = changes.select("id", "repo", "pr", "sha", "developer", F.col("merged_at").cast("timestamp").alias("merged_at"), "weight", "quality", F.col("effort").cast("long").alias("effort"), "links")
    # changes in the order of merges, told by a number: what they are ordered by is wide, and goes no further
    order = (F.coalesce("merged_at", F.lit(FIRST).cast("timestamp")), F.coalesce("repo", F.lit("")), F.coalesce(F.col("pr").cast("long"), F.lit(0)), F.coalesce("sha", F.lit("")), "id")
    n = written(base.orderBy(*order).drop("repo", "pr", "sha").withColumn("key", F.monotonically_increasing_id()), "changes")
    if not n.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("two changes have the same id")
    n = n.withColumn("w2", halves("weight")).withColumn("fit", F.col("w2").isNotNull() & on_scale("quality", QUALITIES))
    facts = n.select(F.col("id").alias("parent"), F.col("merged_at").alias("p_merged"), F.lit(True).alias("known"))
    raw = n.select(F.col("id").alias("child"), "merged_at", F.posexplode("links").alias("pos", "x")).select("child", "merged_at", "pos", "x.*").where(~F.col("state").isin(*GONE))
    early = F.lit(FIRST).cast("timestamp")
    links = raw.join(facts, "parent", "left").withColumn("walks", F.col("known").isNotNull() & ~F.col("state").isin("pending", "excluded"))
    wrong = (
        F.when(~F.col("walks"), F.lit("missing-or-excluded-parent"))
        .when(F.coalesce("p_merged", early) > F.coalesce("merged_at", early), F.lit("parent-after-child"))
        .when(F.col("p_merged").isNull() | F.col("merged_at").isNull(), F.lit("missing-occurrence"))
        .when(~F.col("state").isin(*STATES), F.lit("unsupported-relation-state"))
    )
    links = written(links.select("child", "pos", "parent", "state", "own", "before", "after", "original", F.coalesce("pure", F.lit(False)).alias("pure"), "walks", wrong.alias("wrong")), "links")

    # where each change goes back to, and what is wrong on the way
    per = links.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("links"), F.bool_or(F.col("state").isin(*DISPUTED)).alias("disputed"), F.bool_and(F.col("state").isin(*KEPT)).alias("kept"), F.min_by("wrong", "pos").alias("only_wrong"), F.bool_and("walks").alias("walks"), F.min_by("parent", "pos").alias("only_parent"))
    per = written(n.select("id").join(per, "id", "left").withColumn("links", F.coalesce("links", F.lit(0))), "linked")
    single = per.where("links = 1 and walks").select("id", F.col("only_parent").alias("at"), F.col("only_wrong").alias("note"), F.lit(True).alias("sound"))
    ends, jumps, circle = followed(single, "chains")
    known = written(per.where("links = 0 or (links = 1 and not walks)").select("id", F.when(F.col("links") == 1, F.lit("missing-or-excluded-parent")).alias("problem")), "known")
    origins = written(per.where("links = 0").select("id", F.col("id").alias("origin")), "origins")
    many = links.join(per.where("links > 1").select(F.col("id").alias("child")), "child", "left_semi")
    top = F.coalesce("at", "parent")
    many = written(many.join(ends.select(F.col("id").alias("parent"), "at", "note", "steps"), "parent", "left").select("child", "pos", "parent", "walks", "wrong", top.alias("top"), "note", F.coalesce("steps", F.lit(0)).alias("steps")), "junctions")
    open_ = many.select(F.col("child").alias("id")).distinct()
    several = not many.isEmpty()
    for _ in range(MOST_LEVELS if several else 0):
        waits = many.where("walks").join(known.select(F.col("id").alias("top")), "top", "left_anti").select(F.col("child").alias("id"))
        ready = written(open_.join(known.select("id"), "id", "left_anti").join(waits, "id", "left_anti"), "ready")
        if ready.isEmpty():
            break
        mine = many.join(ready.select(F.col("id").alias("child")), "child", "left_semi").join(known.select(F.col("id").alias("top"), "problem"), "top", "left")
        said = F.coalesce(F.when(F.col("walks"), F.coalesce("problem", "note")), "wrong")
        level = mine.withColumn("said", said).groupBy(F.col("child").alias("id")).agg(F.max_by("said", F.when(F.col("said").isNotNull(), F.col("pos"))).alias("problem"))
        from_ = mine.where("walks").select("child", "top").join(origins.select(F.col("id").alias("top"), "origin"), "top").select(F.col("child").alias("id"), "origin").distinct()
        known, origins = written(known.unionByName(level), "known"), written(origins.unionByName(from_), "origins")
    stuck = open_.join(known.select("id"), "id", "left_anti")

    tops = per.join(ends.select("id", "at", "note"), "id", "left").withColumn("top", F.coalesce("at", "id"))
    counts = origins.groupBy(F.col("id").alias("top")).agg(F.count("*").alias("origins"))
    tops = tops.join(known.select(F.col("id").alias("top"), "problem", F.lit(True).alias("reached")), "top", "left").join(counts, "top", "left")
    rows = n.drop("links").join(tops.select("id", "top", "links", "disputed", "kept", "only_parent", F.coalesce("problem", "note").alias("problem"), "reached", F.coalesce("origins", F.lit(0)).alias("origins")), "id")
    shape = F.when(F.col("problem").isNull() & (F.col("links") > 0) & ~F.col("fit"), F.lit("unsupported-allocation-shape"))
    rows = written(rows.withColumn("problem", F.coalesce("problem", shape)).withColumn("several", F.col("problem").isNull() & (F.col("origins") > 1)), "walked")

    # the parent that a follow-up charges
    choice = rows.where("several").select("id", "top", "developer").join(origins.select(F.col("id").alias("top"), "origin"), "top").join(n.select(F.col("id").alias("origin"), F.col("developer").alias("of")), "origin").where(F.col("of").eqNullSafe(F.col("developer")))
    choice = written(choice.groupBy("id").agg(F.count("*").alias("choices"), F.min("origin").alias("origin")), "choices")
    named = rows.where("problem is null and not several and links > 1").select(F.col("id").alias("child"))
    deepest = _deepest(many.join(named, "child", "left_semi"), many, ends, jumps) if several else named.select(F.col("child").alias("id"), F.col("child").alias("deepest")).limit(0)
    charged = rows.join(choice, "id", "left").join(deepest, "id", "left")
    parent = F.when(F.col("several"), F.when(F.col("choices") == 1, F.col("origin"))).when(F.col("problem").isNull() & (F.col("links") == 1), F.col("only_parent")).when(F.col("problem").isNull(), F.col("deepest"))
    charged = charged.withColumn("parent", parent)
    none_ = F.when(F.col("problem").isNull() & (F.col("links") > 1) & ~F.col("several") & F.col("parent").isNull(), F.lit("unsupported-allocation-shape"))
    charged = charged.withColumn("problem", F.when(F.col("several"), F.lit("multiple-originals")).otherwise(F.coalesce("problem", none_)))
    review = links.select(F.col("child").alias("id"), "parent", "pos", F.struct(halves("own").alias("own2"), halves("before").alias("before2"), halves("after").alias("after2"), "original", "pure", F.col("own").isNotNull().alias("given")).alias("review")).groupBy("id", "parent").agg(F.min_by("review", "pos").alias("review"))
    charged = charged.join(review.withColumnRenamed("parent", "r_parent").withColumnRenamed("id", "r_id"), (F.col("id") == F.col("r_id")) & (F.col("parent") == F.col("r_parent")), "left").drop("r_id", "r_parent")
    given = F.coalesce(F.col("review.given"), F.lit(False))
    weak = (F.col("links") > 0) & (F.col("several") | (F.col("parent").isNotNull() & (~F.col("kept") | ~given)))
    charged = charged.withColumn("given", given).withColumn("weak", weak)
    above = n.select(F.col("id").alias("parent"), F.col("key").alias("p_key"), F.col("developer").alias("p_developer"), F.col("fit").alias("p_fit"), F.col("merged_at").alias("p_merged"))
    charged = written(charged.join(above, "parent", "left"), "charged")

    whole = charged.where((F.col("choices") > 1) | (F.col("p_key") > F.col("key"))).select("id").unionByName(stuck.select("id")).unionByName(charged.where("reached is null").select("id") if circle else stuck.select("id").limit(0))
    whole = written(whole.distinct(), "whole")
    later = None
    if not whole.isEmpty():
        both = links.join(n.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("a"), F.col("parent").alias("b"))
        part = graph.components(both)
        component = F.coalesce("root", "id")
        touched = whole.join(part, "id", "left").select(component.alias("component")).distinct()
        placed = written(n.select("id").join(part, "id", "left").select("id", component.alias("component")).join(touched, "component", "left_semi"), "stories")
        later = settle_components(base.join(placed, "id"))
        charged = written(charged.join(placed.select("id"), "id", "left_anti"), "settling")
    here = _allocated(charged)
    forget(*jumps[:-1])
    return here.unionByName(later) if later is not None else here


def _deepest(asked: DataFrame, many: DataFrame, ends: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """id, deepest: of the parents of follow-ups with several links the first that goes back to all the others, if any does."""
    one = asked.select("child", F.col("parent").alias("p"), "pos", F.col("top").alias("p_top"), F.col("steps").alias("p_steps"))
    other = asked.select("child", F.col("parent").alias("o"), F.col("top").alias("o_top"), F.col("steps").alias("o_steps")).distinct()
    pairs = written(one.drop("pos").distinct().join(other, "child").where("p != o"), "pairs")
    found = pairs.select("child", "p", "o").limit(0)
    at = pairs.select("child", "p", "o", "o_top", "o_steps", F.col("p").alias("now"), F.col("p_top").alias("now_top"), F.col("p_steps").alias("now_steps"))
    for _ in range(MOST_LEVELS):
        at = written(at, "climbing")
        if at.isEmpty():
            break
        # in one chain's tree: as many steps up as there are between the two
        near = at.where("now_top = o_top and now_steps >= o_steps").select("child", "p", "o", F.col("now").alias("id"), (F.col("now_steps") - F.col("o_steps")).alias("left"))
        for k in reversed(range(len(jumps))):
            up = jumps[k].where(F.col("steps") == 1 << k).select("id", "at")
            near = near.join(up, "id", "left").select("child", "p", "o", F.when(F.col("left") >= 1 << k, F.col("at")).otherwise(F.col("id")).alias("id"), F.when(F.col("left") >= 1 << k, F.col("left") - (1 << k)).otherwise(F.col("left")).alias("left"))
        found = written(found.unionByName(near.where("id = o").select("child", "p", "o")), "reached")
        rest = at.join(found, ["child", "p", "o"], "left_anti")
        # above the chain: on by each link of the follow-up with several that it ends in
        beyond = many.select(F.col("child").alias("now_top"), F.col("parent").alias("to"), F.col("top").alias("to_top"), F.col("steps").alias("to_steps"))
        at = rest.join(beyond, "now_top").select("child", "p", "o", "o_top", "o_steps", F.col("to").alias("now"), F.col("to_top").alias("now_top"), F.col("to_steps").alias("now_steps")).distinct()
    others = asked.groupBy("child").agg((F.countDistinct("parent") - 1).alias("others"))
    reach = asked.select("child", F.col("parent").alias("p"), "pos").join(found.groupBy("child", "p").agg(F.countDistinct("o").alias("n")), ["child", "p"], "left").join(others, "child")
    return reach.where(F.coalesce("n", F.lit(0)) == F.col("others")).groupBy(F.col("child").alias("id")).agg(F.min_by("p", "pos").alias("deepest"))


def _allocated(rows: DataFrame) -> DataFrame:
    """Growth, corrected quality and shares of changes whose charged parents are known."""
    tree, _, _ = followed(rows.where("parent is not null").select("id", F.col("parent").alias("at"), F.lit(None).cast("string").alias("note"), F.lit(True).alias("sound")), "trees")
    rows = rows.join(tree.select("id", F.col("at").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # efforts of one original's earlier changes: of earlier days, then of the day
    day = F.to_date(F.coalesce("merged_at", F.lit(FIRST).cast("timestamp")))
    rows = rows.withColumn("day", day)
    days = rows.groupBy("root", "day").agg(F.sum("effort").alias("effort"), F.count(F.when(F.col("effort").isNull(), 1)).alias("unknown"))
    before = Window.partitionBy("root").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("root", "day").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    days = days.select("root", "day", zero(F.sum("effort").over(before)).alias("e0"), zero(F.sum("unknown").over(before)).alias("u0"))
    rows = rows.withColumn("e1", zero(F.sum("effort").over(inside))).withColumn("u1", zero(F.sum(F.col("effort").isNull().cast("long")).over(inside))).join(days, ["root", "day"])
    effort, sized = F.col("e0") + F.col("e1"), (F.col("u0") + F.col("u1") == 0) & F.col("effort").isNotNull()
    fit = F.col("parent").isNotNull() & F.col("p_fit") & F.col("p_merged").isNotNull() & (F.col("given") | sized)
    rows = rows.select("*", ladder2(effort).alias("s_before"), ladder2(effort + zero(F.col("effort"))).alias("s_after"), fit.alias("own_fit"))
    bad = rows.select(F.col("id").alias("parent"), F.col("problem").alias("p_problem"))
    rows = written(rows.join(bad, "parent", "left").withColumn("own_fit", F.col("own_fit") & F.col("p_problem").isNull()), "sized")
    # a follow-up counts as sized only if all that it builds on is
    way, _, _ = followed(rows.where("parent is not null").select("id", F.col("parent").alias("at"), F.lit(None).cast("string").alias("note"), F.col("own_fit").alias("sound")), "sound")
    rows = rows.join(way.select("id", "sound"), "id", "left").withColumn("grown", F.coalesce("sound", F.lit(False)))
    pick = lambda a, b: F.when(F.col("grown"), F.when(F.col("given"), F.col(f"review.{a}")).otherwise(b))
    rows = rows.withColumn("own2", pick("own2", F.col("w2"))).withColumn("before2", F.coalesce(pick("before2", F.col("s_before")), F.lit(0))).withColumn("after2", F.coalesce(pick("after2", F.col("s_after")), F.lit(0)))
    credit = F.when(F.col("grown"), F.when(F.col("given") & F.col("review.pure"), F.lit(0)).otherwise(F.least(F.col("own2"), F.greatest(F.lit(0), F.col("after2") - F.col("before2"))))).otherwise(0)
    counts = F.col("grown") & (~F.col("weak") | F.col("developer").eqNullSafe(F.col("p_developer")))
    problem = F.when(F.col("parent").isNotNull() & ~F.col("grown"), F.lit("missing-sizing-or-parent-evidence")).otherwise(F.col("problem"))
    rows = rows.withColumn("credit2", credit).withColumn("counts", counts).withColumn("reason", F.coalesce(problem, F.lit("")))
    last = F.col("reason") == "multiple-originals"
    siblings = Window.partitionBy("parent").orderBy(last, "key").rowsBetween(Window.unboundedPreceding, -1)
    kids = rows.where("counts").select("id", "parent", "key", "merged_at", "weak", "own2", "credit2", "given", F.col("review.original").alias("original"), zero(F.sum("own2").over(siblings)).alias("ahead2"))
    kids = written(kids, "counted")
    merged = rows.select(F.col("id").alias("parent"), F.col("merged_at").alias("p_at"))
    near = (F.col("merged_at") >= F.col("p_at")) & (F.col("merged_at") <= F.col("p_at") + F.expr(f"INTERVAL {WINDOW.days} DAYS"))
    first_original = F.min_by("original", F.when(F.col("given") & F.col("original").isNotNull(), F.col("key")))
    of = kids.join(merged, "parent").groupBy(F.col("parent").alias("id")).agg(F.bool_or("weak").alias("kid_weak"), F.bool_or(near).alias("corrected"), F.sum("own2").alias("owned2"), F.sum("credit2").alias("credits2"), first_original.alias("original"))
    unit, _, _ = followed(kids.select("id", F.col("parent").alias("at"), F.lit(None).cast("string").alias("note"), F.lit(True).alias("sound")), "units")
    rows = rows.join(of, "id", "left").join(unit.select("id", F.col("at").alias("unit"), "steps"), "id", "left").join(kids.select("id", "ahead2"), "id", "left")
    status = F.when(F.col("reason") != "", F.lit("pending")).when(F.col("grown") & F.col("weak"), F.lit("provisional")).otherwise(F.lit("resolved"))
    eligible = F.when(F.coalesce("links", F.lit(0)) == 0, F.lit("eligible")).when(F.col("grown") & (F.col("reason") != "multiple-originals"), F.when(F.col("credit2") > 0, F.lit("eligible")).otherwise(F.lit("ineligible"))).otherwise(F.lit("unknown"))
    rows = rows.select(
        F.coalesce("unit", "id").alias("unit"), F.coalesce("steps", F.lit(0)).alias("depth"), "id", F.coalesce("parent", F.lit(0)).alias("parent"), status.alias("status"), "reason", eligible.alias("eligible"),
        (F.col("weak") | F.coalesce("kid_weak", F.lit(False))).alias("provisional"), F.coalesce("disputed", F.lit(False)).alias("disputed"), "weight", "quality", F.coalesce("corrected", F.lit(False)).alias("corrected"),
        F.when(F.col("parent").isNull(), F.col("original")).alias("original"), "counts", "own2", "before2", "after2", "credit2", F.coalesce("ahead2", F.lit(0)).alias("ahead2"), F.coalesce("owned2", F.lit(0)).alias("owned2"), F.coalesce("credits2", F.lit(0)).alias("credits2"),
    )
    return rows.repartition("unit").sortWithinPartitions("unit", "depth").mapInPandas(_shares, OUT)


def _shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shares from the top of each tree down: a change keeps its share's worth and its follow-ups' credit, less what they own, but a
    tenth of its share at least; its follow-ups divide the rest in order. Of a tree only what is left for follow-ups is held."""
    names, unit, left = [x.split()[0] for x in OUT.split(", ")], None, {}
    half = lambda n: Q(int(n), 2)
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            if r.unit != unit:
                unit, left = r.unit, {}
            quality, own = Q(r.quality), Q(r.weight) if pd.isna(r.own2) else half(r.own2)
            if r.corrected:
                quality = CORRECTED.get(quality, quality)
            share = min(own, max(Q(0), left[r.parent] - half(r.ahead2))) if r.counts else Q(r.original or r.weight)
            owned, credits = (half(r.owned2), half(r.credits2)) if share > 0 else (Q(0), Q(0))
            worth = share * quality
            points = max(FLOOR * share, worth + credits - owned) if owned else worth
            left[r.id] = max(Q(0), worth + credits - points)
            exact = {"own": own, "before": half(r.before2), "after": half(r.after2), "credit": half(r.credit2), "share": share, "quality": quality, "points": points}
            out.append([str(exact[k]) if k in exact else getattr(r, k) for k in names])
        yield pd.DataFrame(out, columns=names)

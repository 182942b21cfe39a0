"""Interval estimates of points per 1000 dollars: their inputs, draws in parts of bounded size, and comparison."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.scores import developer_cost, joined_cost

ISSUE = ["developer", "issue_id", "repo"]
ROUNDS, PART = 1000, 65_536


def issue_shares(outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """By developer, issue and repository: k outcomes, ok of them eligible (all, without a column eligible), points20,
    and the micro-dollars of each; with the developer's fixed_micro and fixed20, which no draw changes, and shown.

    An issue's cost is split evenly over its outcomes. A repository-blind cost may reach several keys; where a
    developer's keys exceed their total cost by it, all are scaled down to it. Fixed are the cost that reaches no outcome,
    and the cost and points of outcomes that aren't eligible. Shown: at least half of the cost is drawn.
    """
    o = outcomes if "eligible" in outcomes.columns else outcomes.withColumn("eligible", F.lit(True))
    points = lambda c: F.coalesce(F.sum(F.when(c, F.col("points20"))), F.lit(0))
    keys = o.groupBy(*ISSUE).agg(F.count("*").alias("k"), F.count(F.when(F.col("eligible"), 1)).alias("ok"), F.sum("points20").alias("points20"), points(~F.col("eligible")).alias("repair20"))
    linked = joined_cost(keys, events)
    drawn = F.col("cost_micro") * F.col("ok") / F.col("k")
    sums = linked.groupBy("developer").agg(F.sum("cost_micro").alias("linked"), F.sum(drawn).alias("drawn"), F.sum("repair20").alias("fixed20"))
    total = developer_cost(events).select("developer", F.col("cost_micro").alias("total"))
    d = sums.join(total, "developer", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    scale = F.when(F.col("linked") > F.col("total"), F.col("total") / F.col("linked")).otherwise(1.0)
    d = d.withColumn("scale", scale).select(
        "developer", "scale", "fixed20",
        (F.greatest(F.col("total") - F.col("linked"), F.lit(0)) + (F.col("linked") - F.col("drawn")) * F.col("scale")).alias("fixed_micro"),
        ((F.col("total") > 0) & (2 * F.col("drawn") >= F.greatest("total", "linked"))).alias("shown"),
    )
    return linked.join(d, "developer").select(*ISSUE, "k", "ok", "points20", (F.col("cost_micro") / F.col("k") * F.col("scale")).alias("each_micro"), "fixed_micro", "fixed20", "shown")


def interval_rows(outcomes: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that are drawn (developer, id, points, cost) and what is fixed by developer (fixed, fixed_points, shown)."""
    shares = issue_shares(outcomes, events)
    drawn = outcomes.where("eligible") if "eligible" in outcomes.columns else outcomes
    rows = drawn.join(shares.select(*ISSUE, "each_micro"), ISSUE).select("developer", "id", (F.col("points20") / 20).alias("points"), (F.col("each_micro") / 1e6).alias("cost"))
    fixed = shares.groupBy("developer").agg((F.first("fixed_micro") / 1e6).alias("fixed"), (F.first("fixed20") / 20).alias("fixed_points"), F.first("shown").alias("shown"))
    return rows, fixed


def _seed(*parts) -> int:
    return zlib.crc32(repr(parts).encode())


def _dealt(parts: pd.DataFrame) -> pd.DataFrame:
    """How many of a developer's draws fall to each part, by round: multinomial by the parts' sizes."""
    parts = parts.sort_values("part")
    n = parts["n"].to_numpy()
    draws = np.random.default_rng(_seed(parts["developer"].iloc[0])).multinomial(n.sum(), n / n.sum(), ROUNDS)
    return pd.DataFrame({"developer": parts["developer"], "part": parts["part"], "draws": list(draws.T)})


def _drawn(rows: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
    """Sums of one part's draws by round; a round at a time, so that memory is that of the part."""
    rows = rows.sort_values(["id", "points", "cost"])
    points, cost, draws = rows["points"].to_numpy(), rows["cost"].to_numpy(), dealt["draws"].iloc[0]
    rng = np.random.default_rng(_seed(rows["developer"].iloc[0], int(rows["part"].iloc[0])))
    sums = np.empty((len(draws), 2))
    for i, k in enumerate(draws):
        at = rng.integers(0, len(points), k)
        sums[i] = points[at].sum(), cost[at].sum()
    return pd.DataFrame({"developer": rows["developer"].iloc[0], "round": range(len(draws)), "points": sums[:, 0], "cost": sums[:, 1]})


def intervals(rows: DataFrame, fixed: DataFrame, part: int = PART) -> DataFrame:
    """By developer, n and the 2.5 and 97.5 % bounds of points per 1000 dollars over outcomes drawn again with their
    costs, and the same for dollars per point. (0, 0) without a positive cost; rounds without one are left out.

    A developer's rows are dealt to parts of about so many by a hash of their id. The draws of a round are dealt to the
    parts by their sizes first, so that drawing in parts is drawing from all; sums of rounds are added by Spark.
    """
    n = rows.groupBy("developer").agg(F.count("*").alias("n"), F.sum("cost").alias("all_cost"))
    parts = F.pmod(F.xxhash64("id", "points"), F.ceil(F.col("n") / part))
    dealt = rows.join(n.select("developer", "n"), "developer").select("developer", "id", "points", "cost", parts.alias("part"))
    sizes = dealt.groupBy("developer", "part").agg(F.count("*").alias("n"))
    draws = sizes.groupBy("developer").applyInPandas(lambda p: _dealt(p), "developer string, part long, draws array<long>")
    by_part = dealt.groupBy("developer", "part").cogroup(draws.groupBy("developer", "part"))
    sums = by_part.applyInPandas(lambda r, d: _drawn(r, d), "developer string, round int, points double, cost double")
    rounds = sums.groupBy("developer", "round").agg(F.sum("points").alias("points"), F.sum("cost").alias("cost")).join(fixed, "developer")
    below = (F.col("cost") + F.col("fixed")) / 1000
    ratio = F.when(below > 0, (F.col("points") + F.col("fixed_points")) / below)
    found = rounds.groupBy("developer").agg(F.array_sort(F.collect_list(ratio)).alias("r"))  # as many as rounds
    m = F.size("r")
    pick = lambda at: F.coalesce(F.get("r", at.cast("int")), F.lit(0.0))
    out = n.join(fixed.select("developer", "fixed"), "developer").join(found, "developer")
    has = F.col("all_cost") + F.col("fixed") > 0
    out = out.select("developer", "n", F.when(has, pick(F.floor(0.025 * m))).otherwise(0.0).alias("lo"), F.when(has, pick(F.greatest(F.ceil(0.975 * m) - 1, F.lit(0)))).otherwise(0.0).alias("hi"))
    ok = (F.col("lo") > 0) & (F.col("hi") > 0)
    return out.withColumns({"cpp_lo": F.when(ok, 1000 / F.col("hi")).otherwise(0.0), "cpp_hi": F.when(ok, 1000 / F.col("lo")).otherwise(0.0)})


def significant(before: DataFrame, after: DataFrame) -> DataFrame:
    """Developers of two windows (developer, ranked, shown, lo, hi) and whether their intervals are apart: only where
    both are ranked and shown."""
    side = lambda df, n: df.select("developer", *(F.col(c).alias(f"{n}_{c}") for c in ("ranked", "shown", "lo", "hi")))
    both = side(before, "a").join(side(after, "b"), "developer")
    apart = (F.col("a_hi") < F.col("b_lo")) | (F.col("b_hi") < F.col("a_lo"))
    stand = F.col("a_ranked") & F.col("a_shown") & F.col("b_ranked") & F.col("b_shown")
    return both.select("developer", F.coalesce(stand & apart, F.lit(False)).alias("disjoint"))

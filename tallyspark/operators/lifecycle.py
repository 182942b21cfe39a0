"""The life of a corrects-relation: commands in order, each taken or refused with a reason; and points by what they settle.

A command says which revision of its relation it was given for. What can be told from a command alone is told in columns;
the rest is one ordered pass over each relation's commands, which holds a state, a revision, and what was taken at which revision,
so that a command sent twice is known again.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.chains import halves
from tallyspark.operators.corrective import KEPT

# States, commands, and the lengths of what a command may say.
INACTIVE = ("removed", "unrelated", "withdrawn")
SETTLEMENTS = ("settle-uphold", "settle-re-assess", "settle-remove")
ACTIONS = ("confirm", "dispute", "withdraw", *SETTLEMENTS)
SHORT, LONG_TEXT = 128, 4096
#: What a command makes of a state: all states that it is taken in.
OPEN_STATES = ("declared", "pending", "excluded")
NEXT = {
    **{("confirm", s): "confirmed" for s in OPEN_STATES},
    **{("dispute", s): "disputed" if s in KEPT else "disputed-declared" for s in (*OPEN_STATES, *KEPT, "disputed-declared")},
    **{("withdraw", s): "withdrawn-confirmed" if s in KEPT else "withdrawn" for s in (*OPEN_STATES, "confirmed", "disputed")},
    **{("settle-uphold", s): "confirmed" for s in ("disputed", "withdrawn-confirmed")},
    ("settle-uphold", "disputed-declared"): "declared",
    **{("settle-re-assess", s): "confirmed" for s in ("disputed", "withdrawn-confirmed", "disputed-declared")},
    **{("settle-remove", s): "removed" for s in ("disputed", "withdrawn-confirmed", "disputed-declared")},
}
WHY = {"confirm": "needs-settlement", "dispute": "inactive", "withdraw": "not-withdrawable", **dict.fromkeys(SETTLEMENTS, "not-disputed")}
OUT = "relation long, seq long, action string, taken boolean, why string, state string, revision long"


def malformed(actor: str = "actor", role: str = "role", reason: str = "reason") -> Column:
    """What is wrong with a command by itself, or null. review: struct (original, own, before, after, pure, revision, reviewer)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    act, r = F.col("action"), F.col("review")
    sized = act.isin("confirm", "settle-re-assess")
    both = halves("review.before").isNotNull() & halves("review.after").isNotNull()
    pure = F.coalesce(r["pure"], F.lit(False))
    neither = r["before"].isNull() & r["after"].isNull()
    fits = halves("review.original").isNotNull() & halves("review.own").isNotNull() & F.when(pure, neither | (both & (halves("review.before") == halves("review.after")))).otherwise(both)
    return (
        F.when(~F.coalesce(act.isin(*ACTIONS), F.lit(False)), F.lit("unknown-action"))
        .when(blank(F.col(actor)) | blank(F.col(role)) | (F.length(actor) > SHORT) | (F.length(role) > SHORT) | (F.length(F.coalesce(F.col(reason), F.lit(""))) > LONG_TEXT), F.lit("actor-and-role-required"))
        .when(~(F.coalesce(F.col("revision"), F.lit(0)) > 0), F.lit("revision-required"))
        .when((act != "confirm") & blank(F.col(reason)), F.lit("reason-required"))
        .when(sized & r.isNull(), F.lit("review-required"))
        .when(sized & ~F.coalesce(fits, F.lit(False)), F.lit("review-off-scale"))
        .when(sized & ~((r["revision"] == F.col("revision")) & (r["reviewer"] == F.col(actor))), F.lit("review-of-another"))
        .when(~sized & r.isNotNull(), F.lit("review-not-accepted"))
    )


def run(relations: DataFrame, commands: DataFrame) -> DataFrame:
    """Every command with whether it was taken, why not, and its relation's state and revision after it.

    relations: relation, state, child_developer (null where erased), captured (whether the child's outcome is known); they begin at
    revision 1. commands: relation, seq, at, action, actor, role, reason, revision, review; order is that of at and seq. Actors and developers
    are compared as they are given, by canonical ids without case. A command for no relation is refused.
    """
    c = commands.withColumn("malformed", malformed())
    same = F.sha2(F.to_json(F.struct("actor", "role", "reason", F.struct(*(halves(f"review.{k}").alias(k) for k in ("original", "own", "before", "after")), "review.pure"))), 256)
    known = relations.select("relation", F.col("state").alias("first"), "child_developer", "captured")
    rows = c.join(known, "relation", "left").select("relation", "seq", "at", "action", "revision", "malformed", same.alias("said"), F.lower("actor").alias("actor"), "role", "first", F.lower("child_developer").alias("child"), F.coalesce("captured", F.lit(False)).alias("captured"))
    return rows.repartition("relation").sortWithinPartitions("relation", "at", "seq").mapInPandas(_fold, OUT)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    relation, state, revision, taken = object(), None, 1, {}
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            if r.relation != relation:
                relation, state, revision, taken = r.relation, r.first, 1, {}
            why = r.malformed or _refused(r, state, revision, taken)
            if not why:
                state, revision = NEXT[r.action, state], revision + 1
                taken[r.revision, r.action] = r.said
            again = why == "replay"
            out.append((r.relation, r.seq, r.action, not why or again, why or "", state, revision if state is not None else 0))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])


def _refused(r, state: str | None, revision: int, taken: dict) -> str:  # noqa: ANN001
    if state is None or pd.isna(state):
        return "no-relation"
    if (before := taken.get((r.revision, r.action))) is not None:
        return "replay" if before == r.said else "conflicting-replay"
    if r.revision != revision or r.child is None:
        return "stale-or-erased"
    if r.action in ("confirm", "settle-re-assess") and not r.captured:
        return "outcome-not-captured"
    if r.action not in ("dispute", "withdraw") and r.role != "operator":
        return "operator-required"
    to = NEXT.get((r.action, state))
    if to is None:
        return WHY[r.action]
    return "own-declaration" if to == "confirmed" and r.actor == r.child else ""


def states(relations: DataFrame, done: DataFrame) -> DataFrame:
    """relation, state, revision after all commands."""
    last = done.groupBy("relation").agg(F.max(F.struct("revision", "state")).alias("x"))
    return relations.select("relation", F.col("state").alias("first")).join(last, "relation", "left").select("relation", F.coalesce("x.state", "first").alias("state"), F.coalesce("x.revision", F.lit(1)).cast("long").alias("revision"))


@F.pandas_udf(T.DoubleType())
def number(fraction: pd.Series) -> pd.Series:
    """A fraction in text as the nearest double."""
    return fraction.map(lambda x: None if x is None else float(Fraction(x)))


def effective(outcomes: DataFrame, projections: DataFrame, enabled: bool) -> DataFrame:
    """Outcomes with points and eligible. With the policy off they are weight x quality; with it on they are what was stored for
    the outcome (id, points, quality, eligible, rule), and an outcome without a sound projection fails the job rather than count as anything.
    """
    if not enabled:
        return outcomes.withColumn("points", F.col("weight") * F.col("quality")).withColumn("eligible", F.lit("eligible")).withColumn("rule", F.lit("legacy-v1"))
    p = projections.select(F.col("id").alias("_id"), "points", F.col("quality").alias("_quality"), "eligible", "rule")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    sound = F.col("rule").isin("event3-v1", "event3-v2") & finite(F.col("points")) & (F.col("points") >= 0) & F.col("_quality").between(0, 1) & F.col("eligible").isin("eligible", "ineligible", "unknown")
    refused = F.raise_error(F.concat(F.lit("no sound projection for outcome "), F.col("id").cast("string"))).cast("double")
    joined = outcomes.join(p, outcomes["id"] == p["_id"], "left")
    return joined.withColumn("points", F.when(F.coalesce(sound, F.lit(False)), F.col("points")).otherwise(refused)).drop("_id", "quality").withColumnRenamed("_quality", "quality")

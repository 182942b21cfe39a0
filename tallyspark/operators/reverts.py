"""What a revert commit says about which outcome, and why it says nothing where it doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import micros, revert_kind
from tallyspark.operators.ranges import within
from tallyspark.sources.shared import written

#: Fixed value: the footer that git writes.
FOOTER = r"(?i:This reverts commit )([0-9a-f]{40})\b"
UNQUALIFIED = "unqualified"
DAY = 86_400_000_000


def decided(reverts: DataFrame, outcomes: DataFrame, prior: DataFrame, days: int = 60) -> DataFrame:
    """Sha, outcome_id, event_type, reason and candidates of each revert.

    reverts: sha, repo, issue_id, ts, message, merge_push (its push merged a pull request). outcomes: id, repo, issue_id, ts, merge_sha. prior:
    outcome_id, event_type, source_ref, the quality events so far. A footer's commit decides alone: the outcome that it
    merged is meant, 'late' if the revert is more than so many days after it, and 'footer_unresolved' where no outcome has it, as
    a precise commit permits no guess. Without a footer, and not in a 'merge_push', outcomes of the same repository and issue of the last so many
    days are candidates, both ends in: one is 'resolved', unless an earlier look found this revert ambiguous for it, since
    an erasure of the others can't turn that into a penalty; several are 'ambiguous'; with none it is 'legacy_only' if outcomes without a
    repository would fit, else 'no_candidate'.

    Rows of one sha count once, the least of them; without a sha they are left out. A null repository, issue or time finds no candidate,
    and without a time a footer's outcome isn't late. Candidates are counted in bins of time, never paired.
    """
    names = ["repo", "issue_id", "ts", "message", "merge_push"]
    r = reverts.where("sha is not null").groupBy("sha").agg(F.min(F.struct(*names)).alias("r")).select("sha", "r.*")
    footer = F.regexp_extract(F.coalesce("message", F.lit("")), FOOTER, 1)
    r = r.withColumn("merge_push", F.coalesce("merge_push", F.lit(False))).withColumn("named", F.when(footer != "", footer))
    guesses = (F.col("named").isNull()) & ~F.col("merge_push")
    r = written(r.withColumn("guesses", guesses), "reverts")
    o = outcomes.select("id", F.coalesce("repo", F.lit(UNQUALIFIED)).alias("repo"), "issue_id", "ts", "merge_sha")
    by_sha = o.where("merge_sha is not null").groupBy(F.col("merge_sha").alias("named")).agg(F.min(F.struct("id", "ts")).alias("origin"))
    exact = r.where("named is not null").join(by_sha, "named", "left")
    late = F.coalesce(F.col("ts") > F.col("origin.ts") + F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    told = F.when(F.col("origin").isNull(), F.lit("footer_unresolved")).when(late, F.lit("late")).otherwise(F.lit("resolved"))
    found = F.col("origin").isNotNull().cast("long")
    exact = exact.select("sha", "message", "ts", F.col("origin.id").alias("one"), told.alias("reason"), found.alias("candidates"))

    one = F.lit(1).cast("long")
    asks = r.where("guesses").select("sha", "message", "repo", "issue_id", "ts")
    near = within(asks.where(F.col("repo") != UNQUALIFIED), o.select("repo", "issue_id", "ts", one.alias("candidates"), F.col("id").alias("one")), ["repo", "issue_id"], "ts", days * DAY, {"candidates": "sum", "one": "min"})
    near = written(near.select("sha", F.coalesce("candidates", F.lit(0)).alias("candidates"), "one"), "near")
    lost = asks.join(near.where("candidates > 0").select("sha"), "sha", "left_anti").select("sha", "issue_id", "ts")
    legacy = within(lost, o.where(F.col("repo") == UNQUALIFIED).select("issue_id", "ts", one.alias("legacy")), ["issue_id"], "ts", days * DAY, {"legacy": "sum"}).select("sha", "legacy")
    before = prior.where("event_type = 'revert_ambiguous'").select(F.col("outcome_id").alias("one"), F.col("source_ref").alias("sha"), F.lit(True).alias("doubted")).distinct()
    g = asks.join(near, "sha", "left").join(legacy, "sha", "left").join(before, ["sha", "one"], "left")
    n = F.coalesce("candidates", F.lit(0))
    said = F.when((n > 1) | F.coalesce("doubted", F.lit(False)), F.lit("ambiguous")).when(n == 1, F.lit("resolved")).when(F.coalesce("legacy", F.lit(0)) > 0, F.lit("legacy_only")).otherwise(F.lit("no_candidate"))
    guessed = g.select("sha", "message", "ts", "one", said.alias("reason"), n.cast("long").alias("candidates"))
    merged = r.where("named is null and merge_push").select("sha", "message", "ts", F.lit(None).cast(o.schema["id"].dataType).alias("one"), F.lit("merge_push").alias("reason"), F.lit(0).cast("long").alias("candidates"))
    resolved = F.col("reason") == "resolved"
    all_ = exact.unionByName(guessed).unionByName(merged)
    return all_.select("sha", F.when(resolved, F.col("one")).alias("outcome_id"), F.when(resolved, revert_kind(F.coalesce("message", F.lit("")))).alias("event_type"), "reason", "candidates")


def doubted(decisions: DataFrame, reverts: DataFrame, outcomes: DataFrame, days: int = 60) -> DataFrame:
    """Outcomes that ambiguous reverts may mean: id, how many do, and the first of them. No pair of a revert and an outcome is made."""
    several = decisions.where("reason = 'ambiguous' and candidates > 1").select("sha")
    r = reverts.where("sha is not null").groupBy("sha").agg(F.min(F.struct("repo", "issue_id", "ts")).alias("r")).select("sha", "r.*").join(several, "sha", "left_semi")
    # what comes up to so many days later is what came before, in time that runs backwards
    back = F.timestamp_micros(-micros("ts")).alias("back")
    marks = r.where(F.col("repo") != UNQUALIFIED).select("repo", "issue_id", back, F.lit(1).cast("long").alias("reverts"), F.struct("ts", "sha").alias("first"))
    near = within(outcomes.select("id", "repo", "issue_id", back), marks, ["repo", "issue_id"], "back", days * DAY, {"reverts": "sum", "first": "min"})
    return near.where("reverts > 0").select("id", "reverts", F.col("first.sha").alias("first_revert"))

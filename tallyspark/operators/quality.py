"""Quality of outcomes from their events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.ranges import within

# Floors of quality.
CLEAN, CORRECTED, CI_FAIL, CI_FAIL_CORRECTED, STRATEGIC, REVERTED = 1.0, 0.85, 0.7, 0.55, 0.8, 0.1
CI = ("ci_pass", "ci_fail", "ci_fail_flaky")


def evidence(events: DataFrame) -> DataFrame:
    """checks count if a push triggered them or the trigger isn't known; reverts always do."""
    return events.where(~F.col("event_type").isin(*CI) | F.col("trigger_event").isNull() | (F.col("trigger_event") == "push"))


def resolved(outcomes: DataFrame, events: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """Id and quality of each outcome: the least of the floors of its checks and its reverts.

    A failed check that a flaky run of the same commit and workflow speaks for doesn't count. An outcome in corrected
    (id: confirmed within its 14 days) has the lower floor of its checks.
    """
    seen = evidence(events)
    flaky = seen.where("event_type = 'ci_fail_flaky'").select("outcome_id", "head_sha", "workflow_id").distinct()
    fails = seen.where("event_type = 'ci_fail'").join(flaky, ["outcome_id", "head_sha", "workflow_id"], "left_anti").select("outcome_id").distinct().withColumn("failed", F.lit(True))
    floor = F.when(F.col("event_type") == "revert_quality", REVERTED).when(F.col("event_type") == "revert_strategic", STRATEGIC)
    reverts = seen.groupBy("outcome_id").agg(F.min(floor).alias("revert"))
    o = outcomes.select("id").join(fails.withColumnRenamed("outcome_id", "id"), "id", "left").join(reverts.withColumnRenamed("outcome_id", "id"), "id", "left")
    o = o.join(corrected.select("id").distinct().withColumn("fixed", F.lit(True)), "id", "left") if corrected is not None else o.withColumn("fixed", F.lit(None).cast("boolean"))
    check = F.when(F.col("failed") & F.col("fixed"), CI_FAIL_CORRECTED).when(F.col("fixed"), CORRECTED).when(F.col("failed"), CI_FAIL).otherwise(CLEAN)
    return o.select("id", F.least(check, F.coalesce("revert", F.lit(CLEAN))).alias("quality"))


def evidence_share(outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """Weight with evidence over all weight, by repository, in halves of a point so that sums are whole."""
    with_any = evidence(events).select(F.col("outcome_id").alias("id")).distinct().withColumn("seen", F.lit(True))
    w = F.floor(F.col("weight") * 2)
    o = outcomes.join(with_any, "id", "left")
    return o.groupBy("repo").agg(F.sum(w).alias("weight2"), F.sum(F.when(F.col("seen"), w).otherwise(0)).alias("seen2")).withColumn("share", F.col("seen2") / F.col("weight2"))


def reruns(events: DataFrame, minutes: int = 30) -> DataFrame:
    """T5: successes within so many minutes of a failed, earlier attempt of the same commit and workflow."""
    run = ["head_sha", "workflow_id"]
    failed = events.where("event_type = 'ci_fail'").select(*run, "event_ts", F.col("attempt").alias("failed"))
    ok = events.where("event_type = 'ci_pass'").select(*run, "event_ts", "attempt")
    hit = within(ok, failed, run, "event_ts", minutes * 60_000_000, {"failed": "min"})
    return hit.where("attempt > failed").select(*run, "attempt").distinct()

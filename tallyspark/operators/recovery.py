"""Attribution that is found later: branches and pull requests that spend belongs to, and who may claim it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.scalars import micros, unattributed
from tallyspark.operators.ranges import within


def branch_windows(outcomes: DataFrame, days: int = 7) -> DataFrame:
    """Each merge with the start of its branch's window: the previous strictly earlier merge of the branch, or so
    many days before it was opened, whichever is later. Merges at one time share a start."""
    before = Window.partitionBy("repo", "head_branch_hash").orderBy(micros("merged_at")).rangeBetween(Window.unboundedPreceding, -1)
    previous = F.max("merged_at").over(before)
    return outcomes.withColumn("window_start", F.greatest(previous, F.col("created_at") - F.expr(f"INTERVAL {days} DAYS")))


def claims(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """J5/J6/U-1: pairs of an unattributed event and an outcome whose branch, or else whose pull request, it fits in time.

    A branch's windows meet at most in their ends, so an event fits the branch's next merge, or the one after where it is
    at the very time of a merge; both are carried along the branch in order of time, and no event meets all merges. A pull
    request is merged once or a few times, so by number events and outcomes are joined.
    """
    o = branch_windows(outcomes).select("repo", F.col("head_branch_hash").alias("branch_hash"), "pr_number", F.col("issue_id").alias("claim"), F.col("id").alias("outcome_id"), "window_start", "merged_at")
    e = events.where(unattributed(F.col("issue_id")))
    inside = (F.col("ts") >= F.col("window_start")) & (F.col("ts") <= F.col("merged_at"))
    branch, asked = ["repo", "branch_hash"], ["id", "ts", "cost_micro"]
    merges = o.dropna(subset=[*branch, "merged_at"]).groupBy(*branch, micros("merged_at").alias("t")).agg(F.collect_list(F.struct("claim", "outcome_id", "window_start", "merged_at")).alias("fits"))
    both = e.dropna(subset=[*branch, "ts"]).select(*branch, micros("ts").alias("t"), *asked, F.lit(True).alias("asks")).unionByName(merges, allowMissingColumns=True)
    later = Window.partitionBy(*branch).orderBy(F.desc("t"))
    merge = F.when(F.col("asks").isNull(), F.struct("t", "fits"))
    ahead = lambda end: F.last(merge, ignorenulls=True).over(later.rangeBetween(Window.unboundedPreceding, end))
    near = both.withColumns({"next": ahead(Window.currentRow), "after": ahead(-1)}).where("asks")
    fits = F.concat(F.coalesce("next.fits", F.array()), F.when(F.col("next.t") == F.col("t"), F.coalesce("after.fits", F.array())).otherwise(F.array()))
    by_branch = near.select(*asked, F.explode(fits).alias("fit")).select(*asked, "fit.*").where(inside)
    by_number = e.where("branch_hash is null and pr_number is not null").join(o.drop("branch_hash"), ["repo", "pr_number"]).where(inside)
    return by_branch.select("id", "ts", "cost_micro", "claim", "outcome_id").unionByName(by_number.select("id", "ts", "cost_micro", "claim", "outcome_id"))


def recovered(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events that exactly one issue claims, with it."""
    key = ["id", "ts", "cost_micro"]
    return claims(events, outcomes).groupBy(*key).agg(F.min("claim").alias("issue_id"), F.max("claim").alias("other")).where("issue_id = other").drop("other")


def receipt(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What became of unattributed spend: rows and cost by disposition, which sum to all of it."""
    e = events.where(unattributed(F.col("issue_id"))).groupBy("id", "ts", "cost_micro").agg(F.count("*").alias("rows"))
    c = claims(events, outcomes).groupBy("id", "ts", "cost_micro").agg(F.countDistinct("claim").alias("claims"))
    n = F.coalesce("claims", F.lit(0))
    said = F.when(n == 0, F.lit("unclaimed")).when(n == 1, F.lit("recovered")).otherwise(F.lit("contested"))
    return e.join(c, ["id", "ts", "cost_micro"], "left").groupBy(said.alias("disposition")).agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("cost_micro")).alias("cost_micro"))


def commit_of_session(messages: DataFrame, commits: DataFrame, minutes: int = 30) -> DataFrame:
    """The first commit, in commit order, of a message's branch within so many minutes of it, both ends in."""
    c = commits.select("branch", "ts", F.struct("ord", "subject").alias("first"))
    near = within(messages, c, ["branch"], "ts", minutes * 60_000_000, {"first": "min"}, ahead=True)
    return near.where("first is not null").select(*messages.columns, "first.*")


def reverted_outcome(reverts: DataFrame, outcomes: DataFrame, key: list[str], days: int = 60) -> DataFrame:
    """Each revert (key, ts) with how many outcomes of its key it may mean, of the last so many days, and the one
    where it is only one. reverts may have sha, of the commit that its footer names: then the outcome merged by it is
    meant, and a commit that no outcome has forbids guessing."""
    named = "sha" in reverts.columns
    o = outcomes.select(*key, "ts", F.lit(1).cast("long").alias("candidates"), F.col("id").alias("one"))
    guess = within(reverts, o, key, "ts", days * 86_400_000_000, {"candidates": "sum", "one": "sum"})
    guess = guess.withColumn("outcome_id", F.when(F.col("candidates") == 1, F.col("one"))).drop("one")
    if not named:
        return guess
    by_sha = outcomes.where("merge_sha is not null").groupBy(F.col("merge_sha").alias("sha")).agg(F.min("id").alias("exact"))
    told = guess.join(by_sha, "sha", "left")
    return told.withColumns({"candidates": F.when(F.col("sha").isNull(), F.col("candidates")).otherwise(F.col("exact").isNotNull().cast("long")), "outcome_id": F.when(F.col("sha").isNull(), F.col("outcome_id")).otherwise(F.col("exact"))}).drop("exact")


def followed(outcomes: DataFrame, days: int = 14) -> DataFrame:
    """Outcomes whose branch has another one's merge at the same time or up to so many days later."""
    o = outcomes.select("id", "repo", "head_branch_hash", (-micros("merged_at")).alias("before"))
    o = o.withColumn("t", F.timestamp_micros("before"))
    near = within(o, o.select("repo", "head_branch_hash", "t", F.col("id").alias("low"), F.col("id").alias("high")), ["repo", "head_branch_hash"], "t", days * 86_400_000_000, {"low": "min", "high": "max"})
    return near.where("low != id or high != id").select("id", "repo").distinct()


def counter_deltas(counters: DataFrame) -> DataFrame:
    """Per-call amounts from counters that only grow; a session in which one falls is left out whole."""
    w = Window.partitionBy("session").orderBy("ordinal")
    d = counters.withColumn("delta", F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0)))
    return d.withColumn("bad", F.bool_or(F.col("delta") < 0).over(Window.partitionBy("session"))).where("not bad").select("session", "ordinal", "delta")


def first_model(rows: DataFrame) -> DataFrame:
    """A row without a model takes the session's first; sessions without any go."""
    w = Window.partitionBy("session").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("model", F.coalesce("model", F.first("model", ignorenulls=True).over(w))).where("model is not null")


def push_owner(pushes: DataFrame) -> DataFrame:
    """The commit that owns a repository's, issue's and day's pushes: the first pushed, ties by commit."""
    w = Window.partitionBy("repo", "issue_id", "day").orderBy("push_order", "commit_sha")
    return pushes.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def _islands(runs: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("covered_from", "settled_through")
    before = F.max("settled_through").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("opens", F.when(before.isNull() | (F.col("covered_from") > before), 1).otherwise(0))
    island = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("covered_from").alias("covered_from"), F.max("settled_through").alias("settled_through"), F.sum("runs").alias("runs"))


def source_runs(runs: DataFrame) -> DataFrame:
    """T4: joins runs of a source that meet or overlap: from, until, and how many.

    The runs that begin on one day are joined first, so that a source's one order holds what is left of its days.
    """
    days = _islands(runs.withColumns({"day": F.to_date("covered_from"), "runs": F.lit(1).cast("long")}), "source", "day")
    return _islands(days.drop("island"), "source")


def canonical(rows: DataFrame, aliases: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows whose developer is an alias take its canonical id, one hop. Aliases are broadcast if they are few."""
    few = aliases.limit(most + 1).count() <= most
    a = aliases.select(F.col("alias").alias("developer"), "canonical")
    return rows.join(F.broadcast(a) if few else a, "developer", "left").withColumn("developer", F.coalesce("canonical", "developer")).drop("canonical")


def unsealed(rows: DataFrame, seals: DataFrame, days: int = 14) -> DataFrame:
    """rows in no sealed span (starts, ends), nor in the days before one. There is a seal a month, so seals are broadcast."""
    s = F.broadcast(seals.select("starts", "ends"))
    return rows.join(s, (F.col("ts") < F.col("ends")) & (F.col("ts") >= F.col("starts") - F.expr(f"INTERVAL {days} DAYS")), "left_anti")


def as_of(messages: DataFrame, changes: DataFrame, key: str, value: str, ts: str = "ts") -> DataFrame:
    """Messages with the value that the latest change of their key, at their time or before, had set; null before any.

    Both are put in one order by key and time, changes first at equal times, and values are carried forward; no pair of
    a message and a change is made.
    """
    names = messages.columns
    m = messages.select(key, ts, F.lit(1).alias("kind"), F.struct(*names).alias("row"), F.lit(None).cast(changes.schema[value].dataType).alias(value))
    c = changes.select(key, ts, F.lit(0).alias("kind"), F.lit(None).cast(m.schema["row"].dataType).alias("row"), value)
    w = Window.partitionBy(key).orderBy(ts, "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = m.unionByName(c).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return carried.where("kind = 1").select("row.*", value)


def released(messages: DataFrame, now: str, minutes: int = 10) -> DataFrame:
    """Messages of sessions that have been idle for so many minutes; others are held back for their next lines."""
    last = messages.groupBy("session").agg(F.max("ts").alias("last"))
    idle = last.where(F.col("last") <= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return messages.join(idle.select("session"), "session", "left_semi")

"""Direct pushes by day, whose owner follows the commits that are left: a commit that a pull request merged is taken out again."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.shared import written

#: Places of entries in the order of pushes: commits nobody recorded come first, pushes without a time last, by arrival.
FIRST, UNKNOWN = 0, 2**63 - 1
MARKER = "pre-ledger:"
DAY = ("repo", "issue_id", "day")
#: What decides among a day's commits, in this order, and who pushed.
BEST = ("push_order", "arrival", "ts", "commit_sha", "developer")
#: Arrivals of what the ledger held before lie below all numbers of new commands.
EARLIER = 2**62
#: A day's commands are taken in order in spans of 2 ** SPAN numbers, so that a hot day is many tasks.
SPAN = 18
TURN = "repo string, issue_id string, day string, span long, t long, step boolean, dies long, push_order long, arrival long, ts timestamp_ntz, commit_sha string, developer string"
MOVE = "repo string, issue_id string, day string, seq long, commit_sha string, commit_developer string, was_developer string, was_ts timestamp_ntz, gone boolean, is_developer string, is_ts timestamp_ntz"
ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
DELIVERY = "seq long, repo string, commit_sha string, issue_id string, day string, developer string, ts timestamp_ntz, pushed_at timestamp_ntz"
ENTRY = "id long, repo string, commit_sha string, issue_id string, day string, developer string, ts timestamp_ntz, push_order long"
ROW = "id long, repo string, issue_id string, day string, developer string, ts timestamp_ntz"


@dataclass(frozen=True)
class Pushes:
    """statuses: seq, status. ledger: commits that count, with place in the order. days: repo, issue_id, day, developer, ts, commits.
    audit: repo, issue_id, day, seq, action, developer, ts, commit_sha, commit_developer; it is worked out when it is asked for."""

    statuses: DataFrame
    ledger: DataFrame
    days: DataFrame
    audited: Callable[[], DataFrame]

    @cached_property
    def audit(self) -> DataFrame:
        return self.audited()


def large(df: DataFrame) -> DataFrame:
    """A side that grows with the ledger. Its files say little of its rows, which are made several times as many or are far larger
    in memory, so it is never broadcast by their size."""
    return df.hint("merge")


def push_order(pushed_at: Column) -> Column:
    """Seconds of a push; a missing time, or one not after the epoch, can't be ordered by."""
    at = F.unix_seconds(pushed_at.cast("timestamp"))
    return F.when(at > FIRST, at).otherwise(F.lit(UNKNOWN))


def _placed(order: Column) -> Column:
    """What tells pushes without a time apart: their arrival."""
    return F.when(order == UNKNOWN, F.col("came")).otherwise(F.lit(0))


def blocks(start: Column, end: Column, bits: int) -> Column:
    """The fewest aligned blocks (level, block), of 2 ** level whole numbers each, that make up start <= t < end <= 2 ** bits."""

    def at(level: Column) -> Column:
        low = F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        high = F.call_function("shiftright", end, level)
        part = lambda odd, block: F.when((low < high) & (odd % 2 == 1), F.struct(level.alias("level"), block.alias("block")))
        return F.array(part(low, low), part(high, high - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), at)), lambda x: x.isNotNull())


def best_at(points: DataFrame, lives: DataFrame, key: tuple[str, ...], bits: int) -> DataFrame:
    """points (key, t) with best, the least of the lives (key, born, dies, best) that hold t (born <= t < dies); null without one.

    A life is cut into aligned blocks, of which a point looks up the one of each level that it lies in: equal keys, no pairs of a point
    and a life, and no key's rows in one order. Points make bits + 1 rows each, lives at most twice as many.
    """
    part = ("level", "block")
    least = lives.select(*key, "best", F.explode(blocks(F.col("born"), F.col("dies"), bits)).alias("x")).select(*key, "best", "x.*").groupBy(*key, *part).agg(F.min("best").alias("best"))
    over = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", F.col("t"), level).alias("block")))
    asked = points.select(*key, "t").distinct().select(*key, "t", F.explode(over).alias("x")).select(*key, "t", "x.*")
    found = large(asked).join(large(least), [*key, *part]).groupBy(*key, "t").agg(F.min("best").alias("best"))
    return large(points).join(large(found), [*key, "t"], "left")


def pushed(deliveries: DataFrame, merges: DataFrame, ledger: DataFrame | None = None, unlisted: DataFrame | None = None) -> Pushes:
    """Folds deliveries of pushed commits (DELIVERY) and merges of pull requests (seq, sha) into the ledger and its day rows.

    seq, from 1 on, orders both as they came in; a merge that was stored before has 0. ledger (ENTRY) is what the ledger holds so far, and
    its day rows stand at their first commit. unlisted (ROW) are day rows from before there was a ledger: a marker stands for
    their unknown commits once one is added, so they keep their owner and are never taken out.

    A commit counts from its first delivery until a pull request merges it, in any repository; after that it is captured. Another
    delivery is a duplicate, which may only give it an earlier place. A day row is owned by its first commit by place, arrival where
    no push has a time, time and id, and goes with its last commit. The audit has each owner that a command changed, from and to, and
    each row that one took out, with the commit and its author.

    Deliveries without repository, issue, day, seq or commit, or whose commit id has a colon, are refused, and merges without
    a valid id do nothing. Of rows with one seq the least counts. Null developers and times are values. Empty tables are allowed, and
    columns beside those named are left out.
    """
    spark = deliveries.sparkSession
    ledger = spark.createDataFrame([], ENTRY) if ledger is None else ledger
    unlisted = spark.createDataFrame([], ROW) if unlisted is None else unlisted
    commit = ("repo", "commit_sha")
    names = [c.split()[0] for c in DELIVERY.split(", ")]
    d = deliveries.select(*names).where("seq is not null").groupBy("seq").agg(F.min(F.struct(*names[1:])).alias("x")).select("seq", "x.*")
    valid = lambda sha: F.coalesce((F.col(sha) != "") & ~F.col(sha).contains(":"), F.lit(False))
    fit = valid("commit_sha") & F.col("repo").isNotNull() & F.col("issue_id").isNotNull() & (F.coalesce("day", F.lit("")) != "") & (F.col("seq") > 0)
    m = written(merges.where(valid("sha") & F.col("seq").isNotNull()).groupBy(F.col("sha").alias("commit_sha")).agg(F.min("seq").alias("merged")), "merges")
    told = large(d.withColumn("refused", ~fit)).join(large(m), "commit_sha", "left")
    told = written(told.withColumn("captured", ~F.col("refused") & F.coalesce(F.col("merged") <= F.col("seq"), F.lit(False))), "deliveries")
    live = told.where("not refused and not captured").withColumn("push_order", push_order(F.col("pushed_at")))

    # what a commit's entry says is its first delivery's; places come from all of them
    held = ledger.select(*commit, F.lit(0).cast("long").alias("born"), (F.col("id") - EARLIER).alias("came"), "issue_id", "day", "developer", "ts", "push_order")
    came = live.select(*commit, F.col("seq").alias("born"), F.col("seq").alias("came"), "issue_id", "day", "developer", "ts", "push_order")
    both = held.unionByName(came)
    first = both.groupBy(*commit).agg(F.min(F.struct("came", "issue_id", "day", "developer", "ts")).alias("e"), F.min("push_order").alias("least"))
    entries = written(large(first.select(*commit, "e.*", "least")).join(large(m), "commit_sha", "left"), "entries")
    status = F.when(F.col("refused"), F.lit("refused")).when(F.col("captured"), F.lit("pr_captured")).when(F.col("came").eqNullSafe(F.col("seq")), F.lit("recorded")).otherwise(F.lit("duplicate"))
    statuses = large(told).join(large(entries.select(*commit, "came")), list(commit), "left").select("seq", status.alias("status"))

    markers = large(unlisted).join(large(ledger.select(*DAY).distinct()), list(DAY), "left_anti").groupBy(*DAY).agg(F.min(F.struct("id", "developer", "ts")).alias("u")).select(*DAY, "u.*")
    markers = written(large(markers).join(large(entries.where("came > 0").select(*DAY, F.lit(True).alias("added")).distinct()), list(DAY), "left"), "markers")
    marked = markers.where("added").select(*DAY, F.concat(F.lit(MARKER), F.col("id").cast("string")).alias("commit_sha"), "developer", "ts", F.lit(FIRST).cast("long").alias("push_order"), F.lit(0).cast("long").alias("arrival"))

    now = entries.where("merged is null").select(*DAY, "commit_sha", "developer", "ts", F.col("least").alias("push_order"), _placed(F.col("least")).alias("arrival")).unionByName(marked)
    owners = now.groupBy(*DAY).agg(F.min(F.struct(*BEST)).alias("best"), F.count("*").alias("commits")).select(*DAY, "best.developer", "best.ts", "commits")
    untouched = markers.where("added is null").select(*DAY, "developer", "ts", F.lit(0).cast("long").alias("commits"))

    return Pushes(statuses, now.drop("arrival"), owners.unionByName(untouched), lambda: _audited(both, entries, marked))


def _audited(both: DataFrame, entries: DataFrame, marked: DataFrame) -> DataFrame:
    """Each change of a day's owner by a command: both has every delivery that counts, entries one row for each commit.

    A day's commands are cut into spans of 2 ** SPAN numbers. Within one they are taken in order, with the lives that begin in it, those
    that end in it, and the best of those that go through, which is looked up once for a span.
    """
    commit = ("repo", "commit_sha")
    said = entries.select(*commit, *DAY[1:], "developer", "ts", "came", "merged")
    versions = written(large(both.select(*commit, "born", "push_order")).join(large(said), list(commit)), "versions")
    top = versions.agg(F.greatest(F.max("born"), F.max("merged"), F.lit(0).cast("long"))).first()[0]
    bits = (top or 0).bit_length()
    end, span = F.lit(1 << bits).cast("long"), lambda t: F.call_function("shiftright", t, F.lit(SPAN))
    before = lambda span: F.call_function("shiftleft", span, F.lit(SPAN)) - 1
    lives = versions.withColumn("dies", F.coalesce("merged", end)).where("born < dies").withColumn("arrival", _placed(F.col("push_order"))).select(*DAY, "born", "dies", *BEST)
    lives = lives.unionByName(marked.select(*DAY, F.lit(0).cast("long").alias("born"), end.alias("dies"), *BEST)).withColumns({"first": span(F.col("born")), "last": span(F.col("dies"))})
    steps = versions.where("born > 0").select(*DAY, F.col("born").alias("t"), *BEST[3:]).unionByName(entries.where("merged > 0").select(*DAY, F.col("merged").alias("t"), *BEST[3:]))
    steps = steps.withColumn("span", span(F.col("t")))
    begun = lives.select(*DAY, F.col("first").alias("span"), F.col("born").alias("t"), "dies", *BEST)
    ended = lives.where((F.col("first") < F.col("last")) & (F.col("dies") < end)).select(*DAY, F.col("last").alias("span"), before(F.col("last")).alias("t"), "dies", *BEST)
    rows = begun.unionByName(ended)
    if bits > SPAN:
        through = lives.where("first + 1 < last").groupBy(*DAY, (F.col("first") + 1).alias("born"), F.col("last").alias("dies")).agg(F.min(F.struct(*BEST)).alias("best"))
        asked = best_at(steps.select(*DAY, F.col("span").alias("t")).distinct(), through, DAY, bits - SPAN).where("best is not null")
        rows = rows.unionByName(asked.select(*DAY, F.col("t").alias("span"), before(F.col("t")).alias("t"), end.alias("dies"), "best.*"))
    rows = rows.withColumn("step", F.lit(False)).unionByName(steps.withColumn("step", F.lit(True)), allowMissingColumns=True)
    moved = rows.select(*(c.split()[0] for c in TURN.split(", "))).repartition(*DAY, "span").sortWithinPartitions(*DAY, "span", "t", "step").mapInArrow(_moved, MOVE)
    image = lambda action, owner: F.struct(F.lit(action).alias("action"), F.col(f"{owner}_developer").alias("developer"), F.col(f"{owner}_ts").alias("ts"))
    images = F.when(F.col("gone"), F.array(image("superseded", "was"))).otherwise(F.array(image("rederived_from", "was"), image("rederived_to", "is")))
    return moved.select(*DAY, "seq", "commit_sha", "commit_developer", F.explode(images).alias("x")).select(*DAY, "seq", "x.*", "commit_sha", "commit_developer")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by day, span, time and step the steps that change the owner. Of a span its lives are held, the best on top."""
    names, schema = [x.split()[0] for x in TURN.split(", ")], pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in MOVE.split(", "))])
    key, at, was, alive = None, None, None, []
    for b in batches:
        out = []
        for repo, issue, day, span, t, step, dies, *best in zip(*(micros(b.column(n)).to_pylist() for n in names), strict=True):
            if (repo, issue, day, span) != key:
                key, at, alive = (repo, issue, day, span), None, []
            if t != at:
                at = t
                while alive and alive[0][1] < t:
                    heapq.heappop(alive)
                was = alive[0][2] if alive else None
            if not step:
                heapq.heappush(alive, ([(x is not None, x) for x in best], dies, (best[4], best[2])))
            elif was is not None:
                while alive and alive[0][1] <= t:
                    heapq.heappop(alive)
                is_ = alive[0][2] if alive else None
                if is_ != was:
                    out.append((repo, issue, day, t, best[3], best[4], *was, is_ is None, *(is_ or (None, None))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)


def micros(column: pa.Array) -> pa.Array:
    """Times as whole numbers, which hold any year; other columns as they are."""
    return column.cast(pa.int64()) if pa.types.is_timestamp(column.type) else column

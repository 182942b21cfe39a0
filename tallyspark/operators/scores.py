"""Points, costs and their ratio by developer, label and work type; floors, suppression and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.scalars import micros, unattributed
from tallyspark.sources.bridge import UNQUALIFIED

#: Evidence floors of a ranked row, in outcomes and micro-dollars; and the fewest people that a label may name.
FLOOR_N, FLOOR_MICRO, K = 3, 5_000_000, 3
OTHER = "other"


def in_window(df: DataFrame, since: str | None = None, until: str | None = None, ts: str = "ts") -> DataFrame:
    """rows of [since, until); either end may be open."""
    if since:
        df = df.where(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    return df.where(F.col(ts) < F.lit(until).cast("timestamp_ntz")) if until else df


def in_repo(df: DataFrame, repo: str | None) -> DataFrame:
    """rows of one repository exactly; all rows for None."""
    return df if repo is None else df.where(F.col("repo") == repo)


def developer_cost(events: DataFrame) -> DataFrame:
    """A1: total and realtime cost by developer."""
    return events.groupBy("developer").agg(F.sum("cost_micro").alias("cost_micro"), F.sum(F.when(F.col("fidelity") == "realtime", F.col("cost_micro")).otherwise(0)).alias("realtime_micro"))


def issue_cost(events: DataFrame, *keys: str) -> DataFrame:
    """A2: cost by developer, repository and issue (or other keys), in all and captured realtime."""
    keys = keys or ("developer", "repo", "issue_id")
    captured = ~F.col("source").isin("anthropic-admin", "openai-usage", "copilot-billing", "cursor-admin")
    return events.groupBy(*keys).agg(
        F.sum("cost_micro").alias("cost_micro"),
        F.sum(F.when(captured & (F.col("fidelity") == "realtime"), F.col("cost_micro")).otherwise(0)).alias("realtime_micro"),
        F.sum(F.when(captured & (F.col("fidelity") != "realtime"), F.col("cost_micro")).otherwise(0)).alias("late_micro"),
        F.count("*").alias("n"),
    )


def ratios(df: DataFrame) -> DataFrame:
    """A3/A5: the ratios of sums points20, cost_micro, realtime_micro, paid_micro, n and flagged, guarded where a divisor is 0."""
    points, dollars, paid = F.col("points20") / 20, F.col("cost_micro") / 1e6, F.col("paid_micro") / 1e6
    return df.withColumns(
        {
            "points": points,
            "points_per_k": F.when(F.col("cost_micro") > 0, points / (dollars / 1000)).otherwise(0.0),
            "coverage_pct": F.when(F.col("cost_micro") > 0, F.col("realtime_micro") / F.col("cost_micro") * 100).otherwise(0.0),
            "cost_per_point": F.when(F.col("points20") > 0, dollars / points),
            "leverage": F.when(F.col("paid_micro") > 0, dollars / paid).otherwise(0.0),
            "ranked": (F.col("flagged") == 0) & (F.col("n") >= FLOOR_N) & (F.col("cost_micro") >= FLOOR_MICRO),
        }
    )


def zero_token_outcomes(outcomes: DataFrame, events: DataFrame, days: int = 14) -> DataFrame:
    """Outcomes with their tokens: those of the issue in its repository, by the outcome's developer, over the
    window that ends with the issue's latest outcome by anybody, both ends in. Reused issues keep the freshest window."""
    tokens = F.col("input_tok") + F.col("output_tok") + F.col("cache_read") + F.col("cache_write_5m") + F.col("cache_write_1h")
    latest = outcomes.groupBy("repo", "issue_id").agg(F.max("ts").alias("latest"))
    hits = events.join(latest, ["repo", "issue_id"]).where((F.col("ts") <= F.col("latest")) & (F.col("ts") >= F.col("latest") - F.expr(f"INTERVAL {days} DAYS")))
    sums = hits.groupBy("repo", "issue_id", "developer").agg(F.sum(tokens).alias("tokens"))
    return outcomes.join(sums, ["repo", "issue_id", "developer"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))


def developer_scores(events: DataFrame, outcomes: DataFrame, paid: DataFrame | None = None) -> DataFrame:
    """One row per developer with cost, outcomes or both."""
    cost = developer_cost(events)
    work = outcomes.groupBy("developer").agg(F.sum("points20").alias("points20"), F.count("*").alias("n"), F.sum(F.when(F.col("tokens") == 0, 1).otherwise(0)).alias("flagged") if "tokens" in outcomes.columns else F.lit(0).cast("long").alias("flagged"))
    all_ = cost.join(work, "developer", "full_outer")
    all_ = all_.join(paid, "developer", "full_outer") if paid is not None else all_.withColumn("paid_micro", F.lit(0).cast("long"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return ratios(all_.withColumns({c: zero(c) for c in ("cost_micro", "realtime_micro", "points20", "n", "flagged", "paid_micro")}))


def labelled(df: DataFrame, memberships: DataFrame, label: str, ts: str = "ts") -> DataFrame:
    """Rows with the label (team or division) of their developer at their own time, the empty string without one.

    Spans don't overlap, so no row is doubled. Equal developers meet by shuffle; the time is a residual condition.
    """
    m = memberships.select(F.col("developer").alias("m_dev"), F.col(label).alias("label"), "valid_from", "valid_to")
    on = (F.col("developer") == F.col("m_dev")) & (F.col(ts) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to")))
    return df.join(m, on, "left").withColumn("label", F.coalesce("label", F.lit(""))).drop("m_dev", "valid_from", "valid_to")


def label_scores(events: DataFrame, outcomes: DataFrame, memberships: DataFrame, label: str) -> DataFrame:
    """Ratios of sums by label; a day on which somebody moves counts for where they were at each row's time."""
    cost = labelled(events, memberships, label).groupBy("label").agg(F.sum("cost_micro").alias("cost_micro"), F.sum(F.when(F.col("fidelity") == "realtime", F.col("cost_micro")).otherwise(0)).alias("realtime_micro"))
    work = labelled(outcomes, memberships, label).groupBy("label").agg(F.sum("points20").alias("points20"), F.count("*").alias("n"))
    both = cost.join(work, "label", "full_outer").fillna(0, ["cost_micro", "realtime_micro", "points20", "n"])
    return ratios(both.withColumns({"flagged": F.lit(0).cast("long"), "paid_micro": F.lit(0).cast("long")}))


def company_score(scores: DataFrame) -> DataFrame:
    """The ratios of the sums over all developers; no row for no developers."""
    sums = scores.groupBy().agg(*(F.sum(c).alias(c) for c in ("cost_micro", "realtime_micro", "points20", "n", "flagged", "paid_micro")), F.count("*").alias("developers"))
    return ratios(sums.where("developers > 0"))


def joined_cost(keys: DataFrame, costs: DataFrame) -> DataFrame:
    """For each (developer, issue, repo), the cost of its own repository and of rows without one; for a key without
    one, of all repositories. Three sums by equal keys, so that no OR is left in a join."""
    by_repo = costs.groupBy("developer", "issue_id", "repo").agg(F.sum("cost_micro").alias("own"))
    blind = F.col("repo").isin("", UNQUALIFIED)
    by_issue = costs.groupBy("developer", "issue_id").agg(F.sum("cost_micro").alias("total"), F.sum(F.when(blind, F.col("cost_micro")).otherwise(0)).alias("sentinel"))
    found = keys.join(by_repo, ["developer", "issue_id", "repo"], "left").join(by_issue, ["developer", "issue_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.withColumn("cost_micro", F.when(blind, zero("total")).otherwise(zero("own") + zero("sentinel")).cast("long")).drop("own", "total", "sentinel")


def work_type_segments(outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """Points by type of work and developer, and only the cost of their issues, each issue once."""
    points = outcomes.groupBy("work_type", "developer").agg(F.sum("points20").alias("points20"), F.count("*").alias("n"))
    keys = outcomes.select("work_type", "developer", "issue_id", "repo").distinct()
    cost = joined_cost(keys, events).groupBy("work_type", "developer").agg(F.sum("cost_micro").alias("cost_micro"))
    return points.join(cost, ["work_type", "developer"]).select("work_type", "developer", "points20", "n", "cost_micro")


def reconciliation(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The window's cost as linked to an outcome, without one, and unattributed; the parts sum to the whole."""
    real = outcomes.groupBy("developer", "issue_id").agg(F.bool_or(F.col("repo") == UNQUALIFIED).alias("blind"))
    own = outcomes.select("developer", "issue_id", "repo").distinct().withColumn("same", F.lit(True))
    e = events.join(real, ["developer", "issue_id"], "left").join(own, ["developer", "issue_id", "repo"], "left")
    linked = F.col("blind").isNotNull() & (F.col("blind") | F.col("same").isNotNull() | (F.col("repo") == UNQUALIFIED))
    part = F.when(unattributed(F.col("issue_id")), F.lit("unattributed")).when(linked, F.lit("linked")).otherwise(F.lit("no_outcome"))
    total = lambda name: F.coalesce(F.sum(F.when(part == name, F.col("cost_micro"))), F.lit(0)).alias(f"{name}_micro")
    return e.agg(F.coalesce(F.sum("cost_micro"), F.lit(0)).alias("window_micro"), total("linked"), total("no_outcome"), total("unattributed"))


def issue_report(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A10: by repository and issue: cost, points and what is known of it."""
    cost = events.where(~unattributed(F.col("issue_id"))).groupBy("repo", "issue_id").agg(F.sum("cost_micro").alias("cost_micro"))
    work = outcomes.groupBy("repo", "issue_id").agg(F.sum("points20").alias("points20"), F.count("*").alias("n"))
    both = cost.join(work, ["repo", "issue_id"], "full_outer")
    status = F.when(F.col("n").isNull(), F.lit("cost-only")).when(F.col("cost_micro").isNull(), F.lit("outcome-only")).when(F.col("points20") == 0, F.lit("no-points")).otherwise(F.lit("joined"))
    return both.select("repo", "issue_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cost_micro", "points20", "n")), status.alias("status"))


def composition(events: DataFrame, model: Column) -> DataFrame:
    """By normalized model: cost, tokens and the cache-read share of input and cache tokens, dearest first."""
    base = F.sum(F.col("input_tok") + F.col("cache_read") + F.col("cache_write_5m") + F.col("cache_write_1h"))
    return events.groupBy(model.alias("model")).agg(F.sum("cost_micro").alias("cost_micro"), F.count("*").alias("n"), F.sum("cache_read").alias("cache_read"), F.when(base > 0, F.sum("cache_read") / base).alias("read_share")).orderBy(F.desc("cost_micro"), "model")


def unattributed_buckets(events: DataFrame) -> DataFrame:
    """Cost of each bucket without an issue and its share of all unattributed cost, dearest first, ties by name."""
    b = events.where(unattributed(F.col("issue_id"))).groupBy(F.col("issue_id").alias("bucket")).agg(F.sum("cost_micro").alias("cost_micro"))
    return b.withColumn("share", F.col("cost_micro") / F.sum("cost_micro").over(Window.partitionBy())).orderBy(F.desc("cost_micro"), "bucket")


def exploratory_share(events: DataFrame) -> DataFrame:
    """The share of each developer's cost that was spent on main lines."""
    main = F.sum(F.when(F.col("issue_id") == "unattributed:main", F.col("cost_micro")).otherwise(0))
    return events.groupBy("developer").agg(main.alias("main_micro"), F.when(F.sum("cost_micro") > 0, main / F.sum("cost_micro")).otherwise(0.0).alias("share"))


def k_anonymous(scores: DataFrame, people: DataFrame, k: int = K) -> DataFrame:
    """Label sums in which labels under k people fold into other; if other itself is under k, nothing is shown.

    people: label and developer of whoever has cost or outcomes.
    """
    k = max(k, 3)
    n = people.groupBy("label").agg(F.countDistinct("developer").alias("people"))
    named = scores.join(n, "label", "left").withColumn("shown", F.when((F.col("people") >= k) & (F.col("label") != ""), F.col("label")).otherwise(F.lit(OTHER)))
    folded = named.groupBy("shown").agg(*(F.sum(c).alias(c) for c in ("cost_micro", "points20", "n")))
    members = people.join(named.select("label", "shown"), "label").groupBy("shown").agg(F.countDistinct("developer").alias("people"))
    out = folded.join(members, "shown", "left").withColumnRenamed("shown", "label")
    unsafe = F.max(F.when((F.col("label") == OTHER) & (F.col("people") < k), 1).otherwise(0)).over(Window.partitionBy())
    return out.withColumn("unsafe", unsafe).where("unsafe = 0").drop("unsafe")


def compared(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Two windows side by side, with what is in which."""
    a = before.select(key, F.col("points_per_k").alias("before_ratio"), F.col("cost_micro").alias("before_micro"), F.lit(True).alias("in_before"))
    b = after.select(key, F.col("points_per_k").alias("after_ratio"), F.col("cost_micro").alias("after_micro"), F.lit(True).alias("in_after"))
    out = a.join(b, key, "full_outer").fillna(False, ["in_before", "in_after"])
    return out.withColumn("change", F.when(F.col("in_before") & F.col("in_after"), F.col("after_ratio") - F.col("before_ratio")))


def fidelity_mix(events: DataFrame, now: str) -> DataFrame:
    """By source: last time, rows of the last 7 and 30 days, and rows by fidelity, in one scan."""
    at = F.lit(now).cast("timestamp_ntz")
    recent = lambda days: F.count(F.when((F.col("ts") >= at - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") < at), 1)).alias(f"n_{days}d")
    return events.groupBy("source").agg(F.max("ts").alias("last_ts"), recent(7), recent(30), *(F.count(F.when(F.col("fidelity") == f, 1)).alias(f"n_{f}") for f in ("realtime", "daily", "estimated")))


def partition_diagnostics(outcomes: DataFrame) -> DataFrame:
    """How many issues have so many outcomes, and the outcomes' weights, pushes left out."""
    per = outcomes.where("source != 'push'").groupBy("repo", "issue_id").agg(F.count("*").alias("outcomes"), F.sum("points20").alias("points20"), F.sum(F.when(F.col("weight") == 8, 1).otherwise(0)).alias("largest"))
    return per.groupBy("outcomes").agg(F.count("*").alias("issues"), F.sum("points20").alias("points20"), F.sum("largest").alias("largest"))


def join_readiness(events: DataFrame, outcomes: DataFrame, top: int = 50) -> DataFrame:
    """Repositories on one side only, by cost or outcomes, at most top of each kind after sorting."""
    cost = events.where(F.col("repo") != UNQUALIFIED).groupBy("repo").agg(F.sum("cost_micro").alias("size")).where("size > 0")
    work = outcomes.where(F.col("repo") != UNQUALIFIED).groupBy("repo").agg(F.count("*").alias("size"))
    one = lambda a, b, kind: a.join(b.select("repo"), "repo", "left_anti").orderBy(F.desc("size"), "repo").limit(top).withColumn("kind", F.lit(kind))
    return one(cost, work, "cost-only").unionByName(one(work, cost, "outcome-only")).select("kind", "repo", "size")


# Sources that have recorded when a pull request was opened since a day.
CAPTURED_SINCE, CAPTURING = "2026-10-11", ("github-webhook", "backfill")


def time_to_merge(outcomes: DataFrame, named: DataFrame, safe: bool = True, k: int = K) -> DataFrame:
    """Whole seconds from opening to merge. Rows (kind, name, n, median_s, p90_s, null_reason): a group for each
    named label, the residual of all others, the total, and what is excluded, by reason.

    outcomes have a label; named are the labels that scores show, a small table; safe is false where they show nothing. The median of an even number is the mean of the middle two; the nearest-rank 90th
    percentile needs ten. A figure under k people or k merges is null, and if a cohort with merges is so, the total too.
    """
    k = max(k, 3)
    bot = (F.col("author_type") == "Bot").eqNullSafe(True)
    old = F.col("created_at").isNull() & F.col("source").isin(*CAPTURING) & (F.to_date("ts") < F.lit(CAPTURED_SINCE).cast("date"))
    reason = F.when(bot, F.lit("bot")).when(old, F.lit("no_created_at_before_capture")).when(F.col("created_at").isNull() | (F.col("created_at") > F.col("merged_at")), F.lit("no_created_at")).when(F.col("merged_at").isNull(), F.lit("no_merged_at"))
    people = outcomes.where(~unattributed(F.col("developer"))).withColumns({"reason": reason, "us": micros("merged_at") - micros("created_at")})
    shown = named.where(F.col("label") != OTHER).select("label", F.col("label").alias("name")).distinct()
    known = people.join(shown, "label", "left")
    of = lambda kind, name: F.struct(kind.alias("kind"), name.alias("name"))
    cohort = of(F.when(F.col("name").isNull(), F.lit("residual")).otherwise(F.lit("group")), F.coalesce("name", F.lit(OTHER)))
    # everybody who isn't a bot counts for what is said of exclusions
    counted = F.when(~bot, of(F.lit("people"), F.lit("")))
    rows = F.when(F.col("reason").isNull(), F.array(cohort, of(F.lit("total"), F.lit("")), counted)).otherwise(F.array(of(F.lit("excluded"), F.col("reason")), counted))
    kept = known.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("of"), "us", "developer").select("of.*", "us", "developer")
    by = ["kind", "name"]
    w = Window.partitionBy(*by).orderBy("us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = kept.where("kind not in ('excluded', 'people')").groupBy(*by, "us").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(w))
    size = kept.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("developer").alias("authors"))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("us")))
    n = F.col("n")
    place = values.join(size, by).groupBy(*by).agg(at(F.floor((n + 1) / 2)).alias("low"), at(F.floor(n / 2) + 1).alias("high"), at(n - F.floor(n / 10)).alias("p90"))
    clear, all_ = (n >= k) & (F.col("authors") >= k), Window.partitionBy()  # over a row for each label
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    f = size.join(place, by, "left").withColumn("clear", clear)
    f = f.withColumns({"hidden": F.bool_or(is_("group", "residual") & ~F.col("clear")).over(all_), "enough": F.coalesce(F.max(F.when(is_("people"), F.col("authors"))).over(all_), F.lit(0)) >= k})
    f = f.where(~is_("people")).where(F.lit(safe) | is_("total", "excluded"))
    whole = lambda c: F.floor(c / 1_000_000)
    held = is_("total") & F.col("clear") & (F.col("hidden") | F.lit(not safe))
    told = F.when(is_("excluded"), F.col("enough") & F.lit(safe)).otherwise(F.col("clear") & ~held)
    why = F.when(is_("excluded") & told, None).when(held, F.lit("withheld_with_group")).when(~told, F.lit("authors<k")).when(n < 10, F.lit("n<10"))
    median = whole(F.col("low") + F.floor((F.col("high") - F.col("low")) / 2))
    return f.select(*by, F.when(told, n).alias("n"), F.when(told, median).alias("median_s"), F.when(told & (n >= 10), whole(F.col("p90"))).alias("p90_s"), why.alias("null_reason"))


def poller_remainder(events: DataFrame, polled: Column, model: Column) -> DataFrame:
    """Per day and model, polled tokens less those captured otherwise, not below 0, and what was captured over."""
    n = F.col("input_tok") + F.col("output_tok")
    day = events.groupBy(F.to_date("ts").alias("day"), model.alias("model")).agg(F.sum(F.when(polled, n).otherwise(0)).alias("org"), F.sum(F.when(~polled, n).otherwise(0)).alias("captured"))
    return day.select("day", "model", F.greatest(F.col("org") - F.col("captured"), F.lit(0)).alias("remainder"), F.greatest(F.col("captured") - F.col("org"), F.lit(0)).alias("over"))


def allocated_spend(spend: DataFrame, since: str, until: str | None) -> DataFrame:
    """What each developer paid from the month since up to but without the month until.

    A person's own rows stand. An organisation's invoice of a month, less its people's rows but not below 0, is split
    over its seats without rows of their own; with none it stays unallocated (developer null). A seat is anybody of
    the organisation in any month.
    """
    rows = spend.where((F.col("period") >= since) & (F.lit(True) if until is None else F.col("period") < until))
    own = rows.where("developer is not null").groupBy("org", "period", "developer").agg(F.sum("paid_micro").alias("paid"))
    invoice = rows.where("developer is null").groupBy("org", "period").agg(F.sum("paid_micro").alias("invoice"))
    seats = spend.where("developer is not null").select("org", "developer").distinct()
    rest = invoice.join(own.groupBy("org", "period").agg(F.sum("paid").alias("own")), ["org", "period"], "left").withColumn("rest", F.greatest(F.col("invoice") - F.coalesce("own", F.lit(0)), F.lit(0)))
    open_ = rest.join(seats, "org", "left").join(own.select("org", "period", "developer"), ["org", "period", "developer"], "left_anti")
    count = F.count("developer").over(Window.partitionBy("org", "period"))
    shared = open_.withColumn("paid", F.col("rest") / F.greatest(count, F.lit(1)))
    full = rest.join(open_.select("org", "period").distinct(), ["org", "period"], "left_anti").select(F.lit(None).cast("string").alias("developer"), F.col("rest").cast("double").alias("paid"))
    each = own.select("developer", F.col("paid").cast("double").alias("paid")).unionByName(shared.select("developer", "paid")).unionByName(full)
    return each.groupBy("developer").agg(F.sum("paid").alias("paid_micro"))

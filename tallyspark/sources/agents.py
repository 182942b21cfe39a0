"""Session logs whose agents start sub-agents: calls, the runs that they belong to, and the branches that runs worked on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import scopes
from tallyspark.sources.shared import written

# fixed values: names in the records
RUN, APPROVAL, METADATA, BRANCH = "run", "approval", "metadata", "workspace_branch"
COMPLETED, REVIEWED, TERMINAL, LINKED = "model_completed", "automated_review_completed", "terminal", "memory_reminder_child_session_linked"
UNDECODABLE, NO_ID, NO_MODEL, BAD_USAGE, DUPLICATE, NO_TIME, FUTURE = "undecodable_usage_record", "no_record_id", "no_model", "usage_identity_violation", "duplicate_record_id", "no_timestamp", "timestamp_beyond_clock_horizon"
NO_PARENT, NO_LINK, AMBIGUOUS = "no_parent_log", "no_link", "ambiguous_link"
MOST_TOKENS = 1 << 29
CHILD = r"^(.*)/subagent/([^/]+)/session\.jsonl$"
LINE = """id STRING, recorded_at BIGINT, stream STRUCT<id STRING>, payload STRUCT<kind STRING, run_id STRING,
 event STRUCT<kind STRING, model STRING, usage MAP<STRING, STRING>, parent_run_id STRING, child_session_id STRING, completed_at_ms STRING>,
 record STRUCT<workspace_root STRING, command_id STRING, vcs STRING, reference STRUCT<kind STRING, name STRING>>>, broken STRING"""
AGENT = ("input_tokens", "output_tokens", "cached_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")
REVIEW = ("input_tokens", "cached_input_tokens", "non_cached_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")


@dataclass(frozen=True)
class Sessions:
    """calls: one row for each billed call with what became of it. refused: path, reason, n."""

    calls: DataFrame
    refused: DataFrame


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def _usage(review: Column) -> tuple[Column, Column]:
    """A record's counts as (input_tok, cache_read, output_tok), null where they contradict each other; and whether any is no number.

    Input takes the cached part in, and output the reasoning; what is absent counts as zero, but for input and output.
    """
    raw = F.col("usage")
    n = {c: F.try_element_at(raw, F.lit(c)).try_cast("long") for c in dict.fromkeys(AGENT + REVIEW)}
    zero = lambda c: F.coalesce(n[c], F.lit(0).cast("long"))
    fit = lambda names: F.reduce(F.array(*(zero(c) for c in names)), F.lit(True), lambda s, x: s & (x >= 0) & (x <= MOST_TOKENS))
    wrong = lambda names: F.exists(F.array(*(F.try_element_at(raw, F.lit(c)).isNotNull() & n[c].isNull() for c in names)), lambda x: x)
    given = n["input_tokens"].isNotNull() & n["output_tokens"].isNotNull() & (zero("reasoning_tokens") <= zero("output_tokens"))
    read = F.coalesce(n["cache_read_tokens"], zero("cached_tokens"))
    agent = given & fit(AGENT) & (F.coalesce(n["cached_tokens"], read) == read) & (read + zero("cache_write_tokens") <= zero("input_tokens"))
    cached = zero("cached_input_tokens")
    total = F.coalesce(n["total_tokens"], F.lit(0))
    parts = F.coalesce(cached + n["non_cached_input_tokens"] == n["input_tokens"], F.lit(True)) & ((total == 0) | (total == zero("input_tokens") + zero("output_tokens")))
    reviewed = given & fit(REVIEW) & (cached <= zero("input_tokens")) & parts
    counts = lambda part: F.struct((zero("input_tokens") - part).alias("input_tok"), part.alias("cache_read"), zero("output_tokens").alias("output_tok"))
    return F.when(review & reviewed, counts(cached)).when(~review & agent, counts(read)), F.when(review, wrong(REVIEW)).otherwise(wrong(AGENT))


def records(lines: DataFrame) -> DataFrame:
    """lines (path, line, value) as the columns that anything below reads; blank lines go, and a line that is no record is broken."""
    x = F.from_json("value", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    p = lines.where(F.trim("value") != "").select("path", "line", x.alias("x"))
    e, r = "x.payload.event", "x.payload.record"
    return p.select(
        "path", "line", F.col("x.broken").isNotNull().alias("broken"), _some(F.col("x.id")).alias("id"), F.col("x.recorded_at").alias("at"), _some(F.col("x.stream.id")).alias("stream"), F.col("x.payload.kind").alias("kind"), _some(F.col("x.payload.run_id")).alias("run"),
        F.col(f"{e}.kind").alias("event"), F.col(f"{e}.model").alias("model"), F.col(f"{e}.usage").alias("usage"), _some(F.col(f"{e}.parent_run_id")).alias("parent_run"), _some(F.col(f"{e}.child_session_id")).alias("child"), F.col(f"{e}.completed_at_ms").alias("completed"),
        _some(F.col(f"{r}.workspace_root")).alias("root"), _some(F.col(f"{r}.command_id")).alias("command"), F.when((F.col(f"{r}.vcs") == "git") & (F.col(f"{r}.reference.kind") == "branch"), F.col(f"{r}.reference.name")).alias("branch"),
    )


def sessions(lines: DataFrame, files: DataFrame, targets: DataFrame, roots: DataFrame, now: str, since: str | None = None, grace: str = "6 HOURS", skew: str = "24 HOURS") -> Sessions:
    """Billed calls of session logs and of the sub-agents' logs that lie under them, each with its run's branch.

    lines: path, line (its order in the file), value. files: path, modified_at. targets and roots as in ``scopes.scoped``.
    A call is 'emitted' with the branch that its run recorded; an empty branch where the run recorded none, or none on a branch. A sub-agent's
    call belongs to the run of the parent's log that names the child, and to the parent's workspace, never to its own; a
    child of a child has no workspace by that rule. Everything else is named: 'foreign' (a workspace that is no target's),
    'no_workspace_root', 'held' (the run may still record a branch: no record follows its end, and the logs were written to within grace),
    'unlinked_held' and 'unlinked_excluded' with why (no parent log, no link, or links to several runs), 'earlier' (before since) and 'refused'.

    Records that can't be billed are counted by reason and not guessed: without id, model or time, with contradicting counts, or seen
    before (a record's first good line counts). Calls of no tokens are counted as 'zero_tokens', lines that are no JSON as 'skipped_lines';
    what is wrong in foreign logs is not counted.
    depth is how many sub-agents deep a log lies, top the log that all began with. Sessions are folded by grouped
    sums, so that one large log is not one task. Null paths or lines are left out; of two files rows for a path the later counts.
    """
    clock = F.lit(now).cast("timestamp_ntz")
    everything = written(records(lines.where("path is not null and line is not null")), "records")
    r = everything.where("not broken")
    told_at = lambda c: F.when(~F.col("broken") & c, F.col("line"))
    placed = F.col("kind").isin(METADATA, BRANCH) & F.col("root").isNotNull()
    facts = everything.groupBy("path").agg(F.min_by("stream", told_at(F.col("stream").isNotNull())).alias("session_id"), F.min_by("root", told_at(placed)).alias("root"), F.max(told_at(F.col("id").isNotNull())).alias("last"))
    facts = written(facts.join(files.where("path is not null").groupBy("path").agg(F.max("modified_at").alias("modified_at")), "path", "full"), "sessions")
    named = r.where((F.col("kind") == BRANCH) & F.col("command").isNotNull()).groupBy("path", F.col("command").alias("run")).agg(F.max_by(F.struct(F.coalesce("branch", F.lit("")).alias("name")), "line").alias("b")).select("path", "run", F.col("b.name").alias("branch"))
    ended = r.where((F.col("kind") == RUN) & (F.col("event") == TERMINAL) & F.col("run").isNotNull()).groupBy("path", "run").agg(F.max("line").alias("ended"))
    runs = named.join(ended, ["path", "run"], "full")
    link = r.where((F.col("kind") == RUN) & (F.col("event") == LINKED) & F.col("child").isNotNull()).withColumn("of", F.coalesce("parent_run", "run")).where("of is not null")
    links = link.groupBy(F.col("path").alias("parent"), "child").agg(F.min("of").alias("linked"), F.max("of").alias("other"))

    review = F.col("kind") == APPROVAL
    billed = r.where(((F.col("kind") == RUN) & (F.col("event") == COMPLETED)) | (review & (F.col("event") == REVIEWED)))
    tokens, wrong = _usage(review)
    ms = F.col("completed").try_cast("long")
    late = review & F.col("completed").isNotNull() & ms.isNull()
    ts = F.when(F.col("at") > 0, F.timestamp_micros("at")).when(review & (ms > 0), F.timestamp_millis(ms)).cast("timestamp_ntz")
    b = billed.select("path", "line", F.col("id").alias("record_id"), "run", F.when(review, F.lit("review")).otherwise(F.lit("agent")).alias("kind"), _some(F.when(review, F.get_json_object("model", "$.model_id")).otherwise(F.col("model"))).alias("model"), tokens.alias("t"), (wrong | late).alias("undecodable"), ts.alias("ts"))
    none = (F.col("t.input_tok") == 0) & (F.col("t.cache_read") == 0) & (F.col("t.output_tok") == 0)
    own = F.when(F.col("t").isNull(), F.lit(BAD_USAGE)).when(none, F.lit("zero_tokens")).when(F.col("model").isNull(), F.lit(NO_MODEL)).when(F.col("ts").isNull(), F.lit(NO_TIME))
    b = b.withColumn("own", own).withColumn("first", F.when(F.col("undecodable"), F.lit(UNDECODABLE)).when(F.col("record_id").isNull(), F.lit(NO_ID)))
    b = written(b, "billed")
    good = b.where("first is null and own is null").groupBy("path", "record_id").agg(F.min("line").alias("good"))
    told = b.join(good, ["path", "record_id"], "left").withColumn("reason", F.coalesce("first", F.when(F.col("line") > F.col("good"), F.lit(DUPLICATE)), "own"))
    told = written(told.select("path", "line", "record_id", "run", "kind", "model", "t.*", "ts", "reason"), "told")

    def half(name: str, of: DataFrame) -> DataFrame:
        return of.select(*(F.col(c).alias(f"{name}_{c}") for c in of.columns))

    parent = F.regexp_extract("path", CHILD, 1)
    is_child = F.col("path").rlike(CHILD)
    f = facts.withColumn("parent", F.when(is_child, F.concat(parent, F.lit("/session.jsonl")))).withColumn("child", F.when(is_child, F.regexp_extract("path", CHILD, 2)))
    f = f.join(half("p", facts.withColumn("log", F.col("path"))), F.col("parent") == F.col("p_path"), "left").drop("p_path").join(links, ["parent", "child"], "left")
    f = f.withColumn("scope_root", F.when(F.col("parent").isNull(), F.col("root")).when(~F.col("parent").rlike(CHILD), F.col("p_root")))
    f = f.withColumn("quiet_at", F.when(F.col("parent").isNull(), F.col("modified_at")).otherwise(F.greatest("modified_at", "p_modified_at")))
    scoped = scopes.scoped(f.where("scope_root is not null").select(F.col("scope_root").alias("cwd")), targets, roots).where("scope != 'foreign'").select(F.col("cwd").alias("scope_root"), "target")
    why = F.when(F.col("parent").isNotNull() & F.col("p_log").isNull(), F.lit(NO_PARENT)).when(F.col("parent").isNotNull() & F.col("scope_root").isNotNull(), F.when(F.col("linked").isNull(), F.lit(NO_LINK)).when(F.col("linked") != F.col("other"), F.lit(AMBIGUOUS)))
    quiet = F.coalesce(F.col("quiet_at") <= clock - F.expr(f"INTERVAL {grace}"), F.lit(True))
    f = f.join(scoped, "scope_root", "left").withColumn("why", why)
    state = F.when(F.col("scope_root").isNotNull() & F.col("target").isNull(), F.lit("foreign")).when(F.col("why").isNotNull() & ~quiet, F.lit("unlinked_held")).when(F.col("why").isNotNull(), F.lit("unlinked_excluded")).when(F.col("target").isNull(), F.lit("no_workspace_root"))
    f = f.select("path", "session_id", "target", "why", "linked", state.alias("state"), quiet.alias("quiet"), F.coalesce("parent", "path").alias("runs_of"), F.when(F.col("parent").isNull(), F.col("last")).otherwise(F.col("p_last")).alias("last"), F.col("parent").isNotNull().alias("sub"))

    c = told.where("reason is null").drop("reason").join(f, "path").withColumn("run", F.when(F.col("sub"), F.col("linked")).otherwise(F.col("run")))
    c = c.join(runs.withColumnRenamed("path", "runs_of"), ["runs_of", "run"], "left")
    waits = F.col("branch").isNull() & ~F.coalesce(F.col("last") > F.col("ended"), F.lit(False)) & ~F.col("quiet")
    early = F.col("ts") < F.lit(since).cast("timestamp_ntz") if since else F.lit(False)
    fate = F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("ts") > clock + F.expr(f"INTERVAL {skew}"), F.lit("refused")).when(early, F.lit("earlier")).when(waits, F.lit("held")).otherwise(F.lit("emitted"))
    c = c.withColumn("disposition", fate)
    reason = F.when(F.col("disposition") == "refused", F.lit(FUTURE)).when(F.col("disposition").startswith("unlinked"), F.col("why"))
    depth = F.size(F.split("path", "/subagent/")) - 1
    top = F.when(depth > 0, F.concat(F.split("path", "/subagent/")[0], F.lit("/session.jsonl"))).otherwise(F.col("path"))
    branch = F.when(F.col("disposition") == "emitted", F.coalesce("branch", F.lit("")))
    calls = c.select("path", "record_id", "session_id", "kind", "model", "input_tok", "cache_read", "output_tok", "ts", "run", branch.alias("branch"), F.when(F.col("disposition") == "emitted", F.col("target")).alias("target"), "disposition", reason.alias("reason"), depth.alias("depth"), top.alias("top"))
    refused = told.where("reason is not null").select("path", "reason").unionByName(everything.where("broken").select("path", F.lit("skipped_lines").alias("reason"))).groupBy("path", "reason").agg(F.count("*").alias("n"))
    refused = refused.join(f.where("state = 'foreign'").select("path"), "path", "left_anti")
    return Sessions(calls, refused)

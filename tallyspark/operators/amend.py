"""Changes of stored rows from one plan: the new table, the rows as they were, and what stands against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.scalars import canonical_repo
from tallyspark.sources.shared import written

UNQUALIFIED = "unqualified"
#: A mapping of so many sessions, or so many overrides, at most is copied to all tasks.
FEW = 100_000


class Refused(Exception):
    """A plan that isn't carried out at all; the rows say why."""

    def __init__(self, why: str, rows: DataFrame) -> None:
        super().__init__(why)
        self.rows = rows


@dataclass(frozen=True)
class Plan:
    """All rows with a column verdict: change, keep, conflict or unresolved; and the columns that a change gives them."""

    judged: DataFrame
    changes: dict[str, str]  # column -> column of judged with its new value
    columns: tuple[str, ...]

    def table(self) -> DataFrame:
        """Every row, changed or not."""
        new = {c: F.when(F.col("verdict") == "change", F.col(to)).otherwise(F.col(c)) for c, to in self.changes.items()}
        return self.judged.select(*(new[c].alias(c) if c in new else c for c in self.columns))

    def audit(self) -> DataFrame:
        """The changed rows as they were, with what they become as new_<column>, why and by whom."""
        return self.judged.where("verdict = 'change'").select(*self.columns, *(F.col(to).alias(f"new_{c}") for c, to in self.changes.items()), "actor", "reason")

    def unchanged(self) -> DataFrame:
        return self.judged.where("verdict != 'change'").select(*self.columns)

    def counts(self) -> DataFrame:
        return self.judged.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("cost_micro").alias("cost_micro"))

    def committed(self) -> tuple[DataFrame, DataFrame]:
        """The new table and the audit rows, written; refused as a whole where any row conflicts."""
        against = self.judged.where("verdict = 'conflict'")
        if not against.isEmpty():
            raise Refused("rows conflict with the plan", against)
        return written(self.table(), "amended"), written(self.audit(), "audit")


def planned(rows: DataFrame, name: str, changes: dict[str, str], columns: list[str]) -> Plan:
    return Plan(written(rows, name), changes, tuple(columns))


def repair_repositories(events: DataFrame, mapping: DataFrame, developer: str, actor: str, reason: str) -> Plan:
    """X11: a developer's rows without a repository take that of their session. mapping: session_id, repo.

    Repositories are canonical; a mapping with a repository that isn't one, or with two for a session, is refused, as is an
    empty one. Rows that have a repository are never changed: where the mapping says another they are conflicts.
    Rows without a repository or a session in the mapping are unresolved. Others' rows are kept as they are.
    """
    named = mapping.select("session_id", canonical_repo(F.col("repo")).alias("mapped"), F.col("repo").alias("given"))
    # the mapping may come from the events themselves: it is made once, and all is asked of what was made
    kinds = F.countDistinct("mapped").alias("n"), F.count(F.when(F.col("mapped").isNull(), 1)).alias("odd"), F.min(F.when(F.col("mapped").isNull(), F.coalesce("given", F.lit("")))).alias("given")
    one = written(named.groupBy("session_id").agg(F.min("mapped").alias("mapped"), *kinds), "mapping")
    sessions, odd, two = one.agg(F.count("*"), F.count(F.when(F.col("odd") > 0, 1)), F.count(F.when(F.col("n") > 1, 1))).first()
    if odd:
        raise Refused("the mapping names what isn't a repository", one.where("odd > 0").select("session_id", "given"))
    if two:
        raise Refused("the mapping names two repositories for a session", one.where("n > 1"))
    if not sessions:
        raise Refused("the mapping is empty", one)
    one = one.select("session_id", "mapped")
    mine = F.col("developer") == developer
    joined = events.join(F.broadcast(one) if sessions <= FEW else one.hint("merge"), "session_id", "left")
    real = F.coalesce(F.col("repo"), F.lit("")).isin("", UNQUALIFIED)
    verdict = F.when(~F.coalesce(mine, F.lit(False)), "keep").when(~real, F.when(F.col("mapped") != F.col("repo"), "conflict").otherwise("keep")).when(F.col("mapped").isNull(), "unresolved").otherwise("change")
    return planned(joined.withColumns({"verdict": verdict, "actor": F.lit(actor), "reason": F.lit(reason)}), "repair", {"repo": "mapped"}, events.columns)


def override_costs(events: DataFrame, overrides: DataFrame, polled: list[str]) -> Plan:
    """Costs set by hand. overrides: id, cost_micro, actor, reason, billed_to (null or 'other'), place (order of arrival).

    The last override of a row counts. An override without actor or reason, below zero, or for no row is refused as a whole with
    all others. A row of a provider that is polled is a conflict, unless it is said to be billed to another, since the poller counts it too.
    A row whose cost is already the same is kept, and no audit row is made for it.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    overrides = written(overrides.select("id", "cost_micro", "actor", "reason", "billed_to", "place"), "overrides")
    bad = overrides.where(blank(F.col("actor")) | blank(F.col("reason")) | ~F.coalesce(F.col("cost_micro") >= 0, F.lit(False)) | ~F.coalesce(F.col("billed_to"), F.lit("other")).isin("other"))
    if not bad.isEmpty():
        raise Refused("an override without actor, reason or a sound cost", bad)
    last = overrides.groupBy("id").agg(F.max_by(F.struct(F.col("cost_micro").alias("new_cost"), "actor", "reason", "billed_to"), "place").alias("o")).select("id", "o.*")
    joined = events.join(F.broadcast(last) if overrides.count() <= FEW else last.hint("merge"), "id", "left")
    both = F.col("billed_to").isNull() & F.col("provider").isin(*polled) if polled else F.lit(False)
    verdict = F.when(F.col("new_cost").isNull(), "keep").when(F.coalesce(both, F.lit(False)), "conflict").when(F.col("new_cost") == F.col("cost_micro"), "keep").otherwise("change")
    plan = planned(joined.withColumn("verdict", verdict), "override", {"cost_micro": "new_cost"}, events.columns)
    # rows that an override was for are read from the plan, so that the events are joined once
    if not (lost := last.join(plan.judged.where("new_cost is not null").select("id"), "id", "left_anti")).isEmpty():
        raise Refused("an override for no row", lost)
    return plan

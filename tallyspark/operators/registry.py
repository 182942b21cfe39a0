"""Price tables by what they hold: one live identity for a version, bodies that are never changed, and rows at the table they were priced with."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.manifest import table_hash
from tallyspark.operators.pricing import KINDS, priced
from tallyspark.sources.log import NumberedLog

#: Sources whose rows are priced here, by tokens.
FIRST_PARTY = ("jsonl", "proxy", "codex-rollout", "opencode", "muse")
SCHEME = "prices-1"


class Collision(Exception):
    """A version is recorded with other rates."""


class PriceRegistry(NumberedLog):
    """Entries are tables (version, hash, body) and versions forgotten (version, by, why)."""

    def live(self, version: int) -> dict | None:
        found = None
        for e in self.entries:
            if e["version"] == version:
                found = e if e["kind"] == "table" else None
        return found

    def identities(self, version: int) -> set[str]:
        """All that a version has ever been, forgotten or not."""
        return {e["hash"] for e in self.entries if e["kind"] == "table" and e["version"] == version}

    def record(self, version: int, prices: DataFrame, now: datetime, source: str = "") -> dict:
        """The live entry of a version, put there if there is none. Other rates under the same version are refused; a hash of
        another scheme can't be compared and is left as it is."""
        columns = [c.split()[0] for c in KINDS.split(", ")]
        mine, body = table_hash(prices, columns[0], columns[1:], SCHEME), None
        while True:
            self.read()
            if there := self.live(version):
                if there["hash"] != mine and there["hash"].split(":")[0] == mine.split(":")[0]:
                    raise Collision(f"version {version} is recorded as {there['hash']} on {there['at']}, not as {mine}; forget it, or give the table another version")
                return there
            if body is None:
                body = uuid.uuid4().hex
                prices.select(*columns).write.parquet(f"{self.root}/bodies/{body}")
            entry = {"kind": "table", "version": version, "hash": mine, "body": body, "source": source, "at": now.isoformat()}
            if self.put(entry):
                return entry

    def forget(self, version: int, by: str, why: str, now: datetime) -> None:
        """A version's identity is no longer live; its entry and its body stay."""
        if not by.strip() or not why.strip():
            raise ValueError("forgetting needs a name and a reason")
        while True:
            self.read()
            if not self.live(version):
                raise ValueError(f"version {version} isn't live")
            if self.put({"kind": "forgotten", "version": version, "by": by, "why": why, "at": now.isoformat()}):
                return

    def table(self, version: int) -> DataFrame | None:
        """A version's rates, if they are live."""
        self.read()
        there = self.live(version)
        return self.spark.read.schema(KINDS).parquet(f"{self.root}/bodies/{there['body']}") if there else None


def original_basis(events: DataFrame, registry: PriceRegistry, versions: list[int], overridden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of versions that have no snapshot of their rates, with the cost, rates' hash and basis of the table they were first priced with; and,
    for each version, why it was left out, if it was.

    Only rows of first-party sources count, none that are overridden (id) or priced by their caller, and none that cost something without a token. A
    version is left out unless it has had one identity in all time. A model that its table doesn't know by name, or knows in another billing mode, keeps what it has: no guess is made.
    """
    registry.read()
    out, left = None, []
    mode = F.col("billing_mode") if "billing_mode" in events.columns else F.lit(None).cast("string")
    events = events.withColumn("mode", mode).drop("billing_mode")
    tokens = F.col("input_tok") + F.col("output_tok") + F.col("cache_read") + F.col("cache_write_5m") + F.col("cache_write_1h")
    open_ = events.where(F.col("rate_snapshot").isNull() & F.col("source").isin(*FIRST_PARTY) & (F.coalesce("pricing_basis", F.lit("")) != "caller_authoritative") & ~((F.col("cost_micro") != 0) & (tokens == 0)))
    open_ = open_.join(overridden.select("id"), "id", "left_anti")
    for v in versions:
        known = registry.identities(v)
        if len(known) != 1 or registry.live(v) is None:
            left.append((v, "basis-unavailable", len(known)))
            continue
        rows = priced(open_.where(F.col("price_version") == v), registry.table(v))
        same = F.col("guess").isNull() & F.coalesce(F.col("mode") == F.col("billing_mode"), F.lit(True))
        rows = rows.where(same).select("id", F.lit(v).alias("price_version"), F.col("cost_micro"), F.col("priced_micro").alias("original_micro"), F.lit(next(iter(known))).alias("rate_snapshot"), F.lit("token_derived").alias("pricing_basis"))
        out = rows if out is None else out.unionByName(rows)
    spark = events.sparkSession
    shape = "id long, price_version int, cost_micro long, original_micro long, rate_snapshot string, pricing_basis string"
    return (out if out is not None else spark.createDataFrame([], shape)), spark.createDataFrame(left, "price_version int, why string, identities int")

"""Months that are sealed once: a commit protocol over Parquet in a shared folder.

A folder holds ``bodies/body=<uuid>/period=<month>/``, which writers stage as they like, and ``log/<n>.json``, one entry after
another: seals, gaps, and epochs (an erasure, or another change of what earlier figures may show). An entry exists once its file
has been put under the next number, which fails where that number is taken; so the log is one order for all writers, and a
seal is valid if everything that it was judged by still holds at the entry before it. A writer that loses reads the winner's.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.ledgers import digests
from tallyspark.sources.log import NumberedLog

#: Reasons that a month may never be sealed for, and how often figures are made anew after an erasure.
GAPS = ("refold_mismatch", "floor_moved", "not_next", "overlap", "not_sealable", "internal", "source_behind")
ATTEMPTS = 3
LONGEST_REASON = 500
BLANK = "ᅟᅠㅤﾠ⠀"


class SealRefused(Exception):
    """code says why: erase_raced, clock_behind, not_next, sealed, gapped, invalid."""

    def __init__(self, code: str, what: str) -> None:
        super().__init__(f"{code}: {what}")
        self.code = code


def month_after(period: str) -> str:
    year, month = map(int, period.split("-"))
    return f"{year + month // 12:04d}-{month % 12 + 1:02d}"


def starts(period: str) -> datetime:
    return datetime.strptime(period, "%Y-%m")


def ends(period: str) -> datetime:
    return starts(month_after(period))


def months(first: str, last: str) -> list[str]:
    out = []
    while first <= last:
        out.append(first)
        first = month_after(first)
    return out


def first_full(horizon: datetime) -> str:
    """The first month that begins at or after a time."""
    period = f"{horizon:%Y-%m}"
    return period if starts(period) >= horizon else month_after(period)


def last_closed(now: datetime, grace: timedelta) -> str:
    """The last month whose end and grace are past."""
    return f"{(now - grace).replace(day=1) - timedelta(days=1):%Y-%m}"


class SealLog(NumberedLog):
    """Entries are few: months, and erasures."""

    def of(self, *kinds: str) -> dict[str, dict]:
        return {e["period"]: e for e in self.entries if e["kind"] in kinds}

    @property
    def epoch(self) -> int:
        return sum(e["kind"] == "epoch" for e in self.entries)

    def erased(self, why: str, now: datetime) -> None:
        """An erasure, an alias or an exclusion has changed what may be shown: figures made before it can't be sealed any more."""
        self.read()
        while not self.put({"kind": "epoch", "why": why, "at": now.isoformat()}):
            self.read()

    def next(self, floor: str | None = None) -> str | None:
        """The only month that may be sealed or left out now: after the last one, or else the floor."""
        taken = self.of("seal", "gap")
        return month_after(max(taken)) if taken else floor

    def check_clock(self, now: datetime) -> None:
        newest = max((e["at"] for e in self.entries if e["kind"] in ("seal", "gap")), default="")
        if now.isoformat() < newest:
            raise SealRefused("clock_behind", f"now {now.isoformat()}, but an entry was made at {newest}")

    def gap(self, period: str, category: str, reason: str, now: datetime) -> dict:
        """Record a month as never to be sealed. It must have ended, and be the next one after a seal or a gap."""
        visible = any(not c.isspace() and unicodedata.category(c) != "Mn" and c not in BLANK for c in reason)
        graphic = all(c == " " or unicodedata.category(c)[0] in "LMNPS" or unicodedata.category(c) == "Zs" for c in reason)
        if category not in GAPS or not visible or not graphic or len(reason) > LONGEST_REASON or ends(period) > now:
            raise SealRefused("invalid", f"{period} {category!r} {reason!r}")
        while True:
            self.read()
            if period in self.of("seal"):
                raise SealRefused("sealed", period)
            if period in self.of("gap"):
                raise SealRefused("gapped", period)
            if self.next() != period:
                raise SealRefused("not_next", f"{period}, the next is {self.next()}")
            self.check_clock(now)
            entry = {"kind": "gap", "period": period, "category": category, "reason": reason, "at": now.isoformat()}
            if self.put(entry):
                return entry


def certified(coverage: DataFrame, periods: list[str], lost: DataFrame | None = None) -> list[str]:
    """Of periods in order, those from the first on that every source certifies: one run (source, covered_from, settled_through) without
    a gap holds the whole month, and no spend was lost (source, lost_from, lost_through) in it.

    A source is copied once for each month that is asked about; runs and losses meet their own source.
    """
    if not periods:
        return []
    spark = coverage.sparkSession
    span = spark.createDataFrame([(p, starts(p), ends(p)) for p in periods], "period string, starts timestamp_ntz, ends timestamp_ntz")
    asked = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(starts(p).isoformat()).cast("timestamp_ntz").alias("starts"), F.lit(ends(p).isoformat()).cast("timestamp_ntz").alias("ends")) for p in periods))
    month = coverage.select("source").distinct().withColumn("m", F.explode(asked)).select("source", "m.*")
    runs = coverage.select("source", "covered_from", "settled_through")
    behind = month.join(runs, (month["source"] == runs["source"]) & (runs["covered_from"] <= month["starts"]) & (runs["settled_through"] >= month["ends"]), "left_anti")
    if lost is not None:
        hit = month.join(lost, (month["source"] == lost["source"]) & (lost["lost_from"] < month["ends"]) & (lost["lost_through"] > month["starts"]), "left_semi")
        behind = behind.unionByName(hit)
    waiting = {r.period for r in behind.select("period").distinct().join(F.broadcast(span.select("period")), "period").collect()}
    out = []
    for p in periods:
        if p in waiting:
            break
        out.append(p)
    return out


def seal_through(log: SealLog, compute: Callable[[list[str]], DataFrame], ready: Callable[[list[str]], list[str]], horizon: datetime, now: datetime, grace: timedelta = timedelta(days=14), settings: dict | None = None) -> list[str]:
    """Seal every month that may be, in order; the periods that this call has sealed.

    compute gives the rows of some months with a column period; it is asked for all of them at once, and they are staged by
    one job. A month may be sealed if its grace (a day at least) is past, ready lets it through, and all before it are sealed or gaps.
    The floor, the first full month since the horizon, is pinned by the first seal. Where an erasure comes between compute and
    a seal, nothing of what was computed is used: figures are made anew, some times over.
    """
    if grace < timedelta(days=1):
        raise ValueError("the grace is a day at least")
    mine: list[str] = []
    for _ in range(ATTEMPTS):
        log.read()
        log.check_clock(now)
        pinned = next((e["floor"] for e in log.entries if e["kind"] == "seal"), first_full(horizon))
        first = log.next(pinned)
        pending = ready(months(first, last_closed(now, grace)))
        if not pending:
            return mine
        epoch, body = log.epoch, uuid.uuid4().hex
        compute(pending).write.partitionBy("period").parquet(f"{log.root}/bodies/body={body}")
        digest = body_digests(log, body, pending)
        for period in pending:
            taken = None
            while log.epoch == epoch and not (taken := log.of("seal", "gap").get(period)):
                if log.next(pinned) != period:
                    raise SealRefused("not_next", f"{period}, the next is {log.next(pinned)}")
                log.check_clock(now)
                entry = {"kind": "seal", "period": period, "body": body, **digest[period], "floor": pinned, "epoch": epoch, "grace_days": grace / timedelta(days=1), "settings": settings or {}, "at": now.isoformat()}
                if log.put(entry):
                    mine.append(period)
                    break
                log.read()
            if not taken and log.epoch != epoch:
                break
        else:
            return mine
    raise SealRefused("erase_raced", f"an erasure came between the figures and the seal {ATTEMPTS} times")


def columns_of(rows: DataFrame) -> list[str]:
    return sorted(c for c in rows.columns if c not in ("body", "period"))


def body_digests(log: SealLog, body: str, periods: list[str]) -> dict[str, dict]:
    """By period, rows and a digest of a staged body, as it was written; a month without rows has both."""
    at = f"{log.root}/bodies/body={body}"
    rows = log.spark.read.option("basePath", at).parquet(at) if _any_rows(log, at) else None
    found = {} if rows is None else {str(r.period): r.asDict() for r in digests(rows.withColumn("period", F.col("period").cast("string")), ["period"], columns_of(rows)).collect()}
    return {p: {"rows": found.get(p, {}).get("n", 0), "digest": "-".join(str(found.get(p, {}).get(f"h{k}", 0)) for k in range(4))} for p in periods}


def _any_rows(log: SealLog, at: str) -> bool:
    return any("period=" in s.getPath().getName() for s in log._fs.listStatus(log._jvm.org.apache.hadoop.fs.Path(at)))


def sealed(log: SealLog) -> DataFrame | None:
    """The rows of all sealed months, with period, as their seals have them; None before there are any."""
    at = f"{log.root}/bodies"
    paths = [f"{at}/body={e['body']}/period={e['period']}" for e in log.of("seal").values() if e["rows"]]
    if not paths:
        return None
    one = log.spark.read.parquet(paths[0]).schema.add("body", "string").add("period", "string")
    return log.spark.read.schema(one).option("basePath", at).parquet(*paths).drop("body")


def altered(log: SealLog) -> list[str]:
    """Sealed months whose bodies are no longer what was sealed."""
    rows, want = sealed(log), log.of("seal")
    found = {} if rows is None else {r.period: r.asDict() for r in digests(rows, ["period"], columns_of(rows)).collect()}
    again = {p: "-".join(str(found.get(p, {}).get(f"h{k}", 0)) for k in range(4)) for p in want}
    return sorted(p for p, e in want.items() if again[p] != e["digest"])


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)

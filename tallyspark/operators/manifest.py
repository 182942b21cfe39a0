"""What a report was made from, pinned; and what of it is different when the report is made again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.ledgers import digests

SCHEME = "tally-manifest-1"


@dataclass(frozen=True)
class Population:
    """Rows that a report reads: ids grow as rows arrive; ts is what a window cuts, None for rows that no window cuts."""

    rows: DataFrame
    columns: tuple[str, ...]
    ts: str | None = "ts"
    id: str = "id"
    days_before: int = 0  # rows that a report reads from ahead of its window


@dataclass(frozen=True)
class Difference:
    """kind: pin (a setting), changed (rows that were there), late (rows that came since), report (the result)."""

    dimension: str
    kind: str
    pinned: str
    now: str


def table_hash(rows: DataFrame, key: str, columns: list[str], scheme: str = "table-1") -> str:
    """The identity of a small table, as a price table is, by the bytes of its rows in the order of their keys: each field is led by
    its length, so that no two tables have the same bytes; minus zero counts as zero."""
    plain = lambda c: F.coalesce((F.col(c) + 0.0 if dict(rows.dtypes)[c] in ("double", "float") else F.col(c)).cast("string"), F.lit(""))
    framed = F.concat(*(F.concat(F.octet_length(plain(c)).cast("string"), F.lit(":"), plain(c)) for c in [key, *columns]))
    line = rows.select(F.col(key).alias("key"), framed.alias("framed"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "framed"))), lambda x: x["framed"]), "")
    return f"{scheme}:{line.agg(F.sha2(body, 256)).first()[0]}"


def _within(p: Population, since: str, until: str | None) -> DataFrame:
    if p.ts is None:
        return p.rows
    at, from_ = F.col(p.ts).cast("timestamp_ntz"), F.lit(since).cast("timestamp_ntz") - F.expr(f"INTERVAL {p.days_before} DAYS")
    return p.rows.where((at >= from_) & (at < F.lit(until).cast("timestamp_ntz") if until else F.lit(True)))


def _digest(rows: DataFrame, columns: tuple[str, ...]) -> dict:
    got = digests(rows.select(F.lit(1).alias("_all"), *(F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in columns)), ["_all"], list(columns)).first()
    return {"n": 0, "digest": ""} if got is None else {"n": got.n, "digest": f"{got.h0}-{got.h1}-{got.h2}-{got.h3}"}


def manifest(populations: dict[str, Population], pins: dict[str, str], since: str, until: str | None, report: DataFrame) -> dict:
    """The window, the settings (hash of the price table, rubric, level, k, ...), and of each population its rows in the window:
    how many, their digest in any order, and the largest id, up to which it had arrived; and the digest of the report itself."""
    out = {"schema": SCHEME, "since": since, "until": until, "pins": dict(sorted(pins.items())), "populations": {}}
    for name, p in sorted(populations.items()):
        rows = _within(p, since, until)
        out["populations"][name] = {**_digest(rows, p.columns), "through": rows.agg(F.max(p.id)).first()[0]}
    out["report"] = _digest(report, tuple(sorted(report.columns)))
    return out


def verify(pinned: dict, populations: dict[str, Population], pins: dict[str, str], report: DataFrame) -> list[Difference]:
    """What is different now, the report having been made again over the pinned window; nothing means that it is reproduced.

    Of each population, rows up to the pinned id are held against their digest, and rows beyond it are counted: a report
    that differs because rows came late is told from one whose rows were changed or taken away.
    """
    if pinned.get("schema") != SCHEME:
        return [Difference("schema", "pin", str(pinned.get("schema")), SCHEME)]
    if missing := (pinned["populations"].keys() ^ populations.keys()):
        raise ValueError(f"not the populations of the manifest: {sorted(missing)}")
    out = [Difference(k, "pin", str(pinned["pins"].get(k)), str(pins.get(k))) for k in sorted(pinned["pins"].keys() | pins.keys()) if pinned["pins"].get(k) != pins.get(k)]
    for name, p in sorted(populations.items()):
        was, rows = pinned["populations"][name], _within(p, pinned["since"], pinned["until"])
        late = F.col(p.id) > was["through"] if was["through"] is not None else F.lit(True)
        now = _digest(rows.where(~late), p.columns)
        if now != {"n": was["n"], "digest": was["digest"]}:
            out.append(Difference(name, "changed", f"{was['n']} rows {was['digest']}", f"{now['n']} rows {now['digest']}"))
        if more := rows.where(late).count():
            out.append(Difference(name, "late", f"through {was['through']}", f"{more} rows since"))
    again = _digest(report, tuple(sorted(report.columns)))
    if again != pinned["report"]:
        out.append(Difference("report", "report", f"{pinned['report']['n']} rows {pinned['report']['digest']}", f"{again['n']} rows {again['digest']}"))
    return out

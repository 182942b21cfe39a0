"""Queries of sealed months."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tallyspark.operators import seals
from tallyspark.plans.registry import query
from tallyspark.sources import bridge as B
from tallyspark.sources.shared import shared_dir, written

NOW = "1998-09-20"
#: A source's passes cover its months but one, which proxy never fetched.
LOST = "1995-07"


def sealed_log(spark, sf):
    """The months of the token events, sealed by repository up to the one that a source never fetched, which is left out, and beyond."""
    log = seals.SealLog(spark, f"{shared_dir(spark)}/seals-{uuid.uuid4().hex}")
    e = B.token_events(spark, sf).select("repo", "source", "cost_micro", "ts", F.date_format("ts", "yyyy-MM").alias("period"))
    # what is asked of the events, again for each run of seals, is asked of their sums by month, repository and source
    e = written(e.groupBy("period", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), "repo", "source").agg(F.min("ts").alias("ts"), F.sum("cost_micro").alias("cost_micro"), F.count("*").alias("n")), "months")
    first = e.agg(F.min("ts")).first()[0]
    if first is None:
        return log
    seen = e.where(~((F.col("source") == "proxy") & (F.col("period") == LOST))).select("source", F.col("month").alias("covered_from")).distinct()
    runs = seen.withColumn("settled_through", F.col("covered_from") + F.expr("INTERVAL 1 MONTH"))
    # every month is a run of its own here: months certify one by one
    now = datetime.fromisoformat(NOW)

    def compute(periods):
        return e.where(F.col("period").isin(periods)).groupBy("period", "repo").agg(F.sum("cost_micro").alias("cost_micro"), F.sum("n").alias("n"))

    def ready(periods):
        return seals.certified(runs, periods)

    seals.seal_through(log, compute, ready, first, now)
    if log.next() == LOST:
        log.gap(LOST, "source_behind", "proxy was never fetched", now)
        seals.seal_through(log, compute, ready, first, now)
    return log


MONTHS = f"""mo AS (SELECT strftime(ts, '%Y-%m') AS period, count(DISTINCT source) FILTER (source <> 'proxy' OR strftime(ts, '%Y-%m') <> '{LOST}') AS n FROM token_events GROUP BY 1),
fl AS (SELECT strftime(CASE WHEN min(ts) = date_trunc('month', min(ts)) THEN min(ts) ELSE date_trunc('month', min(ts)) + INTERVAL 1 MONTH END, '%Y-%m') AS floor, count(DISTINCT source) AS k FROM token_events),
al AS (SELECT strftime(x, '%Y-%m') AS period FROM range(TIMESTAMP '1990-01-01', TIMESTAMP '{NOW}' - INTERVAL 14 DAYS - INTERVAL 1 MONTH, INTERVAL 1 MONTH) g(x)),
st AS (SELECT al.period, CASE WHEN coalesce(n, 0) = k THEN 'seal' WHEN al.period = '{LOST}' THEN 'gap' END AS kind FROM al JOIN fl ON al.period >= floor LEFT JOIN mo USING (period)),
lg AS (SELECT * FROM st WHERE period < coalesce((SELECT min(period) FROM st WHERE kind IS NULL), '9999'))"""


@query("T10_sealed_months", f", {MONTHS} SELECT period, repo, sum(cost_micro)::BIGINT AS cost_micro, count(*) AS n FROM token_events JOIN lg ON lg.period = strftime(ts, '%Y-%m') AND kind = 'seal' GROUP BY 1, 2")
def _(spark, sf):
    rows = seals.sealed(sealed_log(spark, sf))
    return spark.createDataFrame([], "period string, repo string, cost_micro long, n long") if rows is None else rows.select("period", "repo", "cost_micro", "n")


@query("T11_seal_log", f", {MONTHS} SELECT period, kind, (SELECT floor FROM fl) AS floor FROM lg")
def _(spark, sf):
    log = sealed_log(spark, sf)
    floor = next((e["floor"] for e in log.entries if e["kind"] == "seal"), None)
    return spark.createDataFrame([(e["period"], e["kind"], floor) for e in log.of("seal", "gap").values()], "period string, kind string, floor string")

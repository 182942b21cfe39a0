"""Deliveries of a code host, and the outcomes they give."""

from __future__ import annotations

import gzip
import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.scalars import effort_weight, size_weight, work_type
from tallyspark.functions.text import issue_of_body, issue_of_branch

PULL = """action STRING, pull_request STRUCT<number INT, title STRING, body STRING, merged BOOLEAN, merged_at TIMESTAMP, created_at TIMESTAMP, merge_commit_sha STRING,
 head STRUCT<ref STRING>, user STRUCT<login STRING, type STRING>, labels ARRAY<STRUCT<name STRING>>, additions INT, deletions INT, changed_files INT>, repository STRUCT<full_name STRING>"""


@F.pandas_udf(T.BinaryType())
def gunzipped(body: pd.Series) -> pd.Series:
    """A stored body; null where it isn't gzip."""

    def one(data):
        try:
            return gzip.decompress(bytes(data))
        except (OSError, EOFError, TypeError):
            return None

    return body.map(one)


def signed(rows: DataFrame, secret: str, body: str = "body", signature: str = "signature") -> DataFrame:
    """Rows whose signature is the HMAC-SHA-256 of their body. Compared in constant time."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            good = [hmac.compare_digest(f"sha256={hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest()}", s or "") for b, s in zip(f[body], f[signature], strict=True)]
            yield f[good]

    return rows.mapInPandas(check, rows.schema)


def pull_outcomes(deliveries: DataFrame, body: str = "body") -> DataFrame:
    """Merged pull requests as outcomes, one per merge commit, the first delivery first.

    The weight is the first known size label's, else that of the change's size; the issue the branch's, else the body's.
    """
    p = deliveries.dropDuplicates(["delivery_id"]).select("delivery_id", F.from_json(body, PULL).alias("d")).where("d.action = 'closed' and d.pull_request.merged")
    r, names = "d.pull_request", F.coalesce(F.transform("d.pull_request.labels", lambda x: x["name"]), F.array().cast("array<string>"))
    own = size_weight(names)
    effort = effort_weight(*(F.coalesce(f"{r}.{c}", F.lit(0)) for c in ("additions", "deletions", "changed_files")))
    out = p.select(
        "delivery_id", F.lower("d.repository.full_name").alias("repo"), F.col(f"{r}.number").alias("pr_number"), F.col(f"{r}.user.login").alias("developer"), F.col(f"{r}.user.type").alias("author_type"), F.col(f"{r}.merge_commit_sha").alias("merge_sha"),
        F.coalesce(issue_of_branch(F.col(f"{r}.head.ref")), issue_of_body(F.col(f"{r}.body"))).alias("issue_id"), F.when(own != 0, own).otherwise(effort).alias("weight"), F.when(own != 0, F.lit("label")).otherwise(F.lit("heuristic")).alias("weight_source"), work_type(names).alias("work_type"), F.col(f"{r}.merged_at").alias("merged_at"),
    )
    first = out.groupBy("merge_sha").agg(F.min("delivery_id").alias("delivery_id"))
    return out.join(first, ["merge_sha", "delivery_id"])

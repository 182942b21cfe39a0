"""Queries of references in branches, descriptions and declarations, over texts made from every order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text as T
from tallyspark.plans.registry import query
from tallyspark.sources import bridge as B

#: Branches with an order's number in place of {n}, and the issue that each names; {n} has seven digits.
BRANCHES = [("feature/{n}-auth", "issue-{n}"), ("{n}_x", "issue-{n}"), ("fix/OP-00{n}/9", "OP-00{n}"), ("releases/{n}-x", None), ("renovate/{n}", None), ("backup/{n}", None), ("Archive/{n}", None), ("gh-pages/{n}", None), ("revert-{n}-x", None), ("feature/topic/{n}", None), ("feature/{n}b", None), ("docs/2024-05-{n}", None)]
#: Descriptions, the issue that each names, the state of its declarations, and their first parent.
BODIES = [
    ("closes #{n}", "issue-{n}", "missing", None), ("see OP-{n}", None, "missing", None), ("implements OP-{n}", "OP-{n}", "missing", None), ("refs #5\nIssue: OP-{n}", "OP-{n}", "missing", None), ("closes <!-- x --> #{n}", None, "missing", None),
    ("```\ncloses #1\n```\nrefs #{n}", "issue-{n}", "missing", None), ("- Item\n    refs #{n}", "issue-{n}", "missing", None), ("- Item\n\n      closes #1\n\nRefs: #{n}", "issue-{n}", "missing", None), ("> closes #{n}", None, "missing", None), ("closes `x` #{n}", None, "missing", None),
    ("Corrects: #{n}\ncloses #7", "issue-7", "parents", "{n}"), ("- **Corrects:** #{n}, #3", None, "parents", "{n}"), ("Corrects #{n}", None, "invalid", None), ("Corrects: **#{n}**", None, "invalid", None), ("    Corrects: #{n}", None, "parents", "{n}"), ("Corrects: none\nfixes #{n}", "issue-{n}", "none", None), ("~~~\nCorrects: #{n}\n~~~", None, "missing", None), ("Corrects: #{n}\nCorrects: #1", None, "invalid", None),
]


def filled(spark, sf, templates: list[str]):
    n = (F.col("o_orderkey") + 1_000_000).cast("string")
    template = F.get(F.array(*map(F.lit, templates)), (F.col("o_orderkey") % len(templates)).cast("int"))
    return B.table(spark, sf, "orders").select("o_orderkey", F.replace(template, F.lit("{n}"), n).alias("text"))


def expected(values: list[str | None]) -> str:
    """What the SQL says of an order: the value of its template, with its number in place of {n}."""
    cases = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"replace(CASE o_orderkey % {len(values)} {cases} END, '{{n}}', (o_orderkey + 1000000)::VARCHAR)"


@query("P11_branches", f"SELECT o_orderkey, {expected([i for _, i in BRANCHES])} AS issue FROM orders")
def _(spark, sf):
    return filled(spark, sf, [b for b, _ in BRANCHES]).select("o_orderkey", T.issue_of_branch(F.col("text")).alias("issue"))


@query("P15_prose_issue", f"SELECT o_orderkey, {expected([x[1] for x in BODIES])} AS issue FROM orders")
def _(spark, sf):
    return filled(spark, sf, [x[0] for x in BODIES]).select("o_orderkey", T.issue_of_body(F.col("text")).alias("issue"))


@query("P16_declarations", f"SELECT o_orderkey, {expected([x[2] for x in BODIES])} AS state, {expected([x[3] for x in BODIES])}::BIGINT AS parent FROM orders")
def _(spark, sf):
    d = filled(spark, sf, [x[0] for x in BODIES]).select("o_orderkey", T.corrects(F.col("text")).alias("d"))
    return d.select("o_orderkey", "d.state", F.get("d.parents", F.lit(0)).alias("parent"))


@query("P14_without_declarations", "SELECT doc_id, ['issue-' || (doc_id + 1)] AS issues FROM documents")
def _(spark, sf):
    """A declaration ends a list of closed issues: of each document's number, a parent, and what follows it, only the number is closed."""
    n = F.col("doc_id")
    said = F.concat(F.lit("closes #"), (n + 1).cast("string"), F.lit("\n* Corrects : #7, fixes #99\n#"), (n + 2).cast("string"))
    return B.table(spark, sf, "documents").select("doc_id", T.closed_issues(said).alias("issues"))

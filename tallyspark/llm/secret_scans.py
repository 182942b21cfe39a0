"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (what any match must contain). The
index holds, for each of the rules' trigrams, the documents that contain it; a rule's postings are intersected and
united as its query says, and only candidates meet the regular expression. A rule without a mandatory trigram scans
every text.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import parts, table


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and non-overlapping, whose group has at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    """A pattern for a word's ASCII letters in either case; re.I would also match other letters that fold to them."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORD = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
#: The base kinds, fixed values, in the order in which kinds are listed.
BASE = (
    Rule("assign", rf"({KEYWORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: A key's lines where its end is missing: headers, runs of its alphabet, and a short last one.
BREAK = r"(?:\s|\\[nr])*"
KEY_LINES = rf"(?:{BREAK}(?:Proc-Type|DEK-Info):[^\n]*)*(?:{BREAK}[A-Za-z0-9+/]{{16,}}={{0,2}})+(?:{BREAK}[A-Za-z0-9+/]{{1,15}}={{1,2}})?"
#: Further kinds: forms of credentials that their issuers publish. A private key goes to its end line, or as far as its lines do.
MORE = (
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----|{KEY_LINES})?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+]{2,12}://[^/\s:@]*:[^/\s@]+@"),
)
#: A query is a set of alternatives, each a set of trigrams that must all be there; None: anything may match.
Query = frozenset[frozenset[str]] | None
SETS = 64


def lower(chars: set[str]) -> set[str]:
    return {c.lower() for c in chars}


def strings(node, most: int = SETS) -> set[str] | None:
    """The lower-cased strings that a parsed pattern matches, if they are a few."""
    out = {""}
    for op, arg in node:
        if op is sre.LITERAL:
            more = {chr(arg).lower()}
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
            more = lower({chr(c) for _, c in arg})
        elif op is sre.SUBPATTERN:
            more = strings(arg[-1], most)
        elif op is sre.BRANCH:
            parts = [strings(x, most) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 2 and (part := strings(arg[2], most)):
            more, held = set(), {""}
            for k in range(arg[1] + 1):
                more |= held if k >= arg[0] else set()
                held = {a + b for a in held for b in part}
        else:
            more = None
        if more is None or len(out) * len(more) > most:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigrams(pattern: str) -> Query:
    """The Boolean query of a pattern: runs of nodes with few strings give trigrams; the runs' queries are intersected."""

    def any_of(found: set[str]) -> Query:
        if any(len(x) < 3 for x in found):
            return None
        needs = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in found}
        return frozenset(x for x in needs if not any(y < x for y in needs))  # a need that holds another is implied

    def both(a: Query, b: Query) -> Query:
        return b if a is None else a if b is None or len(a) * len(b) > SETS else frozenset(x | y for x in a for y in b)

    def query(nodes) -> Query:
        out, run = None, {""}
        for one in nodes:
            alone = strings([one])
            if alone is not None and len(run) * len(alone) <= SETS:
                run = {a + b for a in run for b in alone}
                continue
            out, run = both(out, any_of(run)), alone or {""}
            op, arg = one
            if op is sre.SUBPATTERN:
                out = both(out, query(arg[-1]))
            elif op is sre.BRANCH:
                parts = [query(x) for x in arg[1]]
                out = both(out, None if None in parts else frozenset().union(*parts))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                out = both(out, query(arg[2]))
        return both(out, any_of(run))

    return query(parser.parse(pattern))


def exact(rule: Rule) -> str:
    """A pattern of one class, repeated, with the least length inside: it finds the same runs and skips shorter ones."""
    return rule.pattern[:-1] + f"{{{rule.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) and rule.least else rule.pattern


def finder(rules: tuple[Rule, ...]):
    """A function that gives the spans (start, place of the rule, end) of each of a block of texts, in order.

    The block gets its part of the index, the postings of the rules' trigrams as bit sets over its texts. A rule's postings
    are intersected and united as its query says, and its regular expression verifies the candidates on their whole texts.
    """
    queries = [trigrams(r.pattern) for r in rules]
    wanted = sorted(set().union(*(need for q in queries if q for need in q)))
    ready = [re.compile(exact(r)) for r in rules]

    def find(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        index = dict.fromkeys(wanted, 0)
        for i, text in enumerate(texts):
            low, bit = text.lower(), 1 << i
            for t in wanted:
                if t in low:
                    index[t] |= bit
        every = (1 << len(texts)) - 1
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (q, rule) in enumerate(zip(queries, rules, strict=True)):
            rows = every if q is None else 0
            for need in q or ():
                both = every
                for t in need:
                    both &= index[t]
                rows |= both
            while rows:
                i = (rows & -rows).bit_length() - 1
                rows &= rows - 1
                spans[i] += [(m.start(), k, m.end()) for m in ready[k].finditer(texts[i]) if len(m[rule.group]) >= rule.least]
        return [sorted(x) for x in spans]

    return find


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of docs: id_col and spans, an array of (kind, place of the kind in rules, start, end) in code points.

    Spans stand by start, then kind as listed. The index is made block by block (some MB of texts), in the task that has
    the texts, and nothing is shuffled. A null text has no spans; ids may repeat or be null; an empty table gives none;
    other columns are ignored.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(rules)
        for batch in parts(batches):
            spans = find([x or "" for x in batch.column(1).to_pylist()])
            out = [[{"kind": rules[k].kind, "place": k, "start": a, "end": b} for a, k, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("place", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))], ["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(found, f"id {kind}, spans array<struct<kind:string,place:int,start:long,end:long>>").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by [kind], spans that overlap as one; n_chars, if there, follows where a text changed.

    Rows and all other columns stay as they are; a null or empty text stays, an empty table gives none. Of spans that begin
    together the longest names the kind.
    """
    columns, at = docs.columns, docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(rules)
        for batch in parts(batches, at):
            texts = batch.column(at).to_pylist()
            out = []
            for text, spans in zip(texts, find([x or "" for x in texts]), strict=True):
                kept, end = [], 0
                for a, b, k in sorted((a, -b, k) for a, k, b in spans):
                    if a >= end:
                        kept += [text[end:a], f"[{rules[k].kind}]"]
                    end = max(end, -b)
                out.append("".join([*kept, text[end:]]) if spans else text)
            held = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            if "n_chars" in columns:
                k = columns.index("n_chars")
                n = [old if new == was else len(new) for new, was, old in zip(out, texts, batch.column(k).to_pylist(), strict=True)]
                held = held.set_column(k, batch.schema.field(k), pa.array(n, batch.schema.field(k).type))
            yield held

    return docs.mapInArrow(clean, docs.schema)


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts of the base kinds, the digest of their spans, and all spans as a string."""
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["place"] < len(BASE))
    return spans.select(id_col, *(count(r.kind) for r in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


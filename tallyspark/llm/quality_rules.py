"""Quality rules as a short-circuit cascade, ordered by rejections per cost as measured on a sample.

A document is kept if no rule rejects it, so the order changes the time and never the verdict: the sample's figures
only decide which rule looks first. Rules take counts that the base pass has made, or the text itself.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.common import ASCII_SPACE, parts, table

#: Symbols that are counted. A fixed value of the base rule.
SYMBOLS = "#*$%&|<>"
BULLETS = "\u2022\u2023\u25e6\u25aa*-"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Doc:
    """A text with its counts, each made when a rule first asks for it."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(ASCII_SPACE)]

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, ASCII_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(getattr(self, x) for x in COUNTS)


Rule = Callable[[Doc], bool]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words which the text has twice or more; the first one counts too."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) >= 1 << 20:  # a third factor would pass 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(keys)] |= again
    return int(covered.sum())


def too_short_or_repetitive(d: Doc) -> bool:
    return d.n_words < 50 or 100 * d.n_repeat_words > 50 * d.n_words


def odd_word_length(d: Doc) -> bool:
    """The mean word has fewer than 2 or more than 15 characters."""
    return not 2 * d.n_words <= d.word_chars <= 15 * d.n_words


def many_symbols(d: Doc) -> bool:
    """More than three symbols to ten words."""
    return 10 * d.n_symbols > 3 * d.n_words


def many_equal_lines(d: Doc) -> bool:
    """More than half of the lines were there before."""
    return 2 * d.n_dup_lines > len(d.lines)


def bullet_lines(d: Doc) -> bool:
    """More than nine tenths of the lines begin with a bullet or a hyphen, white space aside."""
    return 10 * sum(x.lstrip(ASCII_SPACE)[0] in BULLETS for x in d.lines) > 9 * len(d.lines)


def ellipsis_lines(d: Doc) -> bool:
    """More than three tenths of the lines end with an ellipsis, white space aside."""
    return 10 * sum(x.rstrip(ASCII_SPACE).endswith(("...", "\u2026")) for x in d.lines) > 3 * len(d.lines)


def few_letters(d: Doc) -> bool:
    """Under half of the words hold a letter."""
    return 2 * sum(1 for w in d.words if w.translate(None, b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")) < len(d.words)


def one_word_again(d: Doc) -> bool:
    """One word makes up over 40 % of the text."""
    return 5 * max(Counter(d.words).values(), default=0) > 2 * len(d.words)


RULES: dict[str, Rule] = {f.__name__: f for f in (odd_word_length, many_symbols, many_equal_lines, bullet_lines, ellipsis_lines, few_letters, one_word_again)}


def ordered(docs: DataFrame, text_col: str, rules: dict[str, Rule], base: Rule, sample: int) -> list[str]:
    """Rule names, each the one that rejects most for its time among sampled texts that base and the rules before it pass.

    About sample rows, drawn evenly from all partitions, are judged whole, where they stand; only their verdicts and the
    rules' times come to the driver. Each rule is timed on a text of its own, with all counts that it needs. Ties by name.
    """
    names, n = list(rules), docs.count()
    if not n or not names:
        return sorted(names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0):
            failed, spent = [], []
            for text in batch.column(0).to_pylist():
                d = Doc(text or "")
                if base(d):
                    continue
                failed.append([])
                spent.append([])
                for name in names:
                    began = time.process_time_ns()
                    failed[-1].append(rules[name](Doc(d.text)))
                    spent[-1].append(time.process_time_ns() - began)
            yield pa.RecordBatch.from_arrays([pa.array(failed, pa.list_(pa.bool_())), pa.array(spent, pa.list_(pa.int64()))], ["failed", "spent"])

    rows = docs.select(text_col).sample(min(1.0, sample / n), seed=7).mapInArrow(judge, "failed array<boolean>, spent array<long>").collect()
    failed, spent = (np.array([r[k] for r in rows], np.int64).reshape(-1, len(names)) for k in range(2))
    order, left = [], np.ones(len(rows), bool)
    while len(order) < len(names):
        worth = (failed[left].sum(axis=0) + 0.5) / (spent[left].sum(axis=0) + 1)
        best = min((k for k in range(len(names)) if names[k] not in order), key=lambda k: (-worth[k], names[k]))
        order.append(names[best])
        left &= failed[:, best] == 0
    return order


def quality(docs: DataFrame, rules: dict[str, Rule] | None = None, base: Rule = too_short_or_repetitive, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000) -> DataFrame:
    """Counts and verdict of every row: id_col, SCHEMA's columns; rejected_by names the rule that a document failed first.

    The sample (about so many rows) only orders the rules. A null or empty text has no words and fails the base rule. Ids
    may be null or repeat, an empty table gives none, and other columns are ignored. Texts are read whole; nothing is
    shuffled.
    """
    rules = RULES if rules is None else rules
    cascade = [(name, rules[name]) for name in ordered(docs, text_col, rules, base, sample)]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                d = Doc(text or "")
                failed = base(d)
                by = base.__name__ if failed else next((name for name, rule in cascade if rule(d)), None)
                rows.append((*d.counts, failed, by is None, by))
            out = pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names).astype({"rejected_by": object}), schema=arrow, preserve_index=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], ["id", *names])

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    arrow = pa.schema([(n, pa.string() if n == "rejected_by" else pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n in names])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(judged, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", sample: int = 1000) -> DataFrame:
    """The rows of docs that pass, with all their columns, decided row by row where they stand.

    A null or empty text fails; rows that repeat are judged alike; an empty table gives none. A rule that comes after
    the one that rejects a text isn't asked, and counts that no rule asks for aren't made.
    """
    cascade = [too_short_or_repetitive, *(RULES[name] for name in ordered(docs, text_col, RULES, too_short_or_repetitive, sample))]
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, at):
            good = [not any(rule(d) for rule in cascade) for d in (Doc(x or "") for x in batch.column(at).to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("rejected_by")


#: The same rows in SQL; the rules are those of RULES and too_short_or_repetitive. rejected_by depends on the order of
#: the rules, which is measured, so the query leaves it out.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS tri
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM t) WHERE n >= 2),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[•‣◦▪*-]'))) AS n_bullets,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses, len(list_filter(words, lambda x: regexp_matches(x, '[^0-9!-/:-@\[-`{-~]'))) AS n_lettered,
        coalesce(list_max(map_values(list_histogram(words))), 0) AS n_top
      FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND NOT 10 * n_symbols > 3 * n_words
  AND NOT 2 * n_dup_lines > n_lines AND NOT 10 * n_bullets > 9 * n_lines AND NOT 10 * n_ellipses > 3 * n_lines AND NOT 2 * n_lettered < n_words AND NOT 5 * n_top > 2 * n_words AS kept
FROM b
"""

"""Scalar rules of the score model as column expressions."""

from __future__ import annotations

import hashlib
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = (1 << 63) - 1
# Forms of dates and versions in model names, and size classes of models that run on own machines.
MODEL_PREFIX = r"^zai-coding-plan/"
MODEL_SUFFIX = r"(-\d{8}|-\d{6}|-\d{4}|-preview\d*|-latest)$"
MODEL_DATE = r"-\d{4}-\d{2}-\d{2}$"
PARAMETERS = r"(?:^|[^0-9])([0-9]+(?:\.[0-9]+)?)b(?:[^0-9a-z]|$)"
LARGE, SMALL = ("nemotron-ultra", "deepseek-r1-full"), ("phi-4-mini", "embeddings", "reranker")
SIZE_LABELS = {"size/xs": 0.5, "xs": 0.5, "size/s": 1.0, "s": 1.0, "size/m": 3.0, "m": 3.0, "size/l": 5.0, "l": 5.0, "size/xl": 8.0, "xl": 8.0}
WORK_TYPES = ("security", "incident", "compliance", "bug", "tech-debt", "research", "feature")
STRATEGIC = (
    r"\bproduct decisions?\b", r"\bPM requested\b", r"(?s)\bfeature flags?\b.*\bdisabl(?:e|es|ed|ing)\b", r"(?s)\bbusiness requirements?\b.*\bchanged?\b",
    r"\bpivot(?:s|ed|ing)?\b", r"\bdeprecat(?:e[ds]?|ing|ions?)\b", r"\bsunset(?:s|ted|ting)?\b", r"\bremoving features?\b", r"\bno longer needed\b", r"\breplaced by\b",
)
QUALITY = (
    r"\bbroke(?:n)?\b", r"\bbreak(?:s|ing|ages?)?\b", r"\bcrash(?:es|ed|ing)?\b", r"\bOOM(?:s|ed|ing)?\b", r"\bout of memory\b", r"\bregressions?\b", r"\bdegradations?\b",
    r"\bincidents?\b", r"\boutages?\b", r"\bbug(?:s|gy|fix(?:es)?)?\b", r"\bdefect(?:s|ive)?\b", r"(?s)\bperformance\b.*\bdegrad(?:e[ds]?|ing|ations?)\b", r"\bmemory leaks?\b",
    r"\bdata loss(?:es)?\b", r"\bcorrupt(?:s|ed|ing|ions?)?\b", r"\btimeouts?\b", r"\bdeadlock(?:s|ed|ing)?\b", r"(?s)\bsecurity\b.*\bvuln(?:s|erab(?:le|ility|ilities))?\b",
)


def normal_model(raw: Column) -> Column:
    """Lower case, trimmed, without the plan prefix, one version suffix and a trailing date."""
    m = F.regexp_replace(F.lower(F.trim(raw)), MODEL_PREFIX, "")
    return F.regexp_replace(F.regexp_replace(m, MODEL_SUFFIX, ""), MODEL_DATE, "")


def normal_host(raw: Column) -> Column:
    """Lower case, trimmed; empty or null is unknown."""
    return F.coalesce(F.nullif(F.lower(F.trim(raw)), F.lit("")), F.lit("unknown"))


def host_key(model: Column, host: Column) -> Column:
    """The price key of a model at a host, or null where the host is unknown."""
    h = normal_host(host)
    return F.when(h != "unknown", F.concat_ws("@", normal_model(model), h))


def size_class(model: Column) -> Column:
    """The size class of a self-hosted model by its name, or the empty string."""
    m = F.lower(model)
    has = lambda words: F.lit(False) if not words else F.rlike(m, F.lit("|".join(words)))
    count = F.regexp_extract(m, PARAMETERS, 1)
    b = F.when(count != "", count.cast("double"))
    name = lambda x: F.lit(f"self-hosted-{x}")
    return F.when(has(LARGE), name("large")).when(has(SMALL), name("small")).when(b >= 70, name("large")).when(b >= 7, name("medium")).when(b.isNotNull(), name("small")).otherwise(F.lit(""))


def to_micro(dollars: Column) -> Column:
    """P10: dollars to whole micro-dollars, halves to even; not a number is 0, and what a long can't hold is cut to it."""
    x = F.rint(dollars * 1e6)
    return F.when(F.isnan(dollars), F.lit(0).cast("long")).when(x >= float(LONG), F.lit(LONG)).when(x <= -float(LONG), F.lit(-LONG - 1)).otherwise(x.try_cast("long"))


def to_dollars(micro: Column) -> Column:
    return micro.cast("double") / 1e6


def clamped(x: Column) -> Column:
    """Negatives become 0."""
    return F.greatest(x, F.lit(0))


def size_weight(labels: Column) -> Column:
    """The weight of the first known size label in the labels' order, or 0."""
    known = F.create_map(*(F.lit(x) for pair in SIZE_LABELS.items() for x in pair))
    found = F.filter(F.transform(labels, lambda x: F.element_at(known, F.lower(x))), lambda w: w.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(0.0))


def effort_weight(additions: Column, deletions: Column, files: Column) -> Column:
    """The weight of a change by its lines and ten times its files."""
    effort = additions + deletions + 10 * files
    return F.when(effort <= 15, 0.5).when(effort <= 60, 1.0).when(effort <= 200, 3.0).when(effort <= 1000, 5.0).otherwise(8.0)


def work_type(labels: Column) -> Column:
    """Of the types that labels name, bare or after type: or kind:, the first in the order of impact; feature by default."""
    names = F.transform(labels, lambda x: F.trim(F.regexp_replace(F.lower(F.trim(x)), r"^(type|kind):", "")))
    return F.coalesce(*(F.when(F.array_contains(names, t), F.lit(t)) for t in WORK_TYPES), F.lit("feature"))


def revert_kind(message: Column) -> Column:
    """revert_strategic if a strategic word stands in the message and no quality word does, else revert_quality."""
    any_of = lambda patterns: F.coalesce(*[F.rlike(message, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns)))], F.lit(False))
    return F.when(any_of(STRATEGIC) & ~any_of(QUALITY), F.lit("revert_strategic")).otherwise(F.lit("revert_quality"))


def unattributed(issue: Column) -> Column:
    """empty, unattributed, or one of its kinds."""
    return F.coalesce(issue, F.lit("")).rlike("^(unattributed(:.*)?)?$")


def bucket_of_branch(branch: Column) -> Column:
    """The bucket of spend whose branch names no issue."""
    b = F.coalesce(F.trim(branch), F.lit(""))
    return F.when(b.isin("main", "master"), F.lit("unattributed:main")).when(b.isin("", "HEAD"), F.lit("unattributed:detached-head")).otherwise(F.lit("unattributed:branch-without-issue"))


def branch_hash(repo: Column, branch: Column) -> Column:
    """The key of a branch of a real repository; null for main lines and detached heads."""
    b = F.regexp_replace(branch, "^refs/heads/", "")
    real = repo.isNotNull() & ~repo.isin("", "unqualified") & ~b.isin("main", "master", "HEAD", "detached", "")
    return F.when(real, F.sha2(F.concat(repo, F.lit("\0"), b), 256))


def canonical_repo(raw: Column) -> Column:
    """owner/name in lower case without slashes and .git at its ends, or null where it isn't one."""
    r = F.regexp_replace(F.lower(F.trim(raw)), r"^/+", "")
    r = F.regexp_replace(r, r"(/|\.git)+$", "")
    valid = (F.length(raw) <= 256) & r.rlike(r"^[a-z0-9._-]+(/[a-z0-9._-]+)+$") & ~r.rlike(r"(^|/)\.{1,2}(/|$)") & (r != "unqualified")
    return F.when(valid, r)


def length_prefixed(*parts: Column) -> Column:
    """P20: SHA-256 over parts, each after its length in eight bytes, so that no two lists of parts run together."""
    framed = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), F.encode(p, "UTF-8")) for p in (F.coalesce(x.cast("string"), F.lit("")) for x in parts)]
    return F.sha2(F.concat(*framed), 256)


def person_key(secret: bytes, period_size: str, period_start: Column, person: Column) -> Column:
    """The sealed key of a person in a period, in hex: HMAC-SHA-256 under the secret over the period's size, its start
    (RFC 3339 in UTC, whole seconds) and the person, with a zero byte between them."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in key))
    start = F.date_format(period_start, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    said = F.encode(F.concat_ws("\0", F.lit(period_size), start, person), "UTF-8")
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), said), 256))), 256)


def repos_match(a: Column, b: Column) -> Column:
    """Equal, or either isn't qualified."""
    blind = lambda r: F.coalesce(r, F.lit("")).isin("", "unqualified")
    return (a == b) | blind(a) | blind(b)


def micros(ts: str) -> Column:
    """A time as whole microseconds, of a column with or without a zone (UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def split_cached(df: DataFrame, total_in: str, cached: str, out: str, total: str) -> DataFrame:
    """P25: input tokens apart from cached ones. Rows whose cache is larger than their input, or whose parts don't sum to
    their total, are not valid and have no amounts."""
    valid = (F.col(cached) <= F.col(total_in)) & (F.col(total_in) + F.col(out) == F.col(total))
    keep = lambda c: F.when(valid, c)
    return df.withColumns({"valid": valid, "input_tok": keep(F.col(total_in) - F.col(cached)), "cache_read": keep(F.col(cached)), "output_tok": keep(F.col(out))})


def window_date(raw: Column) -> Column:
    """The start of a year, month or day; null for anything else."""
    form = F.when(raw.rlike(r"^\d{4}$"), F.concat(raw, F.lit("-01-01"))).when(raw.rlike(r"^\d{4}-\d{2}$"), F.concat(raw, F.lit("-01"))).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw)
    return form.try_cast("timestamp_ntz")


def repo_scope(cwd: Column, root: str, nested: list[str]) -> Column:
    """Whether a folder is inside a repository's root, in another repository nested there, or outside."""
    under = lambda at: (cwd == at) | F.startswith(cwd, F.lit(at.rstrip("/") + "/"))
    deeper = F.lit(False)
    for n in nested:
        deeper = deeper | under(n)
    return F.when(deeper, F.lit("nested")).when(under(root), F.lit("inside")).otherwise(F.lit("outside"))

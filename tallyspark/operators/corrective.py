"""Corrective work: what a change that repairs others adds, and what it takes from them, in exact fractions.

A component of changes and their corrects-links is small (it is one story of repairs), so it is settled in one group;
components come from operators.graph. Three passes: which single parent a follow-up charges, how much scope it adds
there, and how a parent's points are shared with the follow-ups that count.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from fractions import Fraction as Q

import pandas as pd
from pyspark.sql import DataFrame

# Scales of weight and quality, their lower level after a correction, states of links, window, floor.
WEIGHTS = (Q(1, 2), Q(1), Q(3), Q(5), Q(8))
CORRECTED = {Q(1): Q(17, 20), Q(7, 10): Q(11, 20)}
QUALITIES = (*CORRECTED, *CORRECTED.values(), Q(4, 5), Q(1, 10))
LADDER = ((15, Q(1, 2)), (60, Q(1)), (200, Q(3)), (1000, Q(5)))
GONE = ("removed", "unrelated", "withdrawn")
KEPT = ("confirmed", "disputed", "withdrawn-confirmed")
STATES = (*KEPT, "pending", "excluded", "declared", "disputed-declared")
DISPUTED = ("disputed", "disputed-declared", "withdrawn-confirmed")
WINDOW, FLOOR = timedelta(days=14), Q(1, 10)


@dataclass(frozen=True)
class Review:
    own: Q
    before: Q = Q(0)
    after: Q = Q(0)
    original: Q = Q(0)
    pure: bool = False


@dataclass(frozen=True)
class Link:
    parent: int
    state: str
    review: Review | None = None


@dataclass
class Change:
    id: int
    developer: str
    merged_at: datetime | None
    weight: Q
    quality: Q
    effort: int | None = None
    links: list[Link] = field(default_factory=list)
    key: tuple = ()

    def __post_init__(self) -> None:
        self.links = [x for x in self.links if x.state not in GONE]


@dataclass
class Result:
    id: int
    points: Q
    quality: Q
    share: Q
    own: Q
    before: Q = Q(0)
    after: Q = Q(0)
    credit: Q = Q(0)
    parent: int = 0
    status: str = "resolved"
    reason: str = ""
    eligible: str = "eligible"
    provisional: bool = False
    disputed: bool = False
    counts: bool = False  # whether its parent shares points with it


def ladder(effort: int) -> Q:
    return next((w for limit, w in LADDER if effort <= limit), Q(8))


class Story:
    """One component, in the order of its merges."""

    def __init__(self, changes: Iterable[Change]) -> None:
        self.changes = sorted(changes, key=lambda c: (c.merged_at or datetime.min, *c.key, c.id))
        self.by = {c.id: c for c in self.changes}
        if len(self.by) < len(self.changes):
            raise ValueError("two changes have the same id")
        self.place = {c.id: k for k, c in enumerate(self.changes)}
        self.problem: dict[int, str] = {}
        self.origins: dict[int, frozenset[int]] = {}
        self.open: dict[int, list[int]] = {}  # follow-ups of several originals: those of their own developer
        self.weak: set[int] = set()  # links that aren't confirmed and reviewed
        for c in self.changes:
            self.origin(c.id)
        self.parent = {c.id: p for c in self.changes if (p := self.single(c))}
        self.settle()

    def origin(self, id_: int) -> frozenset[int]:
        """The changes without parents that a change goes back to; notes what is wrong on the way, which is walked without
        recursion, as a chain may be long."""
        way, todo = {id_: set()}, [] if id_ in self.origins else [(self.by[id_], iter(self.by[id_].links))]
        while todo:
            c, links = todo[-1]
            x = next(links, None)
            if x is None:
                todo.pop()
                found = way.pop(c.id)
                self.origins[c.id] = frozenset(found if c.links else {c.id})
                if todo:
                    self.inherit(todo[-1][0].id, c.id, way)
            elif (p := self.judged(c, x)) is None:
                continue
            elif p.id in way:
                self.problem[p.id] = self.problem[c.id] = "cycle"
            elif p.id in self.origins:
                self.inherit(c.id, p.id, way)
            else:
                way[p.id] = set()
                todo.append((p, iter(p.links)))
        return self.origins[id_]

    def inherit(self, child: int, parent: int, way: dict[int, set[int]]) -> None:
        way[child] |= self.origins[parent]
        if parent in self.problem:
            self.problem[child] = self.problem[parent]

    def judged(self, c: Change, x: Link) -> Change | None:
        """The parent that a link leads to, if it counts; notes what is wrong with the link."""
        p = self.by.get(x.parent)
        if x.state not in STATES:
            self.problem[c.id] = "unsupported-relation-state"
        if p is None or x.state in ("pending", "excluded"):
            self.problem[c.id] = "missing-or-excluded-parent"
            return None
        if (p.merged_at or datetime.min) > (c.merged_at or datetime.min):
            self.problem[c.id] = "parent-after-child"
        elif c.merged_at is None or p.merged_at is None:
            self.problem[c.id] = "missing-occurrence"
        return p

    def above(self, id_: int) -> set[int]:
        """A change and all that it goes back to."""
        seen, todo = set(), [id_]
        while todo:
            at = todo.pop()
            if at not in seen and at in self.by:
                seen.add(at)
                todo += [x.parent for x in self.by[at].links]
        return seen

    def single(self, c: Change) -> int:
        """The parent that a follow-up charges: the one that goes back to all its others. 0 without one."""
        origins = self.origins[c.id]
        if c.id in self.problem or not c.links:
            return 0
        if c.weight not in WEIGHTS or c.quality not in QUALITIES:
            self.problem[c.id] = "unsupported-allocation-shape"
            return 0
        if len(origins) > 1:
            self.open[c.id] = sorted((o for o in origins if self.by[o].developer == c.developer), key=self.place.__getitem__)
            self.problem[c.id] = "multiple-originals"
            self.weak.add(c.id)
            return 0
        named = {x.parent for x in c.links}
        deepest = next((x for x in c.links if named <= self.above(x.parent)), None)
        if deepest is None:
            self.problem[c.id] = "unsupported-allocation-shape"
            return 0
        if deepest.review is None or any(x.state not in KEPT for x in c.links):
            self.weak.add(c.id)
        return deepest.parent

    def settle(self) -> None:
        """Where a follow-up has several originals, it charges the one that leaves its developer least; such choices are
        made again until none changes. Choices that come round again can't settle, and are dropped."""
        seen, open_ = set(), sorted(self.open, key=self.place.__getitem__)
        while (now := tuple(self.parent.get(i, 0) for i in open_)) not in seen:
            seen.add(now)
            for i in open_:
                worth = []
                for root in self.open[i]:
                    self.parent[i] = root
                    mine = sum(r.points for r in self.shared() if self.by[r.id].developer == self.by[i].developer)
                    worth.append((mine, self.place[root], root))
                if worth:
                    self.parent[i] = min(worth)[2]
            if tuple(self.parent.get(i, 0) for i in open_) == now:
                return
        for i in open_:
            self.parent.pop(i, None)

    def line(self, id_: int) -> list[int]:
        """A change, its charged parent, that one's, and so on."""
        out = [id_]
        while (p := self.parent.get(out[-1])) and p not in out:
            out.append(p)
        return out

    def scope(self, c: Change, parent: int) -> tuple[Q, Q, bool]:
        """Sizes of the story before and after a follow-up, from the efforts of what it builds on and of earlier changes
        of the same original; whether all efforts are known."""
        root = self.line(parent)[-1]
        earlier = [x.id for x in self.changes[: self.place[c.id]] if self.line(x.id)[-1] == root]
        parts = {i for start in (parent, *earlier) if c.id not in (way := self.line(start)) for i in way}
        efforts = [self.by[i].effort for i in parts]
        total = sum(e or 0 for e in efforts)
        return ladder(total), ladder(total + (c.effort or 0)), None not in (*efforts, c.effort)

    def review(self, child: int, parent: int) -> Review | None:
        return next((x.review for x in self.by[child].links if x.parent == parent), None)

    def shared(self) -> list[Result]:
        out = {c.id: self.first(c) for c in self.changes}
        children: dict[int, list[int]] = {}
        for c in self.changes:
            if p := self.parent.get(c.id):
                children.setdefault(p, []).append(c.id)
        for c in sorted((c for c in self.changes if c.id in self.parent), key=lambda c: len(self.line(c.id))):
            self.grow(c, out)
        for p, kids in children.items():
            counted = [k for k in kids if out[k].counts]
            out[p].provisional |= any(out[k].provisional for k in counted)
            if any(timedelta(0) <= self.by[k].merged_at - self.by[p].merged_at <= WINDOW for k in counted):
                out[p].quality = CORRECTED.get(out[p].quality, out[p].quality)
        for c in self.changes:
            if c.id not in self.parent or not out[c.id].counts:
                sized = [r.original for k in children.get(c.id, []) if out[k].counts and (r := self.review(k, c.id)) and r.original]
                self.share_out(c.id, sized[0] if sized and c.id not in self.parent else c.weight, out, children)
        return [out[c.id] for c in self.changes]

    def first(self, c: Change) -> Result:
        r = Result(c.id, c.weight * c.quality, c.quality, c.weight, c.weight, parent=self.parent.get(c.id, 0), disputed=any(x.state in DISPUTED for x in c.links))
        if c.links:
            r.eligible, r.provisional = "unknown", c.id in self.weak
        if c.id in self.problem:
            r.status, r.reason = "pending", self.problem[c.id]
        return r

    def grow(self, c: Change, out: dict[int, Result]) -> None:
        """What a follow-up adds to its parent's scope."""
        p, r = self.by[self.parent[c.id]], out[c.id]
        review = self.review(c.id, p.id)
        before, after, known = self.scope(c, p.id)
        sound = p.id not in self.problem and out[p.id].status != "pending" and p.weight in WEIGHTS and p.quality in QUALITIES and p.merged_at is not None
        if not sound or not (review or known):
            r.status, r.reason = "pending", "missing-sizing-or-parent-evidence"
            return
        if review:
            r.own, r.before, r.after = review.own, review.before, review.after
        else:
            r.before, r.after = before, after
        r.credit = Q(0) if review and review.pure else min(r.own, max(Q(0), r.after - r.before))
        if r.reason != "multiple-originals":
            r.eligible = "eligible" if r.credit > 0 else "ineligible"
        r.counts = not r.provisional or c.developer == p.developer
        if r.provisional and r.status != "pending":
            r.status = "provisional"

    def share_out(self, top: int, share: Q, out: dict[int, Result], children: dict[int, list[int]]) -> None:
        """A change keeps its share's worth and its follow-ups' credit, less what they own, but a tenth of its share at
        least; the follow-ups divide the rest in order, those of several originals last."""
        todo = [(top, share)]
        while todo:
            at, share = todo.pop()
            r = out[at]
            r.share, worth = share, share * r.quality
            counted = [k for k in children.get(at, []) if out[k].counts]
            paid = [k for k in counted if share > 0]
            owned = sum((out[k].own for k in paid), Q(0))
            budget = worth + sum((out[k].credit for k in paid), Q(0))
            r.points = max(FLOOR * share, budget - owned) if owned else worth
            left = max(Q(0), budget - r.points)
            for k in sorted(counted, key=lambda k: out[k].reason == "multiple-originals"):
                given = min(out[k].own, left)
                left -= given
                todo.append((k, given))


def settled(changes: Iterable[Change]) -> list[Result]:
    """Each change's points, quality, share and growth, in the order of merges."""
    return Story(changes).shared()


OUT = "id long, parent long, status string, reason string, eligible string, provisional boolean, disputed boolean, own string, before string, after string, credit string, share string, quality string, points string"


def _component(rows: pd.DataFrame) -> pd.DataFrame:
    def review(x) -> Review | None:
        if x["own"] is None:
            return None
        size = lambda name: Q(x[name]) if x[name] is not None else Q(0)
        return Review(Q(x["own"]), size("before"), size("after"), size("original"), bool(x["pure"]))

    changes = [
        Change(int(r.id), r.developer, None if pd.isna(r.merged_at) else pd.Timestamp(r.merged_at).to_pydatetime(), Q(r.weight), Q(r.quality), None if pd.isna(r.effort) else int(r.effort), [Link(int(x["parent"]), x["state"], review(x)) for x in (r.links if r.links is not None else [])], (r.repo, int(r.pr), r.sha))
        for r in rows.itertuples(index=False)
    ]
    names = [x.split()[0] for x in OUT.split(", ")]
    exact = ("own", "before", "after", "credit", "share", "quality", "points")
    return pd.DataFrame([[str(v) if n in exact else v for n, v in ((n, getattr(r, n)) for n in names)] for r in settled(changes)], columns=names)


def settle_components(changes: DataFrame) -> DataFrame:
    """Rows (component, id, repo, pr, sha, developer, merged_at, weight, quality, effort, links) to OUT, by component.

    weight, quality and sizes are fractions as text; links are structs (parent, state, own, before, after, original, pure).
    """
    return changes.groupBy("component").applyInPandas(lambda rows: _component(rows), OUT)

"""N-gram Jaccard join by chosen paths.

Documents with equal shingle sets collapse to one representative. A representative's MinHash vector is a sample of
its shingles that others share with the probability of their similarity. A run sends each representative down a few
sampled shingles of the root; buckets of one vanish, small buckets are compared whole. In a large bucket, what is like
its pivot forms a candidate cluster and leaves, and the rest is split again on shingles that its members share unevenly,
never on those that most of them have. Runs repeat until the recall of a pair at the threshold meets the target.
What the buckets find are candidates; they form clusters, and each cluster is checked whole and exactly, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tallyspark.llm.common import forget, parts, table, written

POSITIONS = 64
#: Two vectors are candidates if so many of the 64 positions agree: at a similarity of 0.8 one pair in 10**7 fails this.
AGREE = 32
#: In a large bucket, a cluster round its pivot holds what agrees with it in a bucket's own number of positions, from NEAR
#: to AGREE. A candidate pair differs in at most POSITIONS - AGREE positions, so one that isn't inside the cluster has a
#: member below that number and another at most so many above it: these go on down, and a bucket of near copies is done.
NEAR = 10
#: Positions in which two members of a large bucket agree less often than this tell them apart; children are sampled
#: from these, or from the FEWEST that agree least.
APART, FEWEST = 0.25, 16
#: Kinds of rows in a comparison: of a small bucket; of a large one, those that are compared with all, and all others.
SMALL, FEW, REST = 0, 1, 2
_seeds = np.random.RandomState(20240229)
MULTIPLY = (_seeds.randint(0, 1 << 62, POSITIONS).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = _seeds.randint(0, 1 << 62, POSITIONS).astype(np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Join:
    """What the join takes: words to a shingle, threshold, children of a node, target recall, bucket sizes, depth.

    Depth is a backstop: every level at least halves a bucket, or nearly so. What is left below it becomes one cluster,
    which is checked whole as any other, so that no link is lost there.
    """

    words: int = 5
    threshold: float = 0.8
    children: int = 2
    recall: float = 0.999999
    small: int = 256
    depth: int = 40
    block: int = 1024
    broadcast_ids: int = 1_000_000
    broadcast_buckets: int = 100_000

    def runs(self) -> int:
        """Runs until a pair at the threshold is missed with a probability under 1 - recall, however deep its buckets go.

        A pair agrees in a share of its vectors' positions, and a node's child keeps it with that probability; a run
        fails if at every node all children lose it, and a leaf compares its whole bucket. All runs sample the same
        positions, so their failures are multiplied for each share, and the shares are weighed by the binomial.
        """

        def lost(share: float) -> float:
            keeps = 1.0
            for _ in range(self.depth):
                keeps = 1 - (1 - share * keeps) ** self.children
            return 1 - keeps

        t = self.threshold
        shares = [(comb(POSITIONS, m) * t**m * (1 - t) ** (POSITIONS - m), lost(m / POSITIONS)) for m in range(POSITIONS + 1)]
        n, most = 1, POSITIONS // self.children
        while n < most and sum(weight * miss**n for weight, miss in shares) > 1 - self.recall:
            n += 1
        return n


def shingler(words: int):
    """A function that gives a text's distinct shingles as sorted 64-bit hashes.

    Words are runs of anything but ASCII white space. A text of fewer words has one shingle, all of them; one without
    words has none.
    """
    known: dict[bytes, int] = {}

    def shingles(text: str) -> np.ndarray:
        said = text.encode().split()
        if not said:
            return np.zeros(0, np.uint64)
        if len(known) > 300_000:
            known.clear()
        for w in set(said).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, said), np.uint64, len(said))
        k = min(words, len(said))
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out *= STEP
            out ^= out >> np.uint64(29)
            out += h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(31)
        out *= MIX
        out ^= out >> np.uint64(32)
        return np.unique(out)

    return shingles


def minima(shingles: np.ndarray) -> np.ndarray:
    """MinHash: at each position, the least of a hash of all shingles."""
    out = np.full(POSITIONS, (1 << 64) - 1, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096]
        out = np.minimum(out, (part[None, :] * MULTIPLY[:, None] + ADD[:, None]).min(axis=1))
    return out


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def vectors(docs: DataFrame, words: int, roots: int, id_col: str, text_col: str) -> DataFrame:
    """id, key (equal for equal shingle sets; null without words), roots and vec of every row.

    roots are the first minima in full. vec has 16 bits of each: what agrees in full agrees there too, so no candidate
    is lost, and what is shuffled with every bucket is short.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(words)
        for batch in parts(batches):
            sets = [shingles(x or "") for x in batch.column(1).to_pylist()]
            least = np.array([minima(s) for s in sets], np.uint64).reshape(len(sets), POSITIONS)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            vec = (least >> np.uint64(32)).astype(np.uint16).view(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(digest, sets), pa.binary()), lists(least[:, :roots].copy().view(np.int64)), lists(vec)], ["id", "key", "roots", "vec"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(read, "id long, key binary, roots array<long>, vec array<short>")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal values in column 0 of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(0)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for cut in cuts.tolist():
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each of n nodes' component, over edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def close_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, id, vec, kind) sorted by path: edges a-b that span the candidates of each bucket.

    In a small bucket all rows are compared; in a part of a large one, its FEW with all.
    """
    out_a, out_b = [], []
    for t in groups_of(batches):
        n, few = len(t), np.flatnonzero(t.column(3).to_numpy() != REST)
        if n < 2 or not len(few):
            continue
        ids, vec = t.column(1).to_numpy(), vecs(t.column(2))
        agree = np.zeros((len(few), n), np.int16)
        for p in range(POSITIONS):
            agree += vec[few, p, None] == vec[None, :, p]
        agree[np.arange(len(few)), few] = 0
        a, b = np.nonzero(agree >= AGREE)
        if len(a):
            root = roots(n, few[a], b)
            moved = np.flatnonzero(root != np.arange(n))
            out_a.append(ids[moved])
            out_b.append(ids[root[moved]])
        if sum(map(len, out_a)) > 20_000:
            yield edges_batch(out_a, out_b)
            out_a, out_b = [], []
    yield edges_batch(out_a, out_b)


def edges_batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or none)), pa.array(np.concatenate(b or none))], ["a", "b"])


def vecs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(-1, POSITIONS)


def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, eq, vec) sorted by path: of each path in this task, how many neighbours agree in each position, how many
    neighbours there are, and how many rows have each eq. A bucket's sums have one row for each task."""
    path, last, sums, out = None, None, None, []
    for batch in batches:
        if not len(batch):
            continue
        paths, eq, vec = batch.column(0).to_numpy(), batch.column(1).to_numpy(), vecs(batch.column(2))
        cuts = [0, *(np.flatnonzero(paths[1:] != paths[:-1]) + 1).tolist(), len(paths)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if paths[a] != path:
                path, last, sums = paths[a], None, np.zeros(2 * POSITIONS + 2, np.int64)
                out.append((path, sums))
            rows = vec[a:b] if last is None else np.concatenate([last, vec[a:b]])
            sums[:POSITIONS] += (rows[1:] == rows[:-1]).sum(axis=0)
            sums[POSITIONS] += len(rows) - 1
            sums[POSITIONS + 1 :] += np.bincount(eq[a:b], minlength=POSITIONS + 1)
            last = vec[b - 1 : b]
        if len(out) > 1000:
            yield profiles_batch(out[:-1])
            out = out[-1:]
    yield profiles_batch(out)


def profiles_batch(out: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.int64()))], ["path", "sums"])


def splits(how: Join, last: bool):
    """Rows (path, sums): near, the least eq of a bucket's cluster; most, the greatest eq that may pair with what is outside
    the cluster; down, how many rows these are; few, if what is outside is compared with them right here; and at, the
    positions that the bucket is split on otherwise.

    Of the numbers from AGREE down to NEAR, near is the first that leaves at most how.small members outside the cluster, or
    else the one that sends the fewest members down. Below AGREE the cluster takes no more members than it has from there
    on, so that it isn't made up of what the pivot isn't like.
    """

    def plan(path: int, sums: list[int]) -> tuple[int, int, int, bool, list[int]]:
        if last:
            return 0, -1, 0, False, []
        of = np.array(sums[POSITIONS + 1 :])
        best = None
        for near in range(AGREE, NEAR - 1, -1):
            if near < AGREE and of[near:AGREE].sum() > of[AGREE:].sum():
                break
            below = np.flatnonzero(of[:near])
            most = int(below[-1]) + POSITIONS - AGREE if len(below) else -1
            down, few = int(of[: most + 1].sum()), bool(of[:near].sum() <= how.small)
            if best is None or few or down < best[2]:
                best = near, most, down, few
            if few:
                break
        near, most, down, few = best
        alike = np.array(sums[:POSITIONS]) / max(sums[POSITIONS], 1)
        apart = np.flatnonzero(alike < APART)
        if len(apart) < FEWEST:
            apart = np.argsort(alike, kind="stable")[:FEWEST]
        g = np.random.default_rng(path & ((1 << 63) - 1))
        return near, most, down, few, [] if few else g.permutation(apart)[: how.children].tolist()

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [plan(p, s) for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["path", "near", "most", "down", "few", "at"])

    return planned


def candidates(reps: DataFrame, how: Join) -> DataFrame:
    """Edges a-b between representatives (id, roots, vec; ids distinct) that connect all candidate pairs the paths bring
    together; an edge may come from several buckets."""
    found, rows = None, None
    for level in range(how.depth):
        here = reps.select("id", F.posexplode("roots").alias("p", "least")).select(F.xxhash64("p", "least").alias("path"), "id") if rows is None else rows
        counts = written(here.groupBy("path").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1"), "counts")
        joined = here.join(counts, "path")
        buckets = written((joined if rows is not None else joined.join(reps.select("id", "vec"), "id")).select("path", "id", "n", "pivot", "vec"), "buckets")
        compared = buckets.where(F.col("n") <= how.small).select("path", "id", "vec", F.lit(SMALL).alias("kind"))
        many = counts.where(F.col("n") > how.small).count()
        near = children = None
        used = [counts, buckets] + ([rows] if rows is not None else [])
        if many:
            sent = F.broadcast if many <= how.broadcast_buckets else lambda df: df  # a row per large bucket
            pivots = buckets.where((F.col("n") > how.small) & (F.col("id") == F.col("pivot"))).dropDuplicates(["path"]).select("path", F.col("vec").alias("of"))
            equal = F.aggregate(F.zip_with("vec", "of", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
            large = written(buckets.where(F.col("n") > how.small).join(sent(pivots), "path").select("path", "id", "pivot", "vec", equal.alias("eq")), "large")
            sums = large.select("path", "eq", "vec").sortWithinPartitions("path").mapInArrow(profiles, "path long, sums array<long>")
            sums = sums.groupBy("path").agg(F.array(*(F.sum(F.get("sums", F.lit(k))) for k in range(2 * POSITIONS + 2))).alias("sums"))
            plan = written(sums.mapInArrow(splits(how, level == how.depth - 1), "path long, near int, most int, down long, few boolean, at array<int>"), "plan")
            ruled = large.join(sent(plan), "path")
            near = ruled.where("eq >= near and id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
            rest = ruled.where("eq <= most").withColumn("parts", F.ceil(F.col("down") / (8 * how.small)).cast("int"))
            every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
            placed = rest.where("few and eq < near").select("path", every, "id", "vec", F.lit(FEW).alias("kind"))
            placed = placed.unionByName(rest.where("few and eq >= near").select("path", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "vec", F.lit(REST).alias("kind")))
            compared = compared.unionByName(placed.withColumn("path", F.xxhash64("path", "part")).drop("part"))
            below = rest.where("not few").select("path", "id", "vec", F.explode("at").alias("at"))
            children = written(below.select(F.xxhash64("path", "at", F.get("vec", F.col("at"))).alias("path"), "id", "vec"), "children")
            used += [large, plan]
        pairs = compared.repartition("path").sortWithinPartitions("path").mapInArrow(close_in_buckets, "a long, b long")
        edges = written(pairs if near is None else pairs.unionByName(near), "edges")
        found = edges if found is None else found.unionByName(edges)
        forget(*used)
        rows = children
        if rows is None or rows.isEmpty():
            break
    return found


def components(edges: DataFrame) -> DataFrame:
    """id, root of every node of edges (a, b): the least id of its component.

    Large-star and small-star steps by turns: each node's neighbours are joined to the least of them, until the edges are
    stars, in which each node has one root and no root has another. Only minima are gathered by node, so a hub's neighbours
    never meet in one task.
    """
    held = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "star")
    while True:
        ends = held.select("u", F.lit(1).alias("ups"), F.lit(0).alias("root")).unionByName(held.select(F.col("v").alias("u"), F.lit(0).alias("ups"), F.lit(1).alias("root")))
        if not ends.groupBy("u").agg(F.sum("ups").alias("ups"), F.max("root").alias("root")).where("ups + root > 1").count():
            break
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).distinct(), "large")
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        before, held = held, written(small, "star")
        forget(before, least, large, down)
    nodes = held.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.unionByName(held.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def link_blocks(threshold: float, tile: int = 1024):
    """Rows (cell, side, diagonal, id, weight, shingles) sorted by cell: exact links between and within two blocks.

    Yields id, links (the weights linked to it here) and a root that spans its links. Products are taken tile by tile.
    """

    share = Fraction(threshold).limit_denominator(1000)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches):
            side = t.column("side").to_numpy()
            order = np.argsort(side, kind="stable")
            t = t.take(pa.array(order))
            side, ids, weight = side[order], t.column("id").to_numpy(), t.column("weight").to_numpy().astype(np.float64)
            sets = t.column("shingles").combine_chunks()
            sizes, flat = np.diff(sets.offsets.to_numpy()), sets.flatten().to_numpy()
            n, left = len(ids), int((side == 0).sum())
            owner = np.repeat(np.arange(n), sizes)
            _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
            everywhere = int((count == n).sum())  # shingles that all have add the same to each pair
            use = (count > 1) & (count < n)
            column = np.cumsum(use) - 1
            keep = use[token]
            rows, cols, wide = owner[keep], column[token[keep]], int(use.sum())
            by_column = np.argsort(cols, kind="stable")
            rows, cols = rows[by_column], cols[by_column]
            mine = t.column("diagonal")[0].as_py()
            top, other = (np.arange(n), np.arange(n)) if mine else (np.arange(left), np.arange(left, n))
            exact = np.float32 if share.denominator * 2 * int(sizes.max(initial=0)) < 1 << 24 else np.float64
            common = np.full((len(top), len(other)), everywhere, np.float32)
            for a in range(0, wide, tile):
                here = slice(*np.searchsorted(cols, [a, a + tile]))
                x = np.zeros((n, min(tile, wide - a)), np.float32)
                x[rows[here], cols[here] - a] = 1
                common += x[top] @ x[other].T
            link = np.zeros(common.shape, bool)
            for a in range(0, len(top), tile):
                part = common[a : a + tile].astype(exact)
                union = sizes[top[a : a + tile]].astype(exact)[:, None] + sizes[other].astype(exact)[None, :] - part
                link[a : a + tile] = part * share.denominator >= union * share.numerator
            del common
            if mine:
                np.fill_diagonal(link, False)
            links, root = np.zeros(n, np.int64), np.arange(n, dtype=np.int32)
            spans = [slice(a, a + tile) for a in range(0, len(top), tile)]
            for p in spans:
                part = link[p].astype(np.float64)
                links[top[p]] += (part @ weight[other]).astype(np.int64)
                if not mine:
                    links[other] += (part.T @ weight[top[p]]).astype(np.int64)
            while True:  # the least label over links, both ways, until none changes
                new = root.copy()
                for p in spans:
                    new[top[p]] = np.minimum(new[top[p]], np.where(link[p], root[other][None, :], n).min(axis=1, initial=n))
                    new[other] = np.minimum(new[other], np.where(link[p], new[top[p]][:, None], n).min(axis=0, initial=n))
                new = new[new]
                if (new == root).all():
                    break
                root = new
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[root])], ["id", "links", "root"])

    return linked


def links(docs: DataFrame, reps: DataFrame, clusters: DataFrame, how: Join, id_col: str, text_col: str) -> DataFrame:
    """Exact links of all representatives in clusters (id, root): id, links, root, a row for each pair of blocks.

    A representative's text is read again from the rows that have its least id, and known by its key. A cluster of up to
    16 blocks has blocks of how.block; a larger one has larger blocks, up to four times that, so that its sets are copied
    less often.
    """
    wanted = written(clusters.join(reps.select("id", "least_id", "key", "weight"), "id"), "clustered")
    few = wanted.limit(how.broadcast_ids + 1).count() <= how.broadcast_ids
    sent = F.broadcast if few else lambda df: df
    ids = wanted.select("least_id").distinct()
    said = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = said.join(sent(ids), F.col("id").eqNullSafe(F.col("least_id")), "left_semi").select("id", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(how.words)
        for batch in parts(batches):
            sets = [shingles(x or "") for x in batch.column(1).to_pylist()]
            keys = list(map(digest, sets))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "shingles"])

    sizes = written(wanted.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    side = F.greatest(F.lit(how.block), F.least(F.ceil(F.col("n") / 16), F.lit(4 * how.block)))
    placed = wanted.join(sizes, "root").withColumn("blocks", F.ceil(F.col("n") / side).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("least_id")
    sets = texts.mapInArrow(read, "key binary, shingles array<long>").join(sent(placed), "key")
    # several rows have a representative's least id and its key where rows repeat, or where all its ids are null
    again = wanted.where("weight > 1").limit(1).count() > 0 and said.groupBy("id").count().where("count > 1").limit(1).count() > 0
    sets = sets.dropDuplicates(["key"]) if again else sets
    cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), (F.col("mine") == F.col("other")).alias("diagonal"), "id", "weight", "shingles"
    )
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    found = written(dealt.mapInArrow(link_blocks(how.threshold), "id long, links long, root long"), "links")
    forget(wanted, sizes)
    return found


def classes_of(docs: DataFrame, how: Join, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """own: id and key of every row of docs; and a row for each key that is in a class of several rows: key, rep_id (its
    least id), root (the class), class_id (the least id of the class) and n_links."""
    own = written(vectors(docs, how.words, how.runs() * how.children, id_col, text_col), "vectors")
    reps = own.where("key is not null").groupBy("key").agg(F.count("*").alias("weight"), F.first("roots").alias("roots"), F.first("vec").alias("vec"), F.min("id").alias("least_id"))
    reps = written(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    edges = candidates(reps.select("id", "roots", "vec"), how)
    clusters = components(edges)
    found = links(docs, reps, clusters, how, id_col, text_col)
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    count = found.groupBy("id").agg(F.sum("links").alias("links"))
    table = reps.select("key", "weight", "least_id", "id").join(count, "id", "left").join(joined, "id", "left").where("weight > 1 or links > 0")
    table = table.select("key", F.col("least_id").alias("rep_id"), F.coalesce("root", "id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    table = written(table, "linked")
    least = table.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    named = written(table.join(least, "root"), "classes")
    forget(edges, clusters, found, joined, table, reps)
    return own.select("id", "key"), named


def jaccard_classes(docs: DataFrame, how: Join | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its id, class_id, rep_id and n_links.

    Two rows are linked if the Jaccard similarity of their shingle sets is at least the threshold; n_links counts the
    other rows linked to it, copies too. class_id is the least id of all that a chain of links leads to; rep_id the
    least id with the same shingle set. A null text, or one without words, is linked to nothing and its own class.
    Ids are cast to long. They don't tell rows apart: rows with null or equal ids are linked by their texts as any others,
    and nulls count only where all ids of a class, or of equal shingle sets, are null. An empty table gives none; other
    columns are ignored.
    """
    how = how or Join()
    own, named = classes_of(docs, how, id_col, text_col)
    few = named.limit(how.broadcast_ids + 1).count() <= how.broadcast_ids
    out = own.join(F.broadcast(named) if few else named, "key", "left").withColumn("single", F.col("n_links").isNull())
    own_or = lambda c: F.when(F.col("single"), F.col("id")).otherwise(F.col(c)).alias(c)
    return out.select(F.col("id").alias(id_col), own_or("class_id"), own_or("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, how: Join | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each class: it keeps the least id, nulls last.

    Of rows of a class that share its least id, the least digest of a shingle set stays, and of rows that repeat that, one
    with the least text. Rows without words (null texts too) are no copies of anything and all stay. An empty table stays
    empty.
    """
    how = how or Join()
    own, named = classes_of(docs, how, id_col, text_col)
    few = named.limit(how.broadcast_ids + 1).count() <= how.broadcast_ids
    sent = F.broadcast if few else lambda df: df
    classed = own.join(sent(named.select("key", "root")), "key")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    keep = written(classed.groupBy("root").agg(best.alias("best")).select("root", "best.id", "best.key"), "kept")
    loose = own.groupBy("id").count().where("count > 1 or id is null")
    if loose.isEmpty():
        drop = written(classed.join(keep.select("root", F.col("id").alias("kept")), "root").where("id != kept").select(F.col("id").alias("dropped")), "dropped")
        sent = F.broadcast if drop.limit(how.broadcast_ids + 1).count() <= how.broadcast_ids else sent
        return docs.join(sent(drop), F.col(id_col).cast("long") == F.col("dropped"), "left_anti")

    kinds = docs.schema
    at, text_at = kinds.fieldNames().index(text_col), "__key__"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(how.words)
        for batch in parts(batches, at):
            keys = [digest(shingles(x or "")) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, text_at])

    rows = docs.mapInArrow(keyed, StructType([*kinds.fields, StructField(text_at, BinaryType())]))
    alone = rows.join(sent(named.select(F.col("key").alias(text_at))), text_at, "left_anti")
    chosen = rows.join(sent(keep.select(F.col("key").alias(text_at), F.col("id").alias("__id__"))), text_at).where(F.col(id_col).cast("long").eqNullSafe(F.col("__id__")))
    one = chosen.groupBy(text_at).agg(F.min_by(F.struct(*docs.columns), F.col(text_col)).alias("__row__"))
    return alone.select(*docs.columns).unionByName(one.select("__row__.*"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


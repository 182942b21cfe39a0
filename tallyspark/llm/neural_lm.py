"""Language-model scores: a log-bilinear model, trained in numpy with noise-contrastive estimation.

The corpus is read once into blocks: distinct words, their training counts, and each document as word numbers. Word
counts are summed over all blocks. The most frequent words, as many as a multiple of the root of all tokens, are the model's
vocabulary; one symbol stands for all others, which share its probability by their counts. A word's probability is its
class's, given the two words before it, times its own within the class; classes are as many as the root of the vocabulary, of
about equal weight, so both parts are normalised exactly by small matrix products. Each round, every block trains the model
in one pass over all tokens of its own training documents, from the same start and with new AdaGrad sums, and the blocks'
parameters are averaged by the tokens that they have seen; so more blocks make the average better, but no block's steps more.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import parts, table, written

OTHER, END = 0, 1
#: Scores that are made at once, so that they stay in a core's cache.
CELLS = 1 << 16
BLOCK = "block long, ids array<long>, lengths array<int>, held array<boolean>, runs binary, words array<binary>, train array<long>"


@dataclass(frozen=True)
class Settings:
    """Words of the vocabulary to the root of all tokens, dimensions, noise classes of a step and noise words of a class in
    it, most triples of a step, rounds, rate, about the most tokens of a step; rows of a layer; sizes of blocks, and of slices of the model."""

    spread: float = 2.0
    width: int = 16
    noise: int = 32
    inner: int = 8
    batch: int = 4096
    rounds: int = 1
    rate: float = 0.5
    tokens_a_step: int = 4096
    lanes: int = 32
    block_chars: int = 8 << 20
    slice: int = 1 << 14
    parts: int = 32


@dataclass
class Vocabulary:
    """Words' numbers, and all numbers' shares of the training tokens; those of a class stand together, in order of weight."""

    frequent: dict[bytes, int]
    unigram: np.ndarray

    @cached_property
    def listed(self) -> pa.Array:
        return pa.array(list(self.frequent), pa.binary())

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's number, or OTHER."""
        at = pc.index_in(words, self.listed).fill_null(-1).to_numpy()
        return np.append(np.fromiter(self.frequent.values(), np.int32, len(self.frequent)), np.int32(OTHER))[at]

    @cached_property
    def of_class(self) -> np.ndarray:
        """The class of each number: OTHER and END have their own."""
        v = len(self.unigram)
        before = np.cumsum(self.unigram[2:]) - self.unigram[2:]
        total = max(self.unigram[2:].sum(), 1e-300)
        _, at = np.unique((before / total * ceil(v**0.5)).astype(np.int64), return_inverse=True)
        return np.concatenate([[0, 1], at + 2]).astype(np.int32)

    @cached_property
    def starts(self) -> np.ndarray:
        """The first number of each class, and one more."""
        return np.searchsorted(self.of_class, np.arange(self.of_class[-1] + 2))

    @cached_property
    def by_class(self) -> np.ndarray:
        return np.bincount(self.of_class, self.unigram)

    @cached_property
    def within(self) -> np.ndarray:
        """Each number's share of its class."""
        return self.unigram / self.by_class[self.of_class]

    @cached_property
    def sums(self) -> np.ndarray:
        """within, summed up over all numbers: it grows by one from class to class."""
        return np.cumsum(self.within)

    @cached_property
    def before(self) -> np.ndarray:
        """What sums is before each class."""
        return np.append(0, self.sums)[self.starts[:-1]]


NAMES = ("r", "t", "b", "tc", "bc", "c1", "c2")


@dataclass
class Model:
    """Words' context vectors r, target vectors t and biases b; classes' tc and bc; c1 and c2 turn the last and the last but
    one word's vectors."""

    r: np.ndarray
    t: np.ndarray
    b: np.ndarray
    tc: np.ndarray
    bc: np.ndarray
    c1: np.ndarray
    c2: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in NAMES]).astype(np.float32)

    @staticmethod
    def of(flat: np.ndarray, words: Vocabulary, d: int) -> Model:
        v, c = len(words.unigram), len(words.by_class)
        shapes = ((v, d), (v, d), (v,), (c, d), (c,), (d, d), (d, d))
        cut = np.split(flat.astype(np.float32), np.cumsum([np.prod(x) for x in shapes[:-1]]))
        return Model(*(x.reshape(n) for x, n in zip(cut, shapes, strict=True)))

    @staticmethod
    def start(words: Vocabulary, d: int) -> Model:
        g = np.random.default_rng(7)
        small = lambda n: (0.05 * g.standard_normal((n, d))).astype(np.float32)
        v, c, log = len(words.unigram), len(words.by_class), lambda x: np.log(x).astype(np.float32)
        return Model(small(v), small(v), log(words.within), small(c), log(words.by_class), np.eye(d, dtype=np.float32), 0.5 * np.eye(d, dtype=np.float32))

    def predicted(self, w2: np.ndarray, w1: np.ndarray) -> np.ndarray:
        return self.r[w1] @ self.c1 + self.r[w2] @ self.c2

    def log_probability(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray, words: Vocabulary) -> np.ndarray:
        """Natural log of the normalised probability of each w after w2 w1. Equal triples are worked out once."""
        first, at, of, _ = grouped(w2, w1, w)
        begins = np.flatnonzero(np.diff(of, prepend=-1))
        q = self.predicted(w2[first[begins]], w1[first[begins]])
        w = w[first]
        k = words.of_class[w]
        of_class = np.zeros(len(q))
        step = max(CELLS // len(self.bc), 1)
        for a in range(0, len(q), step):
            of_class[a : a + step] = log_sum(q[a : a + step] @ self.tc.T + self.bc)
        out = np.zeros(len(w))
        for a in range(0, len(w), 1 << 18):
            x = slice(a, a + (1 << 18))
            out[x] = np.einsum("ij,ij->i", q[of[x]], self.tc[k[x]]) + self.bc[k[x]] - of_class[of[x]]
        order = places(k)
        cuts = np.searchsorted(k[order], np.arange(len(words.by_class) + 1))
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            first, after = words.starts[c : c + 2]
            if after - first < 2:
                continue
            t, b, step = np.ascontiguousarray(self.t[first:after].T), self.b[first:after], max(CELLS // (after - first), 1)
            for a in range(cuts[c], cuts[c + 1], step):
                rows = order[a : min(a + step, cuts[c + 1])]
                s = q[of[rows]] @ t
                s += b
                own = s[np.arange(len(rows)), w[rows] - first]
                out[rows] += own - log_sum(s)
        return out[at]


def log_sum(s: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; s is overwritten."""
    top = s.max(axis=1)
    s -= top[:, None]
    return top + np.log(np.exp(s, out=s).sum(axis=1))


def places(numbers: np.ndarray) -> np.ndarray:
    """Stable order of non-negative numbers, by 16 bits at a time, which numpy sorts by radix."""
    order = np.argsort((numbers & 0xFFFF).astype(np.uint16), kind="stable")
    most = int(numbers.max()) if len(numbers) else 0
    for shift in range(16, most.bit_length(), 16):
        order = order[np.argsort((numbers[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def grouped(w2: np.ndarray, w1: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct triples in order: the place of one, each row's triple, each triple's context by number, and how many there are."""
    order = places(w)
    order = order[places(w1[order])]
    order = order[places(w2[order])]
    a, b, c = w2[order], w1[order], w[order]
    differs = np.ones(len(order), bool)
    differs[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    context = np.cumsum(differs) - 1
    differs[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(differs)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(differs) - 1
    return order[starts], at, context[starts], np.diff(starts, append=len(order))


def sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(1, x, out=x)


def summed(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sum of each one's grads."""
    order = places(rows)
    there = rows[order]
    first = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]]))
    return there[first], np.add.reduceat(grads[order], first, axis=0)


def numbered(w2: np.ndarray, w1: np.ndarray, w: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct triples in order, how often each is there, and the distinct contexts w2 * v + w1. A triple is its context's place
    times v, plus w: of a block's tokens there are few contexts, so it is within a long for any vocabulary."""
    first, _, of, counts = grouped(w2, w1, w)
    begins = first[np.flatnonzero(np.diff(of, prepend=-1))]
    return of * v + w[first], counts, w2[begins].astype(np.int64) * v + w1[begins]


def words_of(triples: np.ndarray, v: int, contexts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """w2, w1 and w of numbered triples; without contexts, a context stands for itself."""
    before = triples // v if contexts is None else contexts[triples // v]
    return before // v, before % v, triples % v


def trained(model: Model, triples: np.ndarray, weights: np.ndarray, words: Vocabulary, how: Settings, seed: int, contexts: np.ndarray | None = None) -> Model:
    """Noise-contrastive estimation with AdaGrad: one pass over all triples (see words_of) in shuffled steps.

    Every triple is met with its whole weight, its count; one heavier than the mean is dealt to several steps in parts.
    A step takes about as many parts as any other, at most how.batch of them and about how.tokens_a_step tokens. A class is
    told from noise classes, and a word from noise words of its class; of a large model, a step changes only what it meets.
    """
    g, v = np.random.default_rng(seed), len(words.unigram)
    m = Model(*(getattr(model, x).copy() for x in NAMES))
    d = m.r.shape[1]
    into = {"r": m.r, "t": np.column_stack([m.t, m.b]), "tc": np.column_stack([m.tc, m.bc]), "c1": m.c1, "c2": m.c2}
    sums = {x: np.full(y.shape, 1e-2, np.float32) for x, y in into.items()}
    total = int(weights.sum())
    pieces = -(-weights // -(-total // len(weights)))
    part, share = np.repeat(np.arange(len(triples)), pieces), np.repeat(weights / pieces, pieces).astype(np.float32)
    order = g.permutation(len(part))
    steps = max(-(-len(part) // how.batch), min(-(-total // how.tokens_a_step), len(part)))
    of_noise, shift_c = np.cumsum(words.by_class), np.log(how.noise * words.by_class).astype(np.float32)
    shift_w, many = np.log(how.inner * words.within).astype(np.float32), np.diff(words.starts) > 1

    def move(name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        grad = grad * np.float32(steps / total)
        so_far = sums[name][rows] + grad * grad
        sums[name][rows] = so_far
        into[name][rows] += how.rate * grad / np.sqrt(so_far)

    for step in np.array_split(order, steps):
        drawn = triples[part[step]]
        k = words.of_class[drawn % v]
        by_class = places(k)
        drawn, weight, k = drawn[by_class], share[step][by_class], k[by_class]
        w2, w1, w = words_of(drawn, v, contexts)
        q = np.ones((len(w), d + 1), np.float32)  # the last component meets the biases
        q[:, :-1] = m.predicted(w2, w1)
        noise = np.searchsorted(of_noise, g.random(how.noise) * of_noise[-1], "right").clip(0, len(of_noise) - 1)
        own, mate, noisy = into["tc"][k], into["t"][w], into["tc"][noise]
        real = weight * (1 - sigmoid(np.einsum("ij,ij->i", q, own) - shift_c[k]))
        false = -weight[:, None] * sigmoid(q @ noisy.T - shift_c[noise])
        inner = np.where(many[k], weight, 0) * (1 - sigmoid(np.einsum("ij,ij->i", q, mate) - shift_w[w]))
        own *= real[:, None]
        mate *= inner[:, None]
        own += mate
        own += false @ noisy
        to_q = own[:, :-1]
        at, grad = summed(np.concatenate([k, noise]), np.concatenate([real[:, None] * q, false.T @ q]))
        move("tc", grad, at)
        rows, to_t = [w], [inner[:, None] * q]
        there, first, size = np.unique(k, return_index=True, return_counts=True)
        there, first, size = (x[many[there]] for x in (there, first, size))
        if len(there):  # layers of how.lanes rows of a class, the last one of each filled up
            dice = words.before[there][:, None] + g.random((len(there), how.inner))
            picked = np.searchsorted(words.sums, dice, "right").clip(words.starts[there][:, None], words.starts[there + 1][:, None] - 1)
            layers = -(-size // how.lanes)
            begins = np.cumsum(layers) - layers
            of = np.repeat(np.arange(len(there)), layers)
            lane = (np.arange(len(of)) - begins[of])[:, None] * how.lanes + np.arange(how.lanes)
            mine = lane < size[of][:, None]
            x = np.where(mine, first[of][:, None] + lane, 0)
            qx, t = q[x], into["t"][picked][of]
            false = np.where(mine, -weight[x], 0)[:, :, None] * sigmoid(qx @ t.transpose(0, 2, 1) - shift_w[picked][of][:, None, :])
            to_q[x[mine]] += (false @ t)[mine][:, :-1]
            rows.append(picked.ravel())
            to_t.append(np.add.reduceat(false.transpose(0, 2, 1) @ qx, begins, axis=0).reshape(-1, d + 1))
        both = np.concatenate([w1, w2]), np.concatenate([to_q @ m.c1.T, to_q @ m.c2.T])
        c1, c2 = m.r[w1].T @ to_q, m.r[w2].T @ to_q
        at, grad = summed(np.concatenate(rows), np.concatenate(to_t))
        move("t", grad, at)
        at, grad = summed(*both)
        move("r", grad, at)
        move("c1", c1)
        move("c2", c2)
    m.t, m.b, m.tc, m.bc = into["t"][:, :-1], into["t"][:, -1], into["tc"][:, :-1], into["tc"][:, -1]
    return m


def packed(numbers: np.ndarray) -> bytes:
    """Numbers deflated byte by byte: first all low bytes, last all high ones, which are mostly zero."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def ints(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def corpus_blocks(docs: DataFrame, how: Settings, id_col: str, text_col: str, held_out) -> DataFrame:
    """Rows of BLOCK. Words are lower-cased (A-Z) and cut at ASCII white space; train counts those of documents not held out."""

    def block(number: int, ids: list, texts: list[str]) -> pa.RecordBatch:
        of: defaultdict[bytes, int] = defaultdict(count().__next__)
        held = [held_out(i) for i in ids]
        runs = [np.array([*map(of.__getitem__, x.encode().lower().split())], np.int32) for x in texts]
        own = [r for r, h in zip(runs, held, strict=True) if not h]
        train = np.bincount(np.concatenate(own), minlength=len(of)) if own else np.zeros(len(of), np.int64)
        one = lambda x: pa.array([x])
        return pa.RecordBatch.from_arrays([one(number), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(r) for r in runs]], pa.list_(pa.int32())), pa.array([held], pa.list_(pa.bool_())), one(packed(np.concatenate(runs))), pa.array([list(of)], pa.list_(pa.binary())), pa.array([train], pa.list_(pa.int64()))], [x.split()[0] for x in BLOCK.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, texts, size = [], [], 0
        for batch in parts(batches):
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(x or "")
                size += len(x or "")
                if size >= how.block_chars:
                    yield block(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield block(number, ids, texts)

    return written(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(read, BLOCK), "blocks")


def unpacked(batch: pa.RecordBatch, row: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    ids, lengths, held, runs, words = (batch.column(k)[row] for k in range(1, 6))
    return ids.values, lengths.values.to_numpy(), held.values.to_numpy(zero_copy_only=False).astype(bool), ints(runs.as_py()), words.values


def sequences(lengths: np.ndarray, runs: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, w2, w1, w of every token, an end after each document, and its place in runs (-1: an end)."""
    ends = np.cumsum(lengths.astype(np.int64) + 1) - 1
    total = int(ends[-1]) + 1 if len(ends) else 0
    place = np.full(total, -1, np.int32)
    is_word = np.ones(total, bool)
    is_word[ends] = False
    place[is_word] = np.arange(len(runs))
    w = np.full(total, END, np.int32)
    w[is_word] = of[runs]
    document = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    starts = ends - lengths
    w1, w2 = np.full(total, END, np.int32), np.full(total, END, np.int32)
    w1[1:], w2[2:] = w[:-1], w[:-2]
    w1[starts] = END  # what stands before a document is its end symbol
    w2[starts] = END
    w2[starts[lengths > 0] + 1] = END
    return document, w2, w1, w, place


@dataclass
class Corpus:
    """What is gathered from the training documents: their totals and the model's vocabulary with its training counts, and
    counts, which gives each other word of each block (of, place) its training count c. others and kinds: tokens and
    distinct words outside the vocabulary."""

    blocks: DataFrame
    counts: DataFrame
    tokens: int
    distinct: int
    documents: int
    words: Vocabulary
    known: np.ndarray
    others: int
    kinds: int


def gathered(docs: DataFrame, how: Settings, id_col: str, text_col: str, held_out) -> Corpus:
    """Counts are summed by word after each task has summed its own. What comes back to the blocks are the counts of words
    outside the vocabulary: each is rarer than the vocabulary's last word, so none of them fills a task by itself."""
    blocks = corpus_blocks(docs, how, id_col, text_col, held_out)
    placed = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("place", "x")).select("block", "place", F.col("x.words").alias("word"), F.col("x.train").alias("train"))
    totals = written(placed.where("train > 0").groupBy("word").agg(F.sum("train").alias("c")), "totals")
    total = totals.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    ends = blocks.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)).alias("n")).first().n
    size = ceil(how.spread * isqrt(total.tokens + ends))
    top = totals.orderBy(F.desc("c"), "word").limit(size).collect()  # the vocabulary, a multiple of the root of all tokens
    known = np.array([0, ends, *(r.c for r in top)], np.int64)
    others = total.tokens - int(known[2:].sum())
    unigram = known + 1.0
    unigram[OTHER] += others
    listed = docs.sparkSession.createDataFrame([(r.word,) for r in top], "word binary")
    counts = placed.select("block", "place", "word").join(F.broadcast(listed), "word", "left_anti").join(totals, "word").select(F.col("block").alias("of"), "place", "c")
    words = Vocabulary({bytes(r.word): k for k, r in enumerate(top, 2)}, unigram / unigram.sum())
    return Corpus(blocks, counts, total.tokens + ends, total.distinct + (ends > 0), ends, words, known, others, total.distinct - len(top))


def train(corpus: Corpus, how: Settings) -> Model:
    """Rounds of training on every block and averaging. Tasks send slices of their parameters, which are summed by slice, so
    that the driver gets one model."""
    spark, d = corpus.blocks.sparkSession, how.width
    model, held = Model.start(corpus.words, d), spark.sparkContext.broadcast(corpus.words)

    for turn in range(how.rounds):
        now = spark.sparkContext.broadcast(model.flat())

        def learn(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            words, total, seen = held.value, 0, 0
            mine, v = Model.of(now.value, words, d), len(words.unigram)
            for batch in batches:
                for row in range(len(batch)):
                    _, lengths, held_out, runs, said = unpacked(batch, row)
                    of = words.numbers(said)
                    document, w2, w1, w, _ = sequences(lengths, runs, of)
                    use = ~held_out[document]
                    if not use.any():
                        continue
                    triples, weights, contexts = numbered(w2[use], w1[use], w[use], v)
                    n = int(weights.sum())
                    total = total + n * trained(mine, triples, weights, words, how, turn * 7919 + batch.column(0)[row].as_py() % 100_003, contexts).flat().astype(np.float64)
                    seen += n
            if seen:
                cut = [(total[a : a + how.slice] / seen).astype(np.float32).tobytes() for a in range(0, len(total), how.slice)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut)), pa.int32()), pa.array(np.full(len(cut), seen)), pa.array(cut, pa.binary())], ["at", "n", "mean"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = {}, {}
            for batch in batches:
                for at, n, mean in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    total[at] = total.get(at, 0) + n * np.frombuffer(mean, np.float32).astype(np.float64)
                    seen[at] = seen.get(at, 0) + n
            out = [(total[at] / seen[at]).astype(np.float32).tobytes() for at in total]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(seen.values()), pa.int64()), pa.array(out, pa.binary())], ["at", "n", "mean"])

        kinds = "at int, n long, mean binary"
        rows = corpus.blocks.mapInArrow(learn, kinds).repartition(how.parts, "at").mapInArrow(add, kinds).collect()  # one model
        if rows:
            model = Model.of(np.concatenate([np.frombuffer(r.mean, np.float32) for r in sorted(rows, key=lambda r: r["at"])]), corpus.words, d)
    return model


def score(corpus: Corpus, model: Model, how: Settings, id_col: str = "doc_id") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    The counts of a block's rarer words come back to it by its number; the words of one block are never more than its text.
    """
    spark, d = corpus.blocks.sparkSession, how.width
    n, distinct, ends, others, kinds = corpus.tokens, corpus.distinct, corpus.documents, corpus.others, corpus.kinds
    held_words, flat, known = (spark.sparkContext.broadcast(x) for x in (corpus.words, model.flat(), corpus.known))

    def judge(block: pa.Table, counts: pa.Table) -> pa.Table:
        vocabulary = held_words.value
        m = Model.of(flat.value, vocabulary, d)
        out = []
        for batch in block.to_batches():
            for row in range(len(batch)):
                ids, lengths, held, runs, words = unpacked(batch, row)
                of = vocabulary.numbers(words)
                c = np.append(known.value[of], ends)
                c[counts.column("place").to_numpy()] = counts.column("c").to_numpy()
                document, w2, w1, w, place = sequences(lengths, runs, of)
                mine = np.full(len(w), -1, np.int32)
                mine[place >= 0] = runs
                own = m.log_probability(w2, w1, w, vocabulary) / np.log(10)
                own += np.where(w == OTHER, np.log10((c + 1) / (others + kinds + 1))[mine], 0)
                size = len(ids)
                sums = lambda x, document=document, size=size: np.bincount(document, x, size)
                base = sums(np.log10((c + 1) / (n + distinct + 1))[mine])
                out.append((ids, pa.array(held), pa.array(lengths.astype(np.int64) + 1), pa.array(sums((c > 0)[mine]).astype(np.int64)), pa.array(np.full(size, n)), pa.array(base), pa.array(sums(own))))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(list(x), schema=result) for x in out], result)

    result = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    kinds_of = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return corpus.blocks.drop("train").groupBy("block").cogroup(corpus.counts.groupBy("of")).applyInArrow(judge, kinds_of).withColumnRenamed("id", id_col)


def seventh(doc_id: int | None) -> bool:
    """Held out: the CRC-32 of the id as text leaves 2 when divided by 7. A null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def lm_scores(docs: DataFrame, how: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", held_out=seventh) -> DataFrame:
    """Train on documents that aren't held out and score all rows, whole texts.

    Tokens are words and one end; a null or empty text has the end alone. Ids are cast to long; they may be null or
    repeat (each row is scored). Where no document is left to train on, the model is uniform over its symbols and all
    words share one probability. An empty table gives none; other columns are ignored.
    """
    how = how or Settings()
    corpus = gathered(docs, how, id_col, text_col, held_out)
    return score(corpus, train(corpus, how), how, id_col)


def op8_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))

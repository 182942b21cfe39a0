"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Each source has a target of words, so each of its documents the same number of expected copies: whole copies that all get, and a
fractional one. Documents are dealt to blocks by a hash of what they are. In a block, from the longest document on, a document
is paired with the rest of the block, whose fractions are equal and move together: words pass between the two at random, fairly,
until the document's fraction (or that of the whole rest) is 0 or 1. So a block's words stay what they were, and at most one
document, as a rule among its shortest, keeps a fraction. These residuals go on to blocks of residuals, where they are paired one
with another, level by level, until each source has one; that one is drawn.

Every draw is a hash of the document it is for, so that reruns agree however the rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import looked_up, table, written

#: Documents of a block, on average.
BLOCK = 256
WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    """Words of a text, null having none. Each becomes one letter, so that a long text isn't held as a list of words."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WORD, "x"), " \t\n\v\f\r", "")).cast("long")


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def draw(seed: int, *of: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and on what it is for."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(float(1 << 53))


def weighed(totals: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: of totals (source, source_size), a row for each source.

    Sources in code point order, null last, get the weights in turn. Places are counted in ranges of sources, so that no
    task has all of them. A target is share x all sizes in proportion to the weight, and at most ``most`` times its source's size; what
    is beyond that is reshared among the others by weight until none is above.
    """
    ranged = written(totals.repartitionByRange(F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id()), "sources")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))) - 1 + F.col("before")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(place, F.lit(len(weights))).cast("int"))
    sources = written(ranged.join(F.broadcast(before), "range").select("source", "source_size", weight.alias("weight")), "weighed")

    limit = F.col("source_size") * most
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rest, open_weight = (whole["size"] or 0) * share, float(whole["weight"] or 0)
    while True:
        fair = F.lit(rest) * F.col("weight") / F.lit(open_weight or 1.0)
        at_limit = sources.where(fair > limit).agg(F.sum(limit).alias("size"), F.sum("weight").alias("weight")).first()
        now = (whole["size"] or 0) * share - (at_limit["size"] or 0), float((whole["weight"] or 0) - (at_limit["weight"] or 0))
        if now == (rest, open_weight):
            return sources.select("source", "source_size", F.least(fair, limit).alias("target"))
        rest, open_weight = now


def rounded(seed: int, items: Column, rests: Column) -> Column:
    """Fractions of a block's items, the longest first, of which one at most is still between 0 and 1.

    items: (size, fraction, u), all fractions equal at first. rests: for each the words of the items after it.
    """

    def step(state: Column, it: Column) -> Column:
        s, rest, f = it["size"], it["rest"], state["f"]
        gain = F.least((1.0 - f) * s, f * rest)  # words that the rest can give to the item
        loss = F.least(f * s, (1.0 - f) * rest)

        def moved(m: Column) -> Column:
            gain, loss = m["gain"], m["loss"]
            up = it["u"] * (gain + loss) < loss
            mine = F.when(gain + loss <= 0, f).when(up, F.when(gain >= (1.0 - f) * s, F.lit(1.0)).otherwise(f + gain / s)).otherwise(F.when(loss >= f * s, F.lit(0.0)).otherwise(f - loss / s))
            theirs = F.when(rest <= 0, f).when(gain + loss <= 0, f).when(up, F.when(gain >= f * rest, F.lit(0.0)).otherwise(f - gain / rest)).otherwise(F.when(loss >= (1.0 - f) * rest, F.lit(1.0)).otherwise(f + loss / rest))
            held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
            return F.struct(held(theirs).alias("f"), F.concat(state["done"], F.array(held(mine))).alias("done"))

        return let(F.struct(gain.alias("gain"), loss.alias("loss")), moved)

    start = F.struct(items[0]["fraction"].alias("f"), F.array().cast("array<double>").alias("done"))
    zipped = F.zip_with(items, rests, lambda a, r: F.struct(a["size"].alias("size"), a["u"].alias("u"), r.alias("rest")))
    return F.aggregate(zipped, start, step, lambda s: s["done"])


def paired(items: Column) -> Column:
    """Fractions of items (size, fraction, u), paired one after another; of them one at most is still between 0 and 1.

    Returned as (place, fraction), in the order in which they were settled.
    """
    entry = lambda at, f: F.array(F.struct(at.alias("place"), f.alias("fraction")))

    def step(state: Column, it: Column) -> Column:
        a, x, b, y = state["size"], state["words"], it["size"], it["fraction"] * it["size"]
        gain, loss = F.least(a - x, y), F.least(x, b - y)  # words that the item can give to the one held, and take from it

        def moved(m: Column) -> Column:
            gain, loss = m["gain"], m["loss"]
            up = (it["u"] * (gain + loss) < loss) | (gain + loss <= 0)
            full = F.when(up, gain >= a - x).otherwise(loss >= x)  # whether the one held is settled, else the item is
            settled = F.when(full, F.when(up & (gain >= a - x) & (x + gain > 0), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.when(up, F.lit(0.0)).otherwise(F.lit(1.0)))
            keep = F.when(full, F.when(up, y - gain).otherwise(y + loss)).otherwise(F.when(up, x + gain).otherwise(x - loss))
            size, place, out = F.when(full, b).otherwise(a), F.when(full, it["place"]).otherwise(state["place"]), F.when(full, state["place"]).otherwise(it["place"])
            return F.struct(place.alias("place"), size.alias("size"), F.greatest(F.lit(0.0), F.least(size, keep)).alias("words"), F.concat(state["done"], entry(out, settled)).alias("done"))

        return let(F.struct(gain.alias("gain"), loss.alias("loss")), moved)

    first = items[0]
    start = F.struct(first["place"].alias("place"), first["size"].alias("size"), (first["fraction"] * first["size"]).alias("words"), F.array().cast("array<struct<place:int,fraction:double>>").alias("done"))
    return F.aggregate(F.slice(items, 2, F.size(items) - 1), start, step, lambda s: F.concat(s["done"], entry(s["place"], s["words"] / s["size"])))


def blocks(rows: DataFrame, count: Column, seed: int) -> DataFrame:
    """source, block and items of rows, an item's place being that by size, the longest first."""
    item = F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(seed), "source", "doc_id", "size", "copy").alias("hash"), F.col("size").cast("double").alias("size"), "fraction", draw(seed + 1, "source", "doc_id", "size", "copy").alias("u"), "doc_id", "copy")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "doc_id", "size", "copy"), count))
    return dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(item)).alias("items"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies x size, in words) of every row of docs.

    A source's taken words differ from its target by less than the size of one of its documents, as a rule one of the shortest. A document is
    expected to be copied target / source_size times; it has that many copies rounded down or up. Null texts, and texts without a word,
    have size 0: they take nothing and get the whole copies alone. Null ids and sources count as values, the source null
    being one source; rows that repeat a document are documents each. An empty table gives no rows. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"))
    # rows equal in all three are interchangeable: they are counted, and told apart by a number
    sizes = written(named.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "sizes")
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("rows")).otherwise(0)).alias("documents"))
    totals = written(totals, "totals")
    targets = weighed(totals.select("source", "source_size"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    facts = totals.select(F.col("source").alias("_source"), "documents").join(targets, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    facts = written(facts.withColumn("whole", F.floor(rate)).withColumn("fraction", rate - F.floor(rate)), "targets")

    # a row repeated many times is told apart in two steps, so that no task makes all of its copies
    span = F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(4096).cast("long"))
    many = sizes.where("rows > 4096").withColumn("first", F.explode(span)).repartition("source", "doc_id", "size", "first").withColumn("last", F.least(F.col("first") + 4095, F.col("rows") - 1))
    few = sizes.where("rows <= 4096").withColumn("first", F.lit(0).cast("long")).withColumn("last", F.col("rows") - 1)
    each = few.unionByName(many).select("source", "doc_id", "size", F.explode(F.sequence("first", "last")).alias("copy"))
    rows = looked_up(each, facts, "source", F.struct("doc_id", "copy")).select("source", "doc_id", "size", "copy", "fraction", "documents")

    result = ["source", "doc_id", "size", "copy", "fraction"]
    open_ = (F.col("size") > 0) & (F.col("fraction") > 0)
    settled = [rows.where(~open_).select("source", "doc_id", "size", "copy", F.lit(0.0).alias("fraction"))]
    count = F.greatest(F.ceil(F.col("documents") / block), F.lit(1))
    first = blocks(rows.where(open_), count, seed)
    # words after each item, from the last one backwards
    after = F.aggregate(F.reverse("items"), F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("done")), lambda s, x: F.struct((s["sum"] + x["size"]).alias("sum"), F.concat(F.array(s["sum"]), s["done"]).alias("done")), lambda s: s["done"])
    done = first.withColumn("after", after).withColumn("done", rounded(seed, F.col("items"), F.col("after")))
    one = F.explode(F.arrays_zip("items", "done")).alias("x")
    level = written(done.select("source", one).select("source", F.col("x.items.doc_id").alias("doc_id"), F.col("x.items.size").cast("long").alias("size"), F.col("x.items.copy").alias("copy"), F.col("x.done").alias("fraction")), "rounded")

    left = facts.agg(F.max(F.ceil(F.col("documents") / block))).first()[0] or 0
    between = (F.col("fraction") > 0) & (F.col("fraction") < 1)
    depth = 1
    while left > 1:
        settled.append(level.where(~between))
        size = block**depth
        counted = looked_up(level.where(between), facts.select("source", "documents"), "source", F.struct("doc_id", "copy"))
        held = blocks(counted, F.greatest(F.ceil(F.col("documents") / size / block), F.lit(1)), seed + 3 * depth)
        with_place = F.transform("items", lambda x, i: x.withField("place", i.cast("int")))
        held = held.withColumn("items", with_place).select("source", "items", F.explode(paired(F.col("items"))).alias("x")).select("source", F.get("items", F.col("x.place")).alias("it"), F.col("x.fraction").alias("fraction"))
        level = written(held.select("source", F.col("it.doc_id").alias("doc_id"), F.col("it.size").cast("long").alias("size"), F.col("it.copy").alias("copy"), "fraction"), "residuals")
        left, depth = -(-left // block), depth + 1
    last = F.when(between, F.when(draw(seed - 1, "source", "doc_id", "size", "copy") < F.col("fraction"), 1.0).otherwise(0.0)).otherwise(F.col("fraction"))
    out = level.withColumn("fraction", last)
    for more in settled:
        out = out.unionByName(more.select(*result))
    copies = (F.col("whole") + F.col("fraction").cast("long")).cast("int")
    out = looked_up(out, facts.select("source", "source_size", "target", "whole"), "source", F.struct("doc_id", "copy"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

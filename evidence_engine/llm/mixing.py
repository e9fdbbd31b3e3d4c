"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document of a source wants target / source_size copies. The whole part is certain; the
fractional parts are rounded dependently: two documents meet, and mass in words moves at random from
one to the other until one of them is integral. Expectations stay what they were and the source's
words stay on target throughout. A block of some tens of documents is folded at a time and leaves one
fractional document; these meet in the next level of a reduction tree, up to one for a source, which
is rounded by its own probability.

What that last rounding leaves over or short is up to one document's words. So the larger documents of a source
are rounded first, and what they leave over or short is spread evenly over the probabilities of the smaller ones before
those are rounded, step by step. A source ends within about one of its smallest documents of its
target, unless one document holds more words than the smaller ones have room for. What is spread is zero on
average, so no document's expected number of copies moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, plain

FAN_IN = 32
#: Borders between the steps of a source: quantiles of its documents' words.
STEPS = (0.1, 0.5, 0.9)


def _numbered(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, w): the weight by the source's place in code point order, null last. The places come from a
    range-partitioned sort and the sizes of its partitions, so the sources never meet in one task."""
    per_source = keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ordered = keep(per_source.orderBy(F.col("source").isNull(), "source").withColumn("place", F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    parts = ordered.groupBy(part.alias("of")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = parts.select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("before") + inside, F.lit(len(weights))) + 1).cast("int"))
    return keep(ordered.join(F.broadcast(before), part == F.col("of")).select("source", "source_size", w.alias("w")), "weights")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, size) -> (source, source_size, target, p): targets share all words by weight; a target stops at `most`
    times its source's size and the excess is shared again. That is min(cap, level * weight) for one level, which
    rises from the uncapped one until it fits; sources once capped stay so."""
    s = _numbered(sizes, weights)
    cap = F.col("source_size").cast("double") * most
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = cap <= F.lit(level) * F.col("w")
        caps, open_w = s.agg(F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        if not open_w:
            break
        new = (total - caps) / open_w
        if new <= level * (1 + 1e-15):
            break
        level = new
    target = F.least(cap, F.lit(level) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("p"))


def _draw(*of):
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(2**53))


def _fold(items, seed):
    """Fold an array of (key, words, x) by pivotal steps -> (key, words, x) left fractional, if any, and
    the decided (key, words, bit). Items that are integral already are decided as they are."""
    none = F.struct(F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("words"), F.lit(None).cast("double").alias("x"))
    start = F.struct(none.alias("left"), F.array().cast("array<struct<key:long,words:double,bit:int>>").alias("done"))

    def decided(item, bit):
        return F.struct(item["key"].alias("key"), item["words"].alias("words"), bit.cast("int").alias("bit"))

    def step(acc, item):
        a, b = acc["left"], item
        down = F.least(a["x"] * a["words"], (1 - b["x"]) * b["words"])  # from a to b
        up = F.least((1 - a["x"]) * a["words"], b["x"] * b["words"])
        to_b = _draw(a["key"], b["key"], F.lit(seed)) * (down + up) < up
        # Which of the two became integral is known from the smaller bound, not from rounded sums.
        a_done = F.when(to_b, a["x"] * a["words"] <= (1 - b["x"]) * b["words"]).otherwise((1 - a["x"]) * a["words"] <= b["x"] * b["words"])
        ax = F.when(to_b, a["x"] - down / a["words"]).otherwise(a["x"] + up / a["words"])
        bx = F.when(to_b, b["x"] + down / b["words"]).otherwise(b["x"] - up / b["words"])
        left = F.when(a_done, F.struct(b["key"].alias("key"), b["words"].alias("words"), bx.alias("x"))).otherwise(F.struct(a["key"].alias("key"), a["words"].alias("words"), ax.alias("x")))
        gone = F.when(a_done, decided(a, ~to_b)).otherwise(decided(b, to_b))
        met = F.struct(left.alias("left"), F.array_append(acc["done"], gone).alias("done"))
        first = F.struct(F.struct(item["key"].alias("key"), item["words"].alias("words"), item["x"].alias("x")).alias("left"), acc["done"].alias("done"))
        sure = F.struct(acc["left"].alias("left"), F.array_append(acc["done"], decided(item, item["x"] >= 1)).alias("done"))
        return F.when((item["x"] <= 0) | (item["x"] >= 1), sure).when(a["key"].isNull(), first).otherwise(met)

    return F.aggregate(items, start, step)


def row_key():
    """What tells documents apart: 64 bits of doc_id, source and text, nulls unlike any value."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", F.col("text").isNull(), "text")


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """docs (doc_id, text, source) -> one row per row: doc_id, size, source_size, target, copies, taken, key, source.

    Size: words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0). Sources in code point order, null last, weigh
    `weights`, repeating, and share 100% of all words; a target stops at `most` times its source's
    words. copies is floor or ceil of target / source_size, taken is copies * size. Draws are hashes of the
    documents, so reruns agree whatever the partitions. Documents without words: copies 0. Rows equal
    in doc_id, source and text are decided as one. An empty table gives an empty result; null ids and
    extra columns are fine.
    """
    docs = plain(docs, "doc_id", "text", "source")
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    sizes = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), row_key().alias("key")), "sizes")
    # Small beside the documents: one row a source. Spark broadcasts it where its file is small, and splits hot sources where not.
    targets = keep(source_targets(sizes, weights, most), "targets")
    known = keep(sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of"), "known")
    items = known.withColumn("x", F.col("p") - F.floor("p")).filter("size > 0 and x > 0")
    items = items.groupBy("source", "key").agg((F.first("size") * F.count(F.lit(1))).cast("double").alias("words"), F.first("x").alias("x"))
    bits = _rounded(items, seed).withColumnRenamed("key", "k")
    tree = _tree("source")
    out = known.join(bits, (F.col("key") == F.col("k")) & (tree == F.col("tree")), "left")
    copies = F.when(F.col("size") > 0, F.floor("p") + F.coalesce("bit", F.lit(0))).otherwise(0).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "key", "source")


def _tree(source):
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def _rounded(items: DataFrame, seed: int) -> DataFrame:
    """(source, key, words, x) -> (tree, key, bit), a tree for each source and step."""
    items = keep(items.select(_tree("source").alias("tree"), "key", "words", "x"), "fractions")
    borders = keep(items.groupBy(F.col("tree").alias("of")).agg(F.percentile_approx("words", list(STEPS)).alias("at")), "borders")
    step = sum((F.when(F.col("words") > F.element_at("at", i + 1), 1).otherwise(0) for i in range(len(STEPS))), F.lit(0))
    items = keep(items.join(borders, F.col("tree") == F.col("of")).select("tree", "key", "words", "x", step.alias("step")), "steps")
    sums = keep(items.groupBy(F.col("tree").alias("of"), F.col("step").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("mass"), F.sum(F.col("words") * F.col("x")).alias("wanted")), "sums")
    largest = {r["at"]: r.n for r in sums.groupBy("at").agg(F.max("n").alias("n")).collect()}  # a row a step
    done, short = None, None
    for turn, step in enumerate(sorted(largest, reverse=True)):
        level, own = items.filter(F.col("step") == step).drop("step"), sums.filter(F.col("at") == step).drop("at", "n")
        if short is not None:
            # Every x of a source is the same, so a step bears the whole shift or as much of it as 0 and 1 leave room for.
            more = keep(own.join(short, F.col("of") == F.col("late")).select("of", (F.col("short") / F.col("mass")).alias("more")), "spread")
            level = level.join(more, F.col("tree") == F.col("of"), "left").select("tree", "key", "words", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x") + F.coalesce("more", F.lit(0.0)))).alias("x"))
        bits = _decided(level, largest[step], seed + 100 * turn)
        done = bits if done is None else done.unionByName(bits)
        # What the step leaves over or short of what it and the steps before it wanted.
        took = bits.groupBy("tree").agg((-F.sum(F.col("words") * F.col("bit"))).alias("gap"))
        gap = took.unionByName(own.select(F.col("of").alias("tree"), F.col("wanted").alias("gap")))
        if short is not None:
            gap = gap.unionByName(short.select(F.col("late").alias("tree"), F.col("short").alias("gap")))
        if step:
            short = keep(gap.groupBy(F.col("tree").alias("late")).agg(F.sum("gap").alias("short")), "short")
    if done is None:
        return items.select("tree", "key", F.lit(0).alias("bit"))
    return done.select("tree", "key", "bit")


def _decided(level: DataFrame, n: int, seed: int) -> DataFrame:
    """(tree, key, words, x), at most n a tree -> (tree, key, words, bit) by the reduction tree."""
    turn, done = 0, None
    while True:
        blocks = -(-n // FAN_IN)
        block = F.pmod(F.xxhash64("key", F.lit(seed + turn)), F.lit(blocks).cast("long"))
        folded = level.withColumn("block", block).groupBy("tree", "block").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("key", F.lit(seed)).alias("h"), "key", "words", "x"))).alias("all"))
        folded = keep(folded.select("tree", _fold(F.col("all"), seed + turn).alias("f")), "folded")
        out = folded.select("tree", F.inline("f.done"))
        done = out if done is None else done.unionByName(out)
        level = folded.filter("f.left.key is not null").select("tree", F.col("f.left.key").alias("key"), F.col("f.left.words").alias("words"), F.col("f.left.x").alias("x"))
        if blocks == 1:
            return done.unionByName(level.select("tree", "key", "words", (_draw("key", F.lit(seed)) < F.col("x")).cast("int").alias("bit")))
        n, turn = blocks, turn + 1

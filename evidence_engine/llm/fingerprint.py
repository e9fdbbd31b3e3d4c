"""Canonical exact digests, the next document in id order, and groups of equal canonical texts.

Everything here is DataFrame functions. A text is normalised (NFKC, full case folding, NFKC again),
its white space is folded, and two xxhash64 values make a 128-bit digest. Texts with one digest are
then compared byte by byte, so a group never holds two different canonical texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, plain

#: Bits of the map that says which digests occur twice: 64 buckets of 4 KB, whatever the input.
_MAP_BUCKETS = 64


def canonical(text):
    """NFKC, case folding, NFKC, then each run of white space as one space, none at the ends.

    The normaliser and the folding are the JVM's Unicode library, called by SQL's `reflect`."""

    def compose(x):
        return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    def fold(x):
        return F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))

    return F.trim(F.regexp_replace(compose(fold(compose(text))), r"(?U)\s+", " "))


def digest(canon):
    """32 hex digits of two chained xxhash64 values."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), canon)), 16, "0")))


def _blocks(docs: DataFrame) -> DataFrame:
    """docs with b, s: blocks in doc_id order of about a thousand rows. 255 quantiles cut the ids and
    each cut is divided evenly; equal ids stay together and null ids come last."""
    n, cuts = docs.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", [i / 256 for i in range(257)], 10_000)).first()
    cuts = sorted(set(cuts or [0]))
    lows = cuts + [2**63 - 1] * (512 - len(cuts))
    parts = max(1, -(-(n or 0) // (256 * 1000)))
    low_of, at = F.array(*[F.lit(c).cast("long") for c in lows]), F.lit(0)
    at = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(9))]), F.lit(0), lambda p, step: F.when(F.element_at(low_of, p + step) <= F.col("doc_id"), p + step).otherwise(p))
    docs = docs.withColumn("b", F.when(F.col("doc_id").isNull(), F.lit(1000)).otherwise(at))
    low, high = F.element_at(low_of, F.greatest("b", F.lit(1))).cast("double"), F.element_at(low_of, F.least(F.col("b") + 1, F.lit(len(cuts)))).cast("double")
    inside = F.floor((F.col("doc_id").cast("double") - low) / (high - low + 1) * parts)
    return docs.withColumn("s", F.when(F.col("b") == 1000, F.pmod(F.xxhash64("text"), F.lit(parts))).otherwise(F.greatest(F.lit(0), F.least(F.lit(parts - 1), inside))).cast("long"))


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """docs (doc_id, text, carried...) plus next_<column>: the row of the next larger doc_id; the last
    row's next is the first row. Equal ids follow each other by text, null ids come last.

    Blocks of consecutive ids are ordered on their own. Each gets one more row, the first of the block
    after it, so no row needs a second shuffle and no task sees more than its blocks."""
    placed = _blocks(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    firsts = keep(placed.groupBy("b", "s").agg(F.min(order).alias("first")), "firsts")
    cut = firsts.groupBy("b").agg(F.min("first").alias("head"))
    every = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = cut.select(F.col("b").alias("cut"), F.coalesce(F.lead("head").over(Window.orderBy("b")), F.first("head").over(every)).alias("over"))
    after = firsts.join(F.broadcast(cut), F.col("b") == F.col("cut"))  # at most 513 rows
    after = keep(after.select("b", "s", F.coalesce(F.lead("first").over(Window.partitionBy("b").orderBy("s")), "over").alias("first")), "borders")
    border = after.select("b", "s", F.col("first.doc_id").alias("border_id"), F.col("first.col3").alias("border_hash"))
    names = ["doc_id", "text", *carried]
    guests = docs.withColumn("h", F.xxhash64("text")).join(border, F.col("doc_id").eqNullSafe(F.col("border_id")) & (F.col("h") == F.col("border_hash")))
    guests = guests.groupBy("b", "s").agg(F.first(F.struct(*names)).alias("g")).select("b", "s", *[F.col(f"g.{c}").alias(c) for c in names], F.lit(1).alias("guest"))
    window = Window.partitionBy("b", "s").orderBy("guest", F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    both = placed.select("b", "s", *names, F.lit(0).alias("guest")).unionByName(guests)
    return both.select(*names, "guest", *[F.lead(c).over(window).alias(f"next_{c}") for c in names]).filter("guest = 0").drop("guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> one row per row: doc_id, n_chars, edited_text_sha256 as edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, group_id, group_size.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document's text. Likeness is 1 where digests and canonical bytes agree, else 0: the
    digest is exact and knows nothing between. group_id is the smallest doc_id with the same canonical
    text, group_size the number of such rows. Null texts count as empty; all empty and blank texts
    have one fingerprint. A lone row is its own next. Repeated rows, null ids and extra columns are
    fine; an empty table gives an empty result.
    """
    docs = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.coalesce("text", F.lit("")))
    marked = docs.withColumn("fingerprint", digest(canonical(F.col("text"))))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = with_next(marked, "fingerprint").withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 2) as int))")))
    edited = edited.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_fingerprint", digest(F.col("edited_canon")))

    def same(print_a, print_b, canon_b):
        return F.when(F.col(print_a) == F.col(print_b), F.when(canonical(F.col("text")) == canon_b, 1.0).otherwise(0.0)).otherwise(0.0)

    rows = edited.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        same("fingerprint", "edited_fingerprint", F.col("edited_canon")).alias("near_edited"),
        same("fingerprint", "next_fingerprint", canonical(F.col("next_text"))).alias("near_next"),
    )
    rows = keep(rows, "fingerprints")
    return _grouped(docs, rows)


def _grouped(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Group rows by digest, then compare canonical bytes inside the digests that occur twice."""
    bit = F.pmod(F.xxhash64("fingerprint"), F.lit(_MAP_BUCKETS * 32768))
    twice = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(bit.alias("bit"))
    maps = {r.k: bytes(r.m) for r in twice.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect()}
    held = F.lit(bytearray(b"".join(maps.get(k, b"").ljust(4096, b"\0") for k in range(_MAP_BUCKETS + 1))))
    at = (F.bitmap_bucket_number("bit") * 32768 + F.bitmap_bit_position("bit")).cast("int")
    members = docs.withColumn("canon", canonical(F.col("text"))).withColumn("fingerprint", digest(F.col("canon"))).withColumn("bit", bit).withColumn("at", at)
    byte = F.conv(F.hex(F.substring(held, F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    members = members.filter(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1)
    texts = keep(members.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")), "canonical")
    groups = texts.groupBy(F.col("fingerprint").alias("f")).agg(F.count(F.lit(1)).alias("texts"), F.min("group_id").alias("group_id"), F.sum("group_size").alias("group_size"))
    groups = keep(groups, "groups")  # a join with a table can be split where a group is large
    found = rows.join(groups, F.col("fingerprint") == F.col("f"), "left")
    own = {"group_id": F.coalesce("group_id", "doc_id"), "group_size": F.coalesce("group_size", F.lit(1)).cast("long")}
    plain_rows = found.filter("texts is null or texts = 1").select(*rows.columns, *[v.alias(k) for k, v in own.items()])
    mixed = found.filter("texts > 1").select(*rows.columns)  # two canonical texts under one 128-bit digest
    mixed = mixed.join(members.select(F.col("doc_id").alias("m"), "fingerprint", "canon").distinct().join(texts, ["fingerprint", "canon"]).select("m", F.col("fingerprint").alias("mf"), "group_id", "group_size"), F.col("doc_id").eqNullSafe(F.col("m")) & (F.col("fingerprint") == F.col("mf")))
    return plain_rows.union(mixed.select(*rows.columns, "group_id", "group_size"))

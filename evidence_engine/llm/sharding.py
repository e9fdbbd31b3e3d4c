"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Equal texts form a group, and a group is what is placed: where the dot product of its vector with the
shard's residual capacity is highest. Heavy groups, those of more than 1/64 of a shard in some measure, are few
whatever the input; the driver places them first, largest first. What they leave of each shard is then
shared out to buckets of the other groups in proportion to the buckets' sums, and each bucket is packed by
its own task in the same way. A bucket's shards end level to within about its smallest groups, so the
whole ends level too, and no group that fits a shard is ever cut.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, plain

#: A group of more than 1 / HEAVY of a shard is placed by the driver: at most 3 * HEAVY * shards groups. One of more
#: bytes than a shard is cut into pieces of about 1 / PIECES of a shard: at most 2 * PIECES * shards pieces.
HEAVY, PIECES = 64, 8
#: Groups that one task packs, about.
BUCKET = 20_000
#: Weight of bytes, tokens and rows in the dot product. Bytes is the law that must hold closely.
WEIGHTS = np.array([1.0, 0.1, 0.1])


def place(vectors: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The shard of each vector: in the order given, each goes where the dot product of its vector with the
    residual capacity `left` (shards x measures) is highest among the shards that it fits; if it fits none,
    among all. `left` is reduced in place. Ties go to the lower shard."""
    out = np.zeros(len(vectors), np.int64)
    weighed = vectors * WEIGHTS
    for i, v in enumerate(vectors):
        score = left @ weighed[i]
        fits = (left >= v).all(axis=1)
        out[i] = best = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        left[best] -= v
    return out


def _largest_first(frame: pd.DataFrame, share: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    vectors = frame[["bytes", "tokens", "rows"]].to_numpy(np.float64) / share
    order = np.lexsort([*(frame[c].to_numpy() for c in ("piece", "h2", "h1")), -vectors.max(axis=1)])
    return frame.iloc[order], vectors[order]


def _pack(share, left, total):
    """Packs one bucket's groups into its part of every shard's residual capacity."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, vectors = _largest_first(pdf, share)
        part = vectors.sum(axis=0) / np.where(total > 0, total, 1)
        return pd.DataFrame({"h1": pdf["h1"], "h2": pdf["h2"], "shard": place(vectors, left * part).astype(np.int32)})

    return pack


def vector_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """docs (doc_id, text) -> one row per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens.

    Size: UTF-8 bytes of the text (null: none) plus 16. law is 'bytes': the shards' sizes are near equal, as near as
    whole groups allow. Equal texts share a shard; only a group of more bytes than a whole
    shard's share is cut, by doc_id. slot counts a shard's rows from 0 without gaps. grown_shard is null: only
    the law 'key' has one. Reruns agree, whatever the partitions; groups of equal size go in the order of their
    hashes. Null texts count as empty; repeated rows and null ids are placed like others; an empty
    table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = plain(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit("second"), text).alias("h2"),
    )
    base = keep(base, "sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    groups = keep(base.groupBy("h1", "h2").agg(*sums), "groups")
    n, *total = groups.agg(F.count(F.lit(1)), F.sum("bytes"), F.sum("tokens"), F.sum("rows")).first()
    share = np.array([max(1, x or 0) / shards for x in total])
    most = F.greatest(*[F.col(c) / float(x) for c, x in zip(("bytes", "tokens", "rows"), share, strict=True)])
    heavy = keep(groups.withColumn("most", most).filter(F.col("most") > 1 / HEAVY).withColumn("pieces", F.when((F.col("bytes") > float(share[0])) & (F.col("rows") > 1), F.ceil(F.col("bytes") / float(share[0]) * PIECES)).otherwise(1)), "heavy")
    of_heavy = heavy.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "pieces")
    same = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    marked = base.join(F.broadcast(of_heavy), same, "left").drop("g1", "g2")  # at most 3 * HEAVY * shards rows
    marked = marked.withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("doc_id"), "pieces")).otherwise(F.lit(0)).cast("long"))

    whole = heavy.filter("pieces = 1").select("h1", "h2", F.lit(0).cast("long").alias("piece"), "bytes", "tokens", "rows")
    cut = marked.filter("pieces > 1").groupBy("h1", "h2", "piece").agg(*sums)
    first = whole.unionByName(cut).toPandas()  # bounded as said at HEAVY and PIECES
    left = np.ones((shards, 3))
    first, vectors = _largest_first(first, share)
    at = place(vectors, left)
    rows = [(int(a), int(b), int(p), int(s)) for a, b, p, s in zip(first["h1"], first["h2"], first["piece"], at, strict=True)]
    placed_first = spark.createDataFrame(rows, "k1 long, k2 long, p long, shard int")

    light = groups.join(F.broadcast(of_heavy), same, "left_anti").withColumn("piece", F.lit(0).cast("long"))
    rest = (np.array([float(x or 0) for x in total]) / share) - vectors.sum(axis=0)
    buckets = max(1, -(-n // BUCKET))
    placed = light.withColumn("bucket", F.pmod("h1", F.lit(buckets))).groupBy("bucket").applyInPandas(_pack(share, left, rest), "h1 long, h2 long, shard int")
    placed = placed.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "shard")
    columns = ["doc_id", "size", "text_crc32", "tokens", "h1", "shard"]
    here = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    big = marked.filter("pieces is not null").join(F.broadcast(placed_first), here & (F.col("piece") == F.col("p"))).select(*columns)
    small = marked.filter("pieces is null").join(placed, here).select(*columns)
    return _with_slots(keep(big.unionByName(small), "placed"), shards, total[2] or 0)


def _with_slots(rows: DataFrame, shards: int, n: int) -> DataFrame:
    """Number each shard's rows from 0: blocks of a few hundred rows are numbered on their own and
    start where the blocks before them end."""
    blocks = max(4, -(-n // (shards * 500)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(blocks)))
    counts = rows.groupBy(F.col("shard").alias("of"), F.col("block").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("of", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "h1", "text_crc32", "size"))
    ranked = rows.withColumn("rank", rank).join(starts, (F.col("shard") == F.col("of")) & (F.col("block") == F.col("at")))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")

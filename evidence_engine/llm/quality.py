"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-
leader updates, scored as sparse dot products.

Tokens are runs of letters and digits or runs of signs, A-Z lower-cased; features are single tokens and
pairs of neighbours, hashed to 2**18 buckets, each with its share of the document's tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import plain, settle

BITS = 18
#: Labelled rows that the model is fitted to, at most; those with the smallest hash of their doc_id.
SAMPLE = 8000
SCALE = 16.0


def _features(column):
    """(row, buckets of all its tokens and pairs, number of tokens) for each text."""
    for row, data, offsets in T.runs(column):
        data = T.LOWER[data]
        starts, ends, first = T.words(data, offsets, T.WORDS_AND_SIGNS)
        h = T.hashes(data, starts, ends)
        single = (h >> np.uint64(64 - BITS)).astype(np.int64)
        with np.errstate(over="ignore"):
            pair = (T.mix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(64 - BITS)).astype(np.int64)
        yield row, single, pair, first


def _sparse_rows(batches):
    for batch in batches:
        at, share = [], []
        for _, single, pair, first in _features(batch.column("text")):
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                buckets, counts = np.unique(np.concatenate([single[a:b], pair[a : max(a, b - 1)]]), return_counts=True)
                at.append(buckets.astype(np.int32).tobytes())
                share.append((counts / max(1, b - a)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("quality"), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["order", "quality", "at", "share"])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 0.05, l1: float = 2e-3, l2: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) after `epochs` passes of per-coordinate FTRL over the rows in order.
    Classes are weighed so that both have half of the mass; without two classes the weights are 0."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    ones = sum(y for _, _, y in rows)
    if not 0 < ones < len(rows):
        return np.zeros(size, np.float32)
    mass = (len(rows) / (2 * (len(rows) - ones)), len(rows) / (2 * ones))

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for at, share, y in rows:
            at, x = np.append(at, size - 1), np.append(share * SCALE, 1.0)
            w = weight(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * mass[y] * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / alpha * w
            n[at] = more
    return weight(z, n).astype(np.float32)


def _score_rows(shared):
    def rows(batches):
        weights = shared.value
        for batch in batches:
            scores = np.zeros(len(batch.column("text")))
            for row, single, pair, first in _features(batch.column("text")):
                one = np.concatenate([[0.0], np.cumsum(weights[single], dtype=np.float64)])
                two = np.concatenate([[0.0], np.cumsum(weights[pair], dtype=np.float64)])
                a, b = first[:-1], first[1:]
                last = np.maximum(a, b - 1)
                total = one[b] - one[a] + two[np.minimum(last, len(two) - 1)] - two[np.minimum(a, len(two) - 1)]
                scores[row : row + len(a)] = total / np.maximum(1, b - a)
            scores = 1 / (1 + np.exp(-np.clip(scores * SCALE + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return rows


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 5) -> np.ndarray:
    """Weights fitted to labelled rows of docs outside the held-out fold (crc32(doc_id as text) mod fold
    is 0), of which at most `sample`. Null ids and labels, and labels of unknown documents, are left out;
    of a document's several labels the largest counts."""
    settle(docs.sparkSession)
    learn = plain(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != 0)
    learn = learn.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.when(F.col("quality") >= 1, 1).otherwise(0)).alias("quality"))
    learn = learn.orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    known = plain(docs, "doc_id", "text").join(F.broadcast(learn), F.col("doc_id") == F.col("labelled")).select("doc_id", "quality", "text")
    # Texts become sparse features where they are; only those meet in one task, at most 8 bytes for each of 2**BITS buckets a row.
    order = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"))
    sparse = known.select(F.to_json(order).alias("order"), "quality", "text").mapInArrow(_sparse_rows, "order string, quality int, at binary, share binary")
    found = sparse.orderBy("order").limit(sample).collect()
    return fit([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32), r.quality) for r in found])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fold: int = 5) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> one row per row: doc_id, held_out, score, predicted.

    score estimates how likely label 1 is, both classes taken as equally frequent; an empty or null text
    has the bias alone. held_out: crc32(doc_id as text) mod `fold` is 0; false for a null id. Without
    labels of both classes every score is 0.5. Rows may repeat; an empty table gives an empty result;
    extra columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold=fold))
    scored = plain(docs, "doc_id", "text").mapInArrow(_score_rows(weights), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

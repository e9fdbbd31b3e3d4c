"""Exact top-k inner products by vector-approximation files.

The approximation file holds one byte a component: its cell on an even grid between the smallest and
the largest component of all vectors of that dimension. It is built once and is all that meets the queries:
a scan of blocks of cells bounds every score from below and above, and the kth largest lower bound of a query rules
out whatever lies wholly under it. Exact vectors are then fetched for the candidates alone, in order of
their bounds: first the most promising of each query, then those whose upper bound still reaches
the kth exact score.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, plain, settle

#: Cells a component (a byte), rows of a block of cells, queries of a block, and queries bounded at a time.
CELLS, ROW_BLOCK, QUERY_BLOCK, TOGETHER = 256, 1 << 14, 1 << 11, 64


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as floats; exact wherever scale is a power of 2 and the product is finite."""
    with np.errstate(over="ignore"):
        return np.floor(x * float(scale))


def _floor(a: float, scale: int) -> int:
    return int(a) * scale if abs(a) >= 2.0**53 else math.floor(a * scale)


def exact_dot(x: np.ndarray, y: np.ndarray, scale: int) -> int:
    """Integer inner product of any size."""
    return sum(_floor(a, scale) * _floor(b, scale) for a, b in zip(x.tolist(), y.tolist(), strict=True))


def _pack(scale):
    """One row for a block: ids and cells of all its rows."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = float(pdf["low"].iloc[0]), float(pdf["high"].iloc[0])
        step = _step(low, high)
        values = scaled(np.array(pdf["x"].tolist(), dtype=np.float64).reshape(len(pdf), -1), scale)
        with np.errstate(invalid="ignore", over="ignore"):
            cells = np.clip(np.nan_to_num((values - low) / step, nan=0.0), 0, CELLS - 1).astype(np.uint8)
        return pd.DataFrame({"dim": [key[0]], "low": [low], "high": [high], "rids": [pdf["rid"].to_numpy(np.int64).tobytes()], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "cells": [cells.tobytes()]})

    return pack


def _step(low, high):
    return max((high - low) / CELLS, 2.0**-20) if np.isfinite(high - low) else np.inf


def _pack_queries(scale):
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = scaled(np.array(pdf["x"].tolist(), dtype=np.float64).reshape(len(pdf), -1), scale)
        return pd.DataFrame({"qdim": [key[0]], "qblock": [key[1]], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "queries": [values.tobytes()]})

    return pack


def _bounds(k):
    """Blocks of cells met with blocks of queries -> (query_id, rid, low, up) of rows that may be among the k best."""

    def rows(batches):
        for batch in batches:
            for rids, ids, cells, low, high, dim, qids, queries in zip(*(batch.column(c).to_pylist() for c in ("rids", "ids", "cells", "low", "high", "dim", "qids", "queries")), strict=True):
                rids, ids, qids = (np.frombuffer(b, np.int64) for b in (rids, ids, qids))
                asked = np.frombuffer(queries, np.float64).reshape(len(qids), dim)
                step = _step(low, high)
                if np.isfinite(step):
                    middle = low + (np.frombuffer(cells, np.uint8).reshape(len(ids), dim) + 0.5) * step
                else:  # the range overflows: the cells say nothing and every bound is open
                    middle = np.zeros((len(ids), dim))
                out = [[], [], [], []]
                for a in range(0, len(qids), TOGETHER):
                    part = asked[a : a + TOGETHER]
                    with np.errstate(all="ignore"):
                        score = part @ middle.T
                        size = np.abs(part).sum(axis=1)
                        # Half a cell, and the rounding of the product itself.
                        slack = size * (step / 2) * (1 + 1e-9) + 1e-12 * size * max(abs(low), abs(high)) + 1e-6
                        lower, upper = score - slack[:, None], score + slack[:, None]
                    vague = ~(np.isfinite(lower) & np.isfinite(upper))
                    lower[vague], upper[vague] = -np.inf, np.inf
                    own = ids[None, :] == qids[a : a + TOGETHER, None]
                    lower[own], upper[own] = -np.inf, -np.inf
                    if len(ids) > k:
                        floor = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
                        near = (upper >= floor[:, None]) & ~own
                    else:
                        near = ~own
                    q, r = np.nonzero(near)
                    for held, values in zip(out, (qids[a + q], rids[r], lower[q, r], upper[q, r]), strict=True):
                        held.append(values)
                columns = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "rid", "low", "up"])

    return rows


def _exact(scale):
    """(query_id, vec_id, x, q) -> (query_id, vec_id, score): integer products, in 64 bits where they surely fit."""

    def lists(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())

    def rows(batches):
        for batch in batches:
            x, n = lists(batch.column("x"))
            y, _ = lists(batch.column("q"))
            ends = np.concatenate([[0], np.cumsum(n)])
            a, b = scaled(x, scale), scaled(y, scale)
            most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * max(n.max(initial=0), 1)
            if most < 2**62:
                total = np.concatenate([[0], np.cumsum(a.astype(np.int64) * b.astype(np.int64))]) if most * len(n) < 2**62 else None
                score = total[ends[1:]] - total[ends[:-1]] if total is not None else np.array([int(a[i:j].astype(np.int64) @ b[i:j].astype(np.int64)) for i, j in zip(ends[:-1], ends[1:], strict=True)], np.int64)
            else:
                score = [exact_dot(x[i:j], y[i:j], scale) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                if any(abs(s) >= 2**63 for s in score):
                    raise OverflowError("an inner product doesn't fit 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    return rows


def _ranked(df, k, *order):
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score.

    Components become floor(scale * x). Queries: ids divisible by `every`, an id with several rows being asked once,
    by its smallest vector; candidates: every row of the same dimension whose vec_id differs. The k highest
    integer inner products (all, if fewer), ties to the smaller vec_id; repeated candidate rows each count.
    Rows with a null id, a null vector, or null or non-finite components take no part; empty vectors match each other with
    score 0. Products are exact whatever the components' size; one beyond 64 bits is an error. An empty
    table gives an empty result; extra columns are ignored.
    """
    settle(vectors.sparkSession)
    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = plain(vectors, "vec_id", "embedding").filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.filter(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))))
    rows = keep(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", F.size("x").alias("dim"), "x"), "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("dim", "x")).alias("q")).select("query_id", F.col("q.dim").alias("qdim"), F.col("q.x").alias("q"))
    queries = keep(queries, "queries")
    n, asked = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-asked // QUERY_BLOCK))

    # The approximation file.
    grid = rows.groupBy(F.col("dim").alias("gdim")).agg((F.min(F.array_min("x")) * scale - 1).alias("low"), (F.max(F.array_max("x")) * scale + 1).alias("high"))
    placed = rows.join(grid, F.col("dim") == F.col("gdim")).select("dim", F.pmod(F.xxhash64("rid"), F.lit(row_blocks)).alias("block"), "rid", "vec_id", "x", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"))
    cells = keep(placed.groupBy("dim", "block").applyInPandas(_pack(scale), "dim int, low double, high double, rids binary, ids binary, cells binary"), "cells")
    packed = queries.select("qdim", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("qblock"), F.col("query_id").alias("vec_id"), F.col("q").alias("x")).groupBy("qdim", "qblock").applyInPandas(_pack_queries(scale), "qdim int, qblock long, qids binary, queries binary")
    spread = cells.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    met = spread.join(packed, (F.col("dim") == F.col("qdim")) & (F.col("to") == F.col("qblock"))).select("dim", "low", "high", "rids", "ids", "cells", "qids", "queries")
    found = met.repartition(max(1, row_blocks * query_blocks), F.xxhash64("rids", "qids")).mapInArrow(_bounds(k), "query_id long, rid long, low double, up double")
    found = keep(found, "bounds")

    # What a query's kth largest lower bound doesn't rule out, and its most promising rows.
    kth = _ranked(found.select("query_id", "low"), k, F.desc("low")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("kth"))
    kth = kth.select(F.col("query_id").alias("of"), F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("-inf"))).alias("kth"))
    near = keep(found.join(kth, F.col("query_id") == F.col("of")).filter(F.col("up") >= F.col("kth")).select("query_id", "rid", "up"), "near")
    first = keep(_ranked(near, 2 * k, F.desc("up"), "rid").select("query_id", "rid"), "first")
    vectors_of = rows.select(F.col("rid").alias("r"), "vec_id", "x")
    queries_of = queries.select(F.col("query_id").alias("of"), "q")

    def read(pairs):
        both = pairs.join(vectors_of, F.col("rid") == F.col("r")).join(queries_of, F.col("query_id") == F.col("of"))
        return both.select("query_id", "vec_id", "x", "q").mapInArrow(_exact(scale), "query_id long, vec_id long, score long")

    best = keep(read(first), "read")
    sure = _ranked(best, k, F.desc("score"), "vec_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    sure = sure.select(F.col("query_id").alias("of"), F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(F.lit(float("-inf"))).alias("kth"))
    done = first.select(F.col("query_id").alias("dq"), F.col("rid").alias("dr"))
    rest = near.join(sure, F.col("query_id") == F.col("of")).filter(F.col("up") + F.abs("up") * 1e-15 >= F.col("kth")).join(done, (F.col("query_id") == F.col("dq")) & (F.col("rid") == F.col("dr")), "left_anti").select("query_id", "rid")
    return _ranked(best.unionByName(read(rest)), k, F.desc("score"), "vec_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Near-duplicate documents: an exact Jaccard join of word shingles.

Texts with equal shingle sets form one class. Classes with a similarity of at least the threshold
are linked, and a document's component is what its links reach. The join is the prefix-filter
join: each class orders its shingles rare-first, and two similar classes must share one of the
first n - ceil(t * n) + 1. Length and positional filters cut candidates where postings meet, a
suffix filter cuts them before the sets are compared, and a pair that a round has compared is left out of the next.

Large groups of near copies would make a pair of every two members. Only reachability counts, so
two rounds first compare each class with a few hubs that it shares postings with, and the last round compares
all pairs of a posting whose members are still in different components; there, the parities of hashed
shingle counts bound how much two sets differ before a pair is made. No link that changes a
component is lost, and no number of partners or candidates is capped.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import freed, keep, merged, plain, settle
from .components import components

#: The rare-first order knows a shingle's document frequency by powers of two from 4 up; 2**24 cells
#: of one byte, whatever the input. Shingles that share a cell take the larger of their classes.
CELL_BITS = 24
#: Longs of a class's parity sketch: bit i says whether an odd number of shingles hash to i. Sets differ in at
#: least as many shingles as sketches differ in bits.
SKETCH = tuple(f"s{i}" for i in range(8))


def _sets(batch: pa.RecordBatch):
    """(row, sorted shingles, class digest) for each text of a batch."""
    row = 0
    for _, data, offsets in T.runs(batch.column("text")):
        data = T.LOWER[data]
        starts, ends, first = T.words(data, offsets, T.SPACE_WORDS)
        for s in T.shingles(T.hashes(data, starts, ends), first):
            with np.errstate(over="ignore"):
                digest = T.mix(np.array([T.mix(s ^ np.uint64(0x5BD1E9955BD1E995)).sum() + np.uint64(len(s))], dtype=np.uint64))
            yield row, s, int(digest.view(np.int64)[0])
            row += 1


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _class_rows(batches, percent):
    for batch in batches:
        ids, ns, classes, sketches = batch.column("doc_id"), [], [], []
        for _, s, digest in _sets(batch):
            ns.append(len(s))
            classes.append(digest if len(s) else None)
            odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=64 * len(SKETCH)) & 1
            sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
        sketch = np.stack(sketches) if sketches else np.zeros((0, len(SKETCH)), np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), *[pa.array(c) for c in sketch.T.copy()]], ["doc_id", "n_shingles", "cls", *SKETCH])


def _blobs(keys: np.ndarray, bits: int, **columns: np.ndarray):
    """Entries sorted by key and cut where the leading `bits` of the key change."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
    short = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    columns = {"k": short} | {name: values[order] for name, values in columns.items()}
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    arrays = [pa.array(part[cut[:-1]], pa.int64())] + [pa.array([v[a:b].tobytes() for a, b in spans], pa.binary()) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, ["p", *columns])


def _frequency_entries(bits):
    def entries(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            for _, s, digest in _sets(batch):
                if len(s) and digest not in seen:
                    seen.add(digest)
                    held.append(s)
                    size += len(s)
                if size > 2_000_000:
                    yield _blobs(np.concatenate(held), bits)
                    held, size = [], 0
        if size:
            yield _blobs(np.concatenate(held), bits)

    return entries


def _frequency_cells(bits):
    def cells(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["k"]]), return_counts=True)
        many = counts >= 4
        out = np.zeros(1 << (CELL_BITS - bits), dtype=np.uint8)
        np.maximum.at(out, (values[many] >> np.uint32(32 - (CELL_BITS - bits))).astype(np.int64) if bits < CELL_BITS else np.zeros(many.sum(), np.int64), np.log2(counts[many]).astype(np.uint8))
        return pd.DataFrame({"p": [key[0]], "cells": [zlib.compress(out.tobytes(), 1)]})

    return cells


def _prefix_entries(bits, percent, order_of):
    def entries(batches):
        cells = np.frombuffer(zlib.decompress(order_of.value), np.uint8)
        held, size, seen = [], 0, set()

        def flush():
            key, cls, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            return _blobs(key, bits, cls=cls, n=n, pos=pos)

        for batch in batches:
            for _, s, digest in _sets(batch):
                if not len(s) or digest in seen:
                    continue
                seen.add(digest)
                m = _prefix_length(len(s), percent)
                common = cells[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                first = s[np.argsort(common, kind="stable")[:m]]
                held.append((first, np.full(m, digest, np.int64), np.full(m, len(s), np.int32), np.arange(m, dtype=np.int32)))
                size += m
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return entries


def _postings(bits):
    def postings(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        column = {c: np.concatenate([np.frombuffer(b, t) for b in pdf[c]]) for c, t in (("k", np.uint32), ("cls", np.int64), ("n", np.int32), ("pos", np.int32))}
        order = np.lexsort((column["cls"], column["k"]))
        k, cls, n, pos = (column[c][order] for c in ("k", "cls", "n", "pos"))
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (cls[1:] != cls[:-1])
        k, cls, n, pos = k[new], cls[new], n[new], pos[new]
        same = k[1:] == k[:-1]
        met = np.zeros(len(k), dtype=bool)
        met[1:] |= same
        met[:-1] |= same
        return pd.DataFrame({"key": (np.int64(key[0]) << np.int64(32)) | k[met].astype(np.int64), "cls": cls[met], "n": n[met], "pos": pos[met]})

    return postings


def _wanted_bitmap(pdf_iter):
    bits = np.zeros(1 << 21, dtype=np.uint8)
    for pdf in pdf_iter:
        at = T.mix(pdf["cls"].to_numpy(np.int64).view(np.uint64)) >> np.uint64(40)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
    for p in range(64):
        part = bits[p << 15 : (p + 1) << 15]
        if part.any():
            yield pd.DataFrame({"p": [p], "b": [zlib.compress(part.tobytes(), 1)]})


def _merge_bitmap(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(1 << 15, dtype=np.uint8)
    for b in pdf["b"]:
        out |= np.frombuffer(zlib.decompress(b), np.uint8)
    return pd.DataFrame({"p": [key[0]], "b": [zlib.compress(out.tobytes(), 1)]})


def _set_rows(wanted):
    def rows(batches):
        bits, seen = np.frombuffer(zlib.decompress(wanted.value), np.uint8), set()
        for batch in batches:
            classes, blobs = [], []
            for _, s, digest in _sets(batch):
                at = int(T.mix(np.array([digest], np.int64).view(np.uint64))[0]) >> 40
                if len(s) and digest not in seen and bits[at >> 3] >> (at & 7) & 1:
                    seen.add(digest)
                    classes.append(digest)
                    blobs.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(blobs, pa.binary())], ["cls", "shingles"])

    return rows


def _similar(percent):
    edges = np.arange(1, 8, dtype=np.uint64) << np.uint64(61)

    def rows(batches):
        for batch in batches:
            a_of, b_of = [], []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                # Suffix filter: values between equal bounds differ at least as their counts do.
                u, v = np.diff(np.searchsorted(x, edges), prepend=0, append=len(x)), np.diff(np.searchsorted(y, edges), prepend=0, append=len(y))
                if np.minimum(u, v).sum() < need:
                    continue
                if len(np.intersect1d(x, y, assume_unique=True)) >= need:
                    a_of.append(a)
                    b_of.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_of, pa.int64()), pa.array(b_of, pa.int64())], ["a", "b"])

    return rows


def ngram_jaccard_join(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> one row per row of docs: doc_id, n_shingles, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; the set is the distinct
    5-word shingles, or the whole sequence as one when there are fewer words. Two documents link
    when 100 * intersection >= percent * union. component_id: the smallest doc_id that links
    reach, itself included. Shingles are held as 64-bit hashes.

    Null, empty or blank texts: n_shingles 0, no links, component_id is the own doc_id. Repeated rows
    are texts like any others; rows with equal sets are always linked. A null doc_id takes part and
    counts as larger than any other. An empty table gives an empty result; extra columns are ignored.
    """
    settle(docs.sparkSession)
    spark, docs = docs.sparkSession, plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    classes = keep(docs.mapInArrow(freed(lambda b: _class_rows(b, percent)), "doc_id long, n_shingles long, cls long, " + ", ".join(f"{c} long" for c in SKETCH)), "classes")
    labels = _linked_classes(spark, docs.select("doc_id", "text"), classes, percent)
    known = classes.filter("cls is not null")
    if labels is not None:
        known = known.join(labels, known.cls == labels.node, "left").select("doc_id", "n_shingles", F.coalesce("comp", "cls").alias("comp"))
    else:
        known = known.withColumnRenamed("cls", "comp")
    # Written first: a join with a table, unlike one with an aggregate in the same stage, can be split where a component is large.
    known = keep(known, "members")
    smallest = keep(known.groupBy(F.col("comp").alias("c")).agg(F.min("doc_id").alias("component_id")), "smallest")
    known = known.join(smallest, known.comp == smallest.c, "left").select("doc_id", "n_shingles", "component_id")
    return known.union(classes.filter("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _linked_classes(spark, docs, classes, percent):
    """(node, comp) of the classes that have links; None when there are none."""
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return None
    context = spark.sparkContext
    bits = min(CELL_BITS, max(10, math.ceil(math.log2(total / 2**22 + 1))))
    texts = docs.select("text")
    cells = texts.mapInArrow(freed(_frequency_entries(bits)), "p long, k binary").groupBy("p").applyInPandas(_frequency_cells(bits), "p long, cells binary")
    order = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    width = 1 << (CELL_BITS - bits)
    for row in cells.toLocalIterator():
        order[row.p * width : (row.p + 1) * width] = np.frombuffer(zlib.decompress(row.cells), np.uint8)
    order_of = context.broadcast(zlib.compress(order.tobytes(), 1))
    entries = texts.mapInArrow(freed(_prefix_entries(bits, percent, order_of)), "p long, k binary, cls binary, n binary, pos binary")
    post = keep(entries.groupBy("p").applyInPandas(_postings(bits), "key long, cls long, n int, pos int"), "postings")

    links, labels, compared = None, None, None
    for seeds in (range(8), range(8, 16), None):
        at = post.withColumn("comp", F.col("cls"))
        if labels is not None:
            at = post.join(labels, post.cls == labels.node, "left").select("key", "cls", "n", "pos", F.coalesce("comp", "cls").alias("comp"))
        pairs = _hub_pairs(at, seeds, percent) if seeds else _all_pairs(at, classes, percent)
        pairs = pairs.distinct()
        if compared is not None:
            old = compared.select(F.col("a").alias("a0"), F.col("b").alias("b0"))
            pairs = pairs.join(old, (F.col("a") == F.col("a0")) & (F.col("b") == F.col("b0")), "left_anti")
        pairs = keep(pairs, "pairs")
        if pairs.isEmpty():
            continue
        compared = pairs if compared is None else compared.union(pairs)
        near = keep(_verified(pairs, texts, percent), "links")
        if near.isEmpty():
            continue
        links = near if links is None else links.union(near)
        labels = components(links)
    return labels


def _may_link(percent):
    """Length and positional filters on the columns of two entries of one posting."""
    need = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    length = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    return length & (1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1) >= need)


def _hub_pairs(at, seeds, percent):
    """Each class with one hub for each seed that is in another component: a fixed number of pairs a class.

    A posting's hub for a seed is the member with the smallest seeded hash, and a class takes the smallest
    of its postings' hubs, so the members of one group of near copies nearly all take the same ones."""
    hubs = [F.min(F.struct(F.xxhash64("cls", F.lit(seed)).alias("h"), F.lit(seed).alias("seed"), F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("comp").alias("comp2"))).alias(f"hub{seed}") for seed in seeds]
    hub = at.groupBy(F.col("key").alias("key2")).agg(*hubs, F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key2", F.array(*[f"hub{seed}" for seed in seeds]).alias("hubs"))
    met = at.join(hub, F.col("key") == F.col("key2")).select("cls", "n", "pos", "comp", F.inline("hubs"))
    met = met.filter((F.col("comp") != F.col("comp2")) & _may_link(percent))
    met = met.groupBy("cls", "seed").agg(F.min(F.struct("h", "cls2")).alias("best")).select("cls", F.col("best.cls2").alias("cls2"))
    return met.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b"))


def _all_pairs(at, classes, percent):
    """All pairs of a posting across components; postings within one component are left out first."""
    open_keys = at.groupBy(F.col("key").alias("k")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("k")
    at = at.join(open_keys, F.col("key") == F.col("k"), "left_semi")
    sketches = classes.filter("cls is not null").groupBy(F.col("cls").alias("of")).agg(*[F.first(c).alias(c) for c in SKETCH])
    at = keep(at.join(sketches, F.col("cls") == F.col("of")).drop("of"), "open")
    other = at.select(*[F.col(c).alias(f"{c}2") for c in at.columns])
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in SKETCH), F.lit(0))
    near = differ <= F.col("n") + F.col("n2") - 2 * F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent))
    met = at.join(other, (F.col("key") == F.col("key2")) & (F.col("comp") < F.col("comp2")) & _may_link(percent) & near)
    return met.select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b"))


def _sets_of(texts, wanted):
    """(cls, shingles) of the wanted classes. A bitmap of 2**24 bits, whatever their number, lets few
    others through; the joins drop those."""
    slices = merged(wanted.mapInPandas(_wanted_bitmap, "p int, b binary"), "p", _merge_bitmap, "p int, b binary")
    bitmap = np.zeros(1 << 21, dtype=np.uint8)
    for row in slices.collect():  # at most 64 slices of 32 KB
        bitmap[row.p << 15 : (row.p + 1) << 15] = np.frombuffer(zlib.decompress(row.b), np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))
    return keep(texts.mapInArrow(freed(_set_rows(shared)), "cls long, shingles binary").groupBy("cls").agg(F.first("shingles").alias("shingles")), "sets")


def _verified(pairs, texts, percent):
    sets = _sets_of(texts, pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
    one = pairs.join(sets.withColumnRenamed("shingles", "x"), F.col("a") == F.col("cls")).select("a", "b", "x")
    two = one.join(sets.withColumnRenamed("shingles", "y"), F.col("b") == F.col("cls")).select("a", "b", "x", "y")
    return two.mapInArrow(freed(_similar(percent)), "a long, b long")

"""License scans: an exact set-similarity join of text blocks and license templates.

Words are cut into blocks whose length follows the template: at least twice its words, rounded up to a power
of 2, starting every half block, so a notice of any length lies whole in some block. A template matches a block
that holds at least the threshold share of its distinct words.
Tokens are ordered by their frequency over all documents, rarest first; a match must hold one of a
template's first n - ceil(t * n) + 1 tokens (prefix filter), enough tokens at all (length filter) and
enough behind the first common one (positional filter). Only blocks with a prefix token are looked
at; the templates are few and fixed, so the join needs no shuffle.

Base phrases are templates with threshold 1; where their words stand consecutively is checked in the
blocks that the join returns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import plain, settle

#: The base phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Sentences of common license notices and their labels.
NOTICES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "this work is licensed under a creative commons attribution international license": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
}
#: The shortest stride; a template of more words has the next power of 2, and blocks are two strides long.
STRIDE = 32


class _Templates:
    """Templates as sorted token ids; token ids follow the global order, rarest first."""

    def __init__(self, templates: list[tuple[str, str, float]], counts: dict[str, int]):
        tokens = sorted({w for text, _, _ in templates for w in text.split()}, key=lambda w: (counts.get(w, 0), w))
        ids = {w: i for i, w in enumerate(tokens)}
        found = np.array([T.hash_of(w.encode()) for w in tokens], dtype=np.uint64)
        self.order = np.argsort(found)
        self.sorted = found[self.order]
        self.items = [(label, sorted({ids[w] for w in text.split()}), threshold) for text, label, threshold in templates]
        self.spoken = [[ids[w] for w in text.split()] for text, _, _ in templates]
        self.need = [math.ceil(threshold * len(own) - 1e-9) for _, own, threshold in self.items]
        #: By stride: the templates of each prefix token, and which tokens are prefix tokens.
        self.prefix: dict[int, dict[int, list[int]]] = {}
        for t, (_, own, _) in enumerate(self.items):
            stride = max(STRIDE, 1 << max(0, len(self.spoken[t]) - 1).bit_length())
            for token in own[: len(own) - self.need[t] + 1]:
                self.prefix.setdefault(stride, {}).setdefault(token, []).append(t)
        self.rare = {stride: np.isin(np.arange(len(tokens)), list(prefix)) for stride, prefix in self.prefix.items()}

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Token id of each hash, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)

    def matches(self, block: list[int], stride: int):
        """(template, containment) of the templates of a stride that a block's sorted distinct tokens meet."""
        place, prefix = {token: i for i, token in enumerate(block)}, self.prefix[stride]
        for t in sorted({t for token in block for t in prefix.get(token, ())}):
            own, need = self.items[t][1], self.need[t]
            if len(block) < need:
                continue
            j = next(j for j, token in enumerate(own) if token in place)
            if 1 + min(len(own) - j - 1, len(block) - place[own[j]] - 1) < need:
                continue
            common = sum(token in place for token in own)
            if common >= need:
                yield t, common / len(own)


def _texts(column):
    for row, data, offsets in T.runs(column):
        data = T.LOWER[data]
        starts, ends, first = T.words(data, offsets, T.LATIN_WORDS)
        yield row, T.hashes(data, starts, ends), first


def _count_tokens(templates):
    def rows(batches):
        known = _Templates(templates, {})
        counts = np.zeros(len(known.sorted), dtype=np.int64)
        for batch in batches:
            for _, hashes, _ in _texts(batch.column("text")):
                at = known.lookup(hashes)
                counts += np.bincount(at[at >= 0], minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int64()), pa.array(counts, pa.int64())], ["token", "n"])

    return rows


def _scan(templates, counts):
    def rows(batches):
        known = _Templates(templates, counts)
        phrases = range(sum(threshold >= 1 for _, _, threshold in templates))
        for batch in batches:
            n = len(batch.column("text"))
            words, places, found = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
            for row, hashes, first in _texts(batch.column("text")):
                words[row : row + len(first) - 1] = np.diff(first)
                token = known.lookup(hashes)
                hits = np.flatnonzero(token >= 0)
                text = np.searchsorted(first, hits, "right") - 1
                position = hits - first[text]
                for stride, is_rare in known.rare.items():
                    rare = is_rare[token[hits]]
                    block = position[rare] // stride
                    some = np.unique(np.concatenate([np.stack([text[rare], block], 1), np.stack([text[rare], np.maximum(block - 1, 0)], 1)]), axis=0)
                    for d, b in some.tolist():
                        lo, hi = np.searchsorted(hits, [first[d] + b * stride, min(first[d] + (b + 2) * stride, first[d + 1])])
                        inside = token[hits[lo:hi]]
                        for t, share in known.matches(np.unique(inside).tolist(), stride):
                            if t not in phrases:
                                found[row + d].append((b * stride, t, share))
                                continue
                            spoken = known.spoken[t]
                            for i in range(lo, hi - len(spoken) + 1):
                                if token[hits[i] : hits[i] + len(spoken)].tolist() == spoken and hits[i] + len(spoken) <= first[d + 1]:
                                    places[row + d].append((int(position[i]), t))
            blocks = [sorted(set(x)) for x in found]
            places = [sorted(set(x)) for x in places]
            kind = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array([[{"word": w, "label": known.items[t][0], "share": 1.0} for w, t in x] for x in places], kind), pa.array([[{"word": w, "label": known.items[t][0], "share": s} for w, t, s in x] for x in blocks], kind)],
                ["doc_id", "n_words", "places", "blocks"],
            )

    return rows


def license_scan(docs: DataFrame, threshold: float = 0.8, phrases: dict | None = None, notices: dict | None = None) -> DataFrame:
    """docs (doc_id, text) -> one row per row: doc_id, n_words, places, blocks.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. places: where a phrase's
    words stand consecutively (word from 0, label, share 1). blocks: the blocks (their first word) that
    hold at least `threshold` of a notice's distinct words, with the share; templates may have any length. Null and empty texts: no
    words, empty lists. Rows may repeat, doc_id may be null, an empty table gives an empty result, other
    columns are ignored. Tokens of equal frequency are ordered by code point.
    """
    settle(docs.sparkSession)
    docs = plain(docs, "doc_id", "text")
    templates = [(t, label, 1.0) for t, label in (PHRASES if phrases is None else phrases).items()] + [(t, label, threshold) for t, label in (NOTICES if notices is None else notices).items()]
    names = sorted({w for text, _, _ in templates for w in text.split()})
    counted = docs.select("text").mapInArrow(_count_tokens(templates), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = {names[r.token]: r.n for r in counted.collect()}  # a row for each word of a template
    return docs.mapInArrow(_scan(templates, counts), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, places array<struct<word:long,label:string,share:double>>, blocks array<struct<word:long,label:string,share:double>>")


def license_labels(scanned: DataFrame) -> DataFrame:
    """What a scan says of each document: counts, first and last place, labels and a score, which is the
    largest share of a template that was found (0 without any)."""
    starts = F.col("places.word")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("places.label", "blocks.label")), ",").alias("labels"),
        F.coalesce(F.array_max(F.concat("places.share", "blocks.share")), F.lit(0.0)).alias("score"),
    )

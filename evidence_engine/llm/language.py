"""Language identification by Bayesian evidence fusion.

Text likelihoods come from byte trigrams counted per language over all labelled documents. They are
combined with what a page declares in its markup, what its address says, and a prior of its host that is
smoothed towards its domain and that towards all rows. Priors and the reliability of declarations are
grouped aggregations of what the texts alone say. The languages are those of the labelled documents; a
background of single letters stands for every other language and for garbled text.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .common import keep, merged, plain, settle

#: Labelled rows with letters that make a language; labels of fewer count as another language's.
LEAST_ROWS = 3
#: Stands for all other languages, and for text in none.
OTHER = ""
BITS = 15
#: Trigrams that a language's counts get from the background.
BACKING = 2000.0
#: Trigrams overlap and depend on each other, so their log likelihoods count by this share.
TEMPER = 0.2
#: Rows of evidence that a host's or domain's prior gets from the level above.
SMOOTHING = 20.0
#: Address suffixes that stand for a language (fixed values); a path that starts with a code counts too.
SUFFIXES = {"uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es"}
SUFFIXES |= {"it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "cz": "cs", "gr": "el", "tr": "tr", "hu": "hu", "ro": "ro", "ua": "uk"}

_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def _trigrams(column):
    """(row, bucket of each trigram, first trigram of each text, letters of each text)."""
    for row, data, offsets in T.runs(column):
        b = _LETTERS[data]
        n = len(b)
        if n < 3:
            yield row, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.diff(np.concatenate([[0], np.cumsum(b != 32)])[offsets])
            continue
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        good = (b[:-2] != 32) | (b[1:-1] != 32)
        inner = offsets[1:-1]
        for back in (1, 2):  # trigrams across the border of two texts
            at = inner - back
            good[at[(at >= 0) & (at < n - 2)]] = False
        at = np.flatnonzero(good)
        bucket = ((code[at] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
        yield row, bucket, np.searchsorted(at, offsets), np.diff(np.concatenate([[0], np.cumsum(b != 32)])[offsets])


class Model(NamedTuple):
    """Log probabilities (language, bucket); the last row is the background's."""

    languages: tuple[str, ...]
    table: np.ndarray


def _count_rows(languages):
    def rows(batches):
        counts, single = np.zeros((len(languages), 1 << BITS), np.int64), np.zeros(256, np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for row, bucket, first, _ in _trigrams(batch.column("text")):
                of = np.repeat(lang[row : row + len(first) - 1], np.diff(first))
                counts += np.bincount((of << BITS) + bucket, minlength=counts.size).reshape(counts.shape)
            for _, data, _ in T.runs(batch.column("text")):
                single += np.bincount(_LETTERS[data], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(languages) + 1), pa.int64()), pa.array([zlib.compress(c.tobytes(), 1) for c in (*counts, single)], pa.binary())], ["k", "counts"])

    return rows


def _add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in pdf["counts"])
    return pd.DataFrame({"k": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def _background(single: np.ndarray) -> np.ndarray:
    """Probabilities of the buckets when letters are drawn one by one, half of it spread evenly."""
    letters = np.unique(_LETTERS).astype(np.uint32)
    p = single[letters] + 0.5
    p = p / p.sum()
    code = (letters[:, None, None] << np.uint32(16)) | (letters[None, :, None] << np.uint32(8)) | letters[None, None, :]
    weight = p[:, None, None] * p[None, :, None] * p[None, None, :]
    weight[letters == 32, letters == 32] = 0  # no trigram begins with two blanks
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    return 0.5 * np.bincount(bucket.ravel(), weights=weight.ravel(), minlength=1 << BITS) / weight.sum() + 0.5 / (1 << BITS)


def train(docs: DataFrame) -> Model:
    """Every language that at least LEAST_ROWS rows with letters of docs (text, lang) are labelled with, in
    the order of names, and log probabilities from all rows of those."""
    settle(docs.sparkSession)
    known = plain(docs, "text", "lang").select("text", F.lower("lang").alias("lang")).filter("lang <> ''")
    many = known.filter(F.col("text").rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_ROWS)
    languages = tuple(sorted(r.lang for r in many.collect()))  # a row a language
    counts, single = np.zeros((len(languages), 1 << BITS)), np.zeros(256)
    counted = known.filter(F.col("lang").isin(*languages)).mapInArrow(_count_rows(languages), "k long, counts binary")
    for r in merged(counted, "k", _add, "k long, counts binary").collect():  # a row a language
        (counts[r.k] if r.k < len(languages) else single)[:] += np.frombuffer(zlib.decompress(r.counts), np.int64)
    background = _background(single)
    backed = (counts + BACKING * background) / (counts.sum(axis=1, keepdims=True) + BACKING)
    return Model(languages, np.log(np.vstack([backed, background])).astype(np.float32))


def _likelihood_rows(shared):
    def rows(batches):
        table = shared.value.astype(np.float64)
        for batch in batches:
            n = len(batch.column("text"))
            scores, letters = np.zeros((n, len(table))), np.zeros(n, np.int64)
            for row, bucket, first, of_text in _trigrams(batch.column("text")):
                letters[row : row + len(of_text)] = of_text
                for k, log in enumerate(table):
                    total = np.concatenate([[0.0], np.cumsum(log[bucket])])
                    scores[row : row + len(of_text), k] = total[first[1:]] - total[first[:-1]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(table), pa.int32()), pa.array(scores.ravel()))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists, pa.array(letters)], [*names, "logs", "letters"])

    return rows


def page_evidence(pages: DataFrame, languages: tuple[str, ...] = tuple(sorted(set(SUFFIXES.values())))) -> DataFrame:
    """pages (page_id, url, html) -> kind, id, text, declared, suffix, host, domain. The text is what
    stands outside tags, scripts, styles and comments; a path may start with one of `languages`."""
    html, url = F.coalesce("html", F.lit("")), F.lower(F.coalesce("url", F.lit("")))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    tail, path = F.regexp_extract(host, r"\.([a-z]+)$", 1), F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/]+/([a-z]{2})(?:[/?#-]|$)", 1)
    by_tail = F.coalesce(*[F.when(tail == k, F.lit(v)) for k, v in SUFFIXES.items()])
    suffix = F.coalesce(F.when(path.isin(*languages), path), by_tail)
    return plain(pages, "page_id", "url", "html").select(F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("id"), text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), suffix.alias("suffix"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) as evidence: lang is what is declared, source the host."""
    return plain(docs, "doc_id", "text", "lang", "source").select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.coalesce("source", F.lit("")).alias("host"), F.lit("").alias("domain"))


def identify(evidence: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """evidence (kind, id, text, declared, suffix, host, domain) and a model of trigrams ->
    one row per row: kind, id, lang, confidence, text_lang, letters, accepted.

    lang has the highest posterior of the model's languages, ties to the earlier; confidence is the posterior
    among them and the background, which stands for other languages and garbled text. text_lang is null where the
    background is likeliest. A row is rejected if its text has no letters or no language reaches `least`. Null
    declarations and suffixes are no evidence, codes of other languages count as one value; null hosts share one
    prior. Null and empty texts: the other evidence alone, rejected. Rows may repeat; an empty table gives an
    empty result; extra columns are ignored. Without labelled rows lang is null and all rows are rejected.
    """
    settle(evidence.sparkSession)
    evidence = plain(evidence, "kind", "id", "text", "declared", "suffix", "host", "domain").withColumns({"host": F.coalesce("host", F.lit("")), "domain": F.coalesce("domain", F.lit(""))})
    shared = evidence.sparkSession.sparkContext.broadcast(model.table)
    scored = evidence.mapInArrow(_likelihood_rows(shared), "kind string, id long, declared string, suffix string, host string, domain string, logs array<double>, letters long")
    languages = (*model.languages, OTHER)
    codes = F.array(*[F.lit(x) for x in languages])
    said = F.when(F.col("letters") > 0, F.element_at(codes, F.array_position("logs", F.array_max("logs")).cast("int")))
    scored = keep(scored.withColumn("text_lang", said), "likelihoods")

    ones = [F.sum((F.col("text_lang") == x).cast("double")).alias(f"n{i}") for i, x in enumerate(languages)]
    hosts = keep(scored.filter("text_lang is not null").groupBy("kind", "domain", "host").agg(*ones), "hosts")
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]
    total = [x or 0.0 for x in hosts.agg(*sums).first()]
    top = [(x + 1) / (sum(total) + len(total)) for x in total]

    def smoothed(counts, above):
        n = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
        return [(F.col(c) + SMOOTHING * a) / (n + SMOOTHING) for c, a in zip(counts, above, strict=True)]

    names = [f"n{i}" for i in range(len(languages))]
    domains = hosts.groupBy("kind", "domain").agg(*sums)
    domains = domains.select(F.col("kind").alias("k"), F.col("domain").alias("d"), *[x.alias(f"d{i}") for i, x in enumerate(smoothed(names, [F.lit(x) for x in top]))])
    priors = hosts.join(domains, (F.col("kind") == F.col("k")) & (F.col("domain") == F.col("d")))
    prior = F.array(*smoothed(names, [F.col(f"d{i}") for i in range(len(languages))]))
    priors = keep(priors.select(F.col("kind").alias("k"), F.col("domain").alias("d"), F.col("host").alias("h"), prior.alias("prior")), "priors")

    out = scored.join(priors, (F.col("kind") == F.col("k")) & (F.col("domain") == F.col("d")) & (F.col("host") == F.col("h")), "left")
    logs = F.zip_with("logs", F.coalesce("prior", F.array(*[F.lit(x) for x in top])), lambda a, p: a * TEMPER + F.log(p))
    for column in ("declared", "suffix"):
        logs = F.zip_with(logs, _reliability(scored, column, languages), lambda a, b: a + b)
    logs = F.transform(logs, lambda x: x)
    out = out.withColumn("logs", logs).withColumn("best", F.array_max("logs")).withColumn("known", F.array_max(F.slice("logs", 1, len(model.languages))))
    norm = F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("best")))
    out = out.withColumn("lang", F.element_at(codes, F.array_position("logs", F.col("known")).cast("int"))).withColumn("confidence", F.coalesce(F.exp(F.col("known") - F.col("best")) / norm, F.lit(0.0)))
    return out.select("kind", "id", "lang", "confidence", F.nullif("text_lang", F.lit(OTHER)).alias("text_lang"), "letters", ((F.col("letters") > 0) & (F.col("confidence") >= least)).alias("accepted"))


def _reliability(scored, column, languages):
    """Log P(value | language) by language, from how often each value stands on texts of each language."""
    told = F.when(F.col(column).isin(*languages), F.col(column)).when(F.col(column) != "", OTHER)
    counted = scored.select("text_lang", told.alias("told")).filter("text_lang is not null and told is not null").groupBy("text_lang", "told").agg(F.count(F.lit(1)).alias("n")).collect()  # languages squared
    n = {(r.text_lang, r.told): r.n for r in counted}
    of = {x: sum(n.get((x, y), 0) for y in languages) for x in languages}
    rows = {y: F.array(*[F.lit(math.log((n.get((x, y), 0) + 1) / (of[x] + len(languages)))) for x in languages]) for y in languages}
    return F.coalesce(*[F.when(told == y, v) for y, v in rows.items()], F.array(*[F.lit(0.0)] * len(languages)))


def language_id(pages: DataFrame | None, docs: DataFrame | None, labelled: DataFrame) -> DataFrame:
    """identify() for pages and documents at once, with likelihoods from `labelled` (text, lang)."""
    model = train(labelled)
    parts = [part for part in (page_evidence(pages, model.languages) if pages is not None else None, document_evidence(docs) if docs is not None else None) if part is not None]
    evidence = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return identify(evidence, model)

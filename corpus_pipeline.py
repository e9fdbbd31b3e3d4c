"""The corpus pipeline: stages applied to the documents table one after another.

A doc_id names one document. Rows that share an id stay if any of them is accepted, but near duplicates
are told apart by id and text; all stages work on every row that the stage before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from evidence_engine.llm.bpe import round_trip
from evidence_engine.llm.common import keep, table
from evidence_engine.llm.language import document_evidence, identify
from evidence_engine.llm.language import train as train_languages
from evidence_engine.llm.mixing import mix_copies, row_key
from evidence_engine.llm.ngram_join import ngram_jaccard_join
from evidence_engine.llm.quality import quality_scores

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _without(docs, gone):
    """docs without the ids in gone (doc_id)."""
    gone = keep(gone.select(F.col("doc_id").alias("gone")), "gone")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")


def language_stage(spark, docs, sf_dir):
    """Documents without letters or without a language of enough confidence go; lang becomes what was
    identified where it differs. Texts that are null or empty go; rows that share an id stay if any of them is accepted, and
    take the last language in code point order that was found for them."""
    found = identify(document_evidence(docs), train_languages(docs))
    found = keep(found.groupBy(F.col("id").alias("doc_id")).agg(F.max("accepted").alias("accepted"), F.max("lang").alias("found")), "languages")
    kept = _without(docs, found.filter("not accepted"))
    known = document_evidence(docs).select(F.col("id"), F.col("declared"))
    other = found.join(known, F.col("doc_id").eqNullSafe(F.col("id"))).filter("accepted and not (declared <=> found)").select(F.col("doc_id").alias("named"), "found").distinct()
    kept = kept.join(keep(other, "relabelled"), F.col("doc_id").eqNullSafe(F.col("named")), "left")
    return kept.select(*[F.coalesce("found", "lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier predicts as label 0 go; rows that share an id stay if any of them is predicted as 1. Null
    and empty texts are scored by the bias alone, and without labels of both classes all stay."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scored.groupBy("doc_id").agg(F.max("predicted").alias("p")).filter("p = 0"))


def near_duplicate_stage(spark, docs, sf_dir):
    """One row of each component stays: one with the smallest doc_id, a null id being larger than any other.
    Rows are told apart by id and text, so neither an id on two texts nor a null id ties them together."""
    keyed = docs.withColumn("row_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    joined = keep(ngram_jaccard_join(keyed.select(F.col("row_key").alias("doc_id"), "text")), "components")
    ids = keyed.select(F.col("row_key").alias("key"), F.col("doc_id").alias("id")).distinct()
    parts = joined.select(F.col("doc_id").alias("of"), "component_id").distinct()
    first = ids.join(parts, F.col("key") == F.col("of")).groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    first = keep(first.select(F.col("first.key").alias("first")), "first")
    kept = keyed.join(first, F.col("row_key") == F.col("first"), "left_semi")
    again = keep(joined.groupBy(F.col("doc_id").alias("again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("again"), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    twice = F.col("row_key") == F.col("again")
    return kept.join(again, twice, "left_anti").union(kept.join(again, twice, "left_semi").dropDuplicates(["row_key"])).select(*docs.columns)


def mixing_stage(spark, docs, sf_dir):
    """Each document as often as the mix takes it: not at all, or up to three times. Rows equal in id, source and text are decided
    as one; documents without words aren't taken. Null sources are a source; an empty table stays empty."""
    copies = mix_copies(docs).filter("copies > 0").groupBy("key", F.col("source").alias("of")).agg(F.max("copies").alias("copies"))
    taken = docs.withColumn("taken_key", row_key()).join(keep(copies, "copies"), (F.col("taken_key") == F.col("key")) & F.col("source").eqNullSafe(F.col("of")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*docs.columns)


def bpe_stage(spark, docs, sf_dir):
    """Token ids of every row, and the digest of the bytes that they decode to. Null and empty texts have no ids; repeated rows
    each have a row."""
    both = round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("mix_sources", mixing_stage),
    ("byte_level_bpe", bpe_stage),
]

#: No SQL can express the stages that are trained or randomised; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to the documents table in turn; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

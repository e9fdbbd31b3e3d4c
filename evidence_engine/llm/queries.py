"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from .common import table


def op1_license_scan(spark, sf_dir):
    from .license_scan import license_labels, license_scan

    return license_labels(license_scan(table(spark, sf_dir, "documents")))


def op2_mix_sources(spark, sf_dir):
    from .mixing import mix_copies

    return mix_copies(table(spark, sf_dir, "documents")).drop("key")


def op3_ngram_jaccard_join(spark, sf_dir):
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark, sf_dir):
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_scoring(spark, sf_dir):
    import public_tokenizers

    from .lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_document_fingerprints(spark, sf_dir):
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op7_exact_topk(spark, sf_dir):
    from .exact_topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"))


def op8_byte_level_bpe(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from .bpe import round_trip

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_language_id(spark, sf_dir):
    from pyspark.sql import functions as F

    from .language import language_id

    docs = table(spark, sf_dir, "documents")
    found = language_id(table(spark, sf_dir, "pages"), docs, docs)
    of = {"doc_id": "document", "page_id": "page"}
    return found.select(*[F.when(F.col("kind") == kind, F.col("id")).alias(name) for name, kind in of.items()], "lang", "confidence", "text_lang", "letters", "accepted")


def op10_vector_shards(spark, sf_dir):
    from .sharding import vector_shards

    return vector_shards(table(spark, sf_dir, "documents"))


# ---- what SQL can say of the operators: the columns that the method doesn't decide -------------------


def license_base(spark, sf_dir):
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def mix_base(spark, sf_dir):
    from pyspark.sql import functions as F

    return op2_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def lm_base(spark, sf_dir):
    from pyspark.sql import functions as F

    return op5_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def fingerprint_base(spark, sf_dir):
    return op6_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def shard_base(spark, sf_dir):
    """Of each shard: whether its slots run from 0 without gaps, and of all its rows the sum of sizes over all shards."""
    from pyspark.sql import functions as F

    s = op10_vector_shards(spark, sf_dir)
    per = s.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.countDistinct("slot").alias("slots"), F.sum("size").alias("bytes"))
    gapless = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("slots") == F.col("n"))
    return per.agg(F.count(F.lit(1)).alias("shards"), F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.min(gapless).alias("gapless"))


BASES = (license_base, mix_base, lm_base, fingerprint_base, shard_base)


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")} | {f.__name__: f for f in BASES}

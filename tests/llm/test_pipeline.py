"""Stages of the corpus pipeline on null and repeated ids."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline

A, B, C, D = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")


def test_one_row_of_each_component_stays(spark):
    rows = [(1, A, "s"), (None, A, "s"), (None, B, "s"), (2, A, "s"), (2, C, "s"), (None, D, "s"), (None, D, "t"), (3, C, "s"), (None, D + " more", "s"), (4, None, "s"), (5, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.near_duplicate_stage(spark, df, None)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == df.columns and {(1, A), (None, B), (2, C), (4, None), (5, "")} <= set(got) and len(got) == 6
    assert sum(t is not None and t.startswith(D) for _, t in got) == 1


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat of my grandmother that sleeps on a chair near the window while it rains in the street with this cold wind"
FR = "le chat de la grand mère qui dort sur une chaise près des fenêtres pendant que la pluie tombe dans cette rue"


def test_language_stage_rejects_relabels_and_keeps_columns(spark):
    rows = [(i, EN if i % 2 else FR, "en" if i % 2 or i == 0 else "fr", "s", 1) for i in range(40)] + [(50, None, "en", "s", 1), (51, "", None, None, 1), (52, "12 34", "en", "s", 1), (None, EN, None, None, 1), (1, EN, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = corpus_pipeline.language_stage(spark, df, None)
    got = [(r.doc_id, r.lang) for r in out.collect()]
    assert out.columns == df.columns and (0, "fr") in got and (None, "en") in got and not {50, 51, 52} & {i for i, _ in got} and len(got) == 42
    assert corpus_pipeline.language_stage(spark, df.limit(0), None).count() == 0


def test_quality_stage_drops_what_is_predicted_bad(spark, tmp_path):
    rows = [(i, f"good words here {i % 7}" if i % 2 else f"!! $$ junk {i % 7} ##", "en", "s", 1) for i in range(60)] + [(7, "good words here 0", "en", "s", 1), (None, "good words here", None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.quality_stage(spark, df, str(tmp_path))
    assert out.columns == df.columns and sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, [i for i in range(60) if i % 2] + [7, None]))


def test_mixing_stage_repeats_rows_as_taken(spark):
    df = spark.createDataFrame([(i, "w " * 10, "en", "a" if i % 4 else None, 1) for i in range(40)] + [(90, None, "en", "a", 1), (91, "", "en", "b", 1)], SCHEMA).repartition(3)
    out = corpus_pipeline.mixing_stage(spark, df, None)
    n = {s: out.filter(F.col("source").eqNullSafe(F.lit(s))).count() for s in ("a", "b", None)}
    assert out.columns == df.columns and n["b"] == 0 and abs(n["a"] * 10 - 400 * 5 / 6) <= 11 and abs(n[None] * 10 - 400 / 6) <= 11
    assert out.groupBy("doc_id").count().filter("count > 3").count() == 0 and corpus_pipeline.mixing_stage(spark, df.limit(0), None).count() == 0


def test_bpe_stage_decodes_to_what_it_was_given(spark):
    texts = ["naïve  text\n", "", None, "x" * 70_000, "ab" * 40_000, EN]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)], SCHEMA).repartition(2)
    got = corpus_pipeline.bpe_stage(spark, df, None).collect()
    assert len(got) == 7 and all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() and r.n_tokens == len(r.ids) for r in got)
    assert corpus_pipeline.bpe_stage(spark, df.limit(0), None).count() == 0

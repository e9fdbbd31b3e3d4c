"""Grounding: does each cited passage support its claim, and what follows for claims and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CITATION, citation_key, citations, content_terms, sentences
from ..functions.values import required_values, source_values, unsupported

# The overlap that support needs, the forms of a statement of absence, and what a line of scaffolding starts with.
OVERLAP = 0.45
ABSENCE = (
    r"(?i)\b(?:not\s+(?:provided|available|disclosed|stated|mentioned|included|covered|specified|"
    r"reported|given|found|present)|does\s+not|do\s+not|did\s+not|doesn't|don't|didn't|"
    r"no\s+(?:forecast|guidance|data|information|figure|mention|estimate|projection|detail)|"
    r"is\s+not|are\s+not|was\s+not|were\s+not|cannot\s+be|could\s+not\s+be|"
    r"absent\s+from|silent\s+on|beyond\s+the\s+scope|outside\s+the\s+scope)\b"
)
SCAFFOLD = r"^(#|\||---|```)"
SHORT, FEW_WORDS = 25, 6


def _claim_parts(text):
    """What a claim asserts: its content terms and its values, worked out once a claim."""
    return F.named_struct(F.lit("terms"), content_terms(text), F.lit("values"), required_values(text))


def _passage_parts(text):
    return F.named_struct(F.lit("terms"), content_terms(text), F.lit("values"), source_values(text))


def _compared(df: DataFrame) -> DataFrame:
    """df with structs c and s (null where there is no passage) plus overlap, missing and supported."""
    c, none = F.col("c.terms"), F.array().cast("array<string>")
    have_terms, have_values = F.coalesce("s.terms", none), F.coalesce("s.values", none)
    df = df.withColumn("overlap", F.when(F.size(c) > 0, F.size(F.array_intersect(c, have_terms)) / F.size(c)).otherwise(0.0))
    df = df.withColumn("missing", unsupported(F.col("c.values"), have_values))
    return df.withColumn("supported", (F.size(c) > 0) & F.col("s").isNotNull() & (F.size("missing") == 0) & (F.col("overlap") >= OVERLAP))


def support(pairs: DataFrame) -> DataFrame:
    """pairs (claim, source, ...) plus overlap, missing and supported. A claim without content terms has
    overlap 0 and is never supported; a null source supports nothing."""
    parts = pairs.withColumn("c", _claim_parts(F.col("claim"))).withColumn("s", F.when(F.col("source").isNotNull(), _passage_parts(F.col("source"))))
    return _compared(parts).drop("c", "s")


def _cited(claims: DataFrame, evidence: DataFrame, *carried: str) -> DataFrame:
    """claims (run_id, claim_id, claim, citations, carried...) met with evidence: a row for each citation, and one with a
    null citation for a claim without any. Terms and values of claims and passages are worked out before they meet."""
    cited = claims.select("run_id", "claim_id", "claim", *carried, _claim_parts(F.col("claim")).alias("c"), F.posexplode_outer("citations").alias("pos", "citation"))
    known = evidence.select(F.col("run_id").alias("_run"), "source_id", citation_key(F.col("source_id")).alias("_key"), "source", F.when(F.col("source").isNotNull(), _passage_parts(F.col("source"))).alias("s"))
    met = cited.join(known, (F.col("run_id") == F.col("_run")) & (citation_key(F.col("citation")) == F.col("_key")), "left").drop("_run", "_key")
    return _compared(met).drop("c", "s")


def verdicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (run_id, claim_id, claim, citations), evidence (run_id, source_id, source) -> one row a
    claim and citation with verdict supported, dropped or fabricated; uncited for a claim without citations."""
    verdict = F.when(F.col("citation").isNull(), "uncited").when(F.col("source_id").isNull(), "fabricated").when(F.col("supported"), "supported").otherwise("dropped")
    return _cited(claims, evidence).withColumn("verdict", verdict)


def _set(condition, value):
    return F.collect_set(F.when(condition, value))


def _joined(sets):
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(sets)))), ",")


def _kept():
    """Supporting ids in the order cited, each once."""
    hits = F.array_sort(F.collect_list(F.when(F.col("verdict") == "supported", F.struct("pos", "source_id"))))
    return F.array_distinct(F.transform(hits, lambda x: x["source_id"]))


def claim_report(pairs: DataFrame) -> DataFrame:
    """Verdicts -> one row a claim: supported if any citation carries it, kept (the citations that do, canonical, in
    order), and the ids that were dropped or made up."""
    v = F.col("verdict")
    out = pairs.groupBy("run_id", "claim_id").agg(F.first("claim").alias("claim"), _kept().alias("kept"), _set(v == "fabricated", F.col("citation")).alias("hallucinated"), _set(v == "dropped", F.col("source_id")).alias("dropped"))
    return out.withColumn("supported", F.size("kept") > 0)


def report(pairs: DataFrame) -> DataFrame:
    """Verdicts -> one row a run: claims, supported claims, rate, the made-up citations as written, the dropped ids."""
    ok = F.col("supported").cast("long")
    return claim_report(pairs).groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.sum(ok).alias("supported"), F.round(F.avg(ok), 6).alias("support_rate"), _joined(F.col("hallucinated")).alias("hallucinated_ids"), _joined(F.col("dropped")).alias("dropped_ids"))


def annotate_unsupported(answer, claims):
    """The answer with a mark behind each unsupported claim that stands in it, as columns (text, array of texts)."""
    def mark(acc, claim):
        text = F.trim(claim)
        return F.when(text != "", F.replace(acc, text, F.concat(text, F.lit(" _[unverified]_")))).otherwise(acc)

    return F.aggregate(F.coalesce(claims, F.array().cast("array<string>")), answer, mark)


def _clean(df: DataFrame) -> DataFrame:
    """verified_rate and is_clean over the counts: nothing unverified, made up, unsupported or asserted without a source,
    and something cited at all, disclosures included."""
    total = F.col("verified") + F.col("unverified")
    df = df.withColumn("verified_rate", F.when(total > 0, F.round(F.col("verified") / total, 6)).otherwise(0.0))
    return df.withColumn("is_clean", (F.col("unverified") == 0) & (F.col("fabricated_ids") == "") & (F.col("unsupported_ids") == "") & (F.col("factual_uncited") == 0) & (total + F.col("disclosures") > 0))


def _count(condition, name):
    return F.sum(condition.cast("long")).alias(name)


def uncited_reportable(sentence):
    """Is an uncited sentence long enough to report, and no heading, table row, rule or code fence?"""
    return (F.char_length(sentence) >= SHORT) & ~F.ltrim(sentence).rlike(SCAFFOLD)


def factual(sentence):
    """Does an uncited sentence assert something: six words, no colon at the end, a capital or digit at the start?"""
    text = F.trim(F.regexp_replace(F.trim(sentence), r"^[-*# ]+", ""))
    return (F.size(F.split(text, r"\s+")) >= FEW_WORDS) & ~text.endswith(":") & text.rlike(r"^[\p{Lu}\d]")


def audit_answers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers (run_id, answer), evidence (run_id, source_id, source) -> one row a run that has a sentence: verified,
    unverified, disclosures, uncited and factual_uncited sentences, cited (verified, unverified and disclosures),
    the made-up and the unsupported ids, verified_rate, is_clean.

    Citations are looked up in every cited sentence, statements of absence included; these are then disclosures, and
    every other sentence is checked against each of its citations."""
    parts = answers.select("run_id", F.posexplode(sentences(F.col("answer"))).alias("claim_id", "sentence")).withColumn("citations", citations(F.col("sentence")))
    parts = parts.withColumn("claim", F.regexp_replace("sentence", CITATION, ""))
    pairs = _cited(parts, evidence, "sentence").withColumn("absence", F.col("claim").rlike(ABSENCE))
    cites, known = F.col("citation").isNotNull(), F.col("source_id").isNotNull()
    by_sentence = pairs.groupBy("run_id", "claim_id").agg(
        F.first("sentence").alias("sentence"), F.first("absence").alias("absence"), F.max(cites).alias("cites"), F.max(cites & known & F.col("supported")).alias("ok"),
        _set(cites & ~known, F.col("citation")).alias("fabricated"), _set(known & ~F.col("absence") & ~F.col("supported"), F.col("source_id")).alias("unsupported"),
    )
    checked, silent = F.col("cites") & ~F.col("absence"), ~F.col("cites") & uncited_reportable(F.col("sentence"))
    out = by_sentence.groupBy("run_id").agg(
        _count(checked & F.col("ok"), "verified"), _count(checked & ~F.col("ok"), "unverified"), _count(F.col("cites") & F.col("absence"), "disclosures"),
        _count(silent, "uncited"), _count(silent & factual(F.col("sentence")), "factual_uncited"), _joined(F.col("fabricated")).alias("fabricated_ids"), _joined(F.col("unsupported")).alias("unsupported_ids"),
    )
    return _clean(out.withColumn("cited", F.col("verified") + F.col("unverified") + F.col("disclosures")))


def verify_structured(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (run_id, claim_id, claim, kind assertion or disclosure, citations), evidence (run_id, source_id, source) ->
    one row a claim: verified, kept (its citations that stand, in order), fabricated and unsupported ids.

    An assertion needs a citation that supports it; a disclosure, which no passage can confirm, needs one that exists."""
    known, says = F.col("source_id").isNotNull(), F.col("kind") == "disclosure"
    holds = known & (says | F.col("supported"))
    pairs = _cited(claims, evidence, "kind").withColumn("verdict", F.when(holds, "supported"))
    out = pairs.groupBy("run_id", "claim_id").agg(F.first("claim").alias("claim"), F.first("kind").alias("kind"), _kept().alias("kept"), _set(F.col("citation").isNotNull() & ~known, F.col("citation")).alias("fabricated"), _set(known & ~holds, F.col("source_id")).alias("unsupported"))
    return out.withColumn("verified", F.size("kept") > 0)


def structured_audit(verified: DataFrame) -> DataFrame:
    """Rows of verify_structured() -> one row a run: the same audit as of prose, and the answer rendered from what stands."""
    says = F.col("kind") == "disclosure"
    out = render(verified).join(verified.groupBy("run_id").agg(
        _count(F.col("verified") & ~says, "verified"), _count(~F.col("verified"), "unverified"), _count(F.col("verified") & says, "disclosures"),
        _joined(F.col("fabricated")).alias("fabricated_ids"), _joined(F.col("unsupported")).alias("unsupported_ids"),
    ), "run_id", "right").withColumn("factual_uncited", F.lit(0)).withColumn("answer", F.coalesce("answer", F.lit("")))
    return _clean(out).drop("factual_uncited")


def render(verified: DataFrame) -> DataFrame:
    """Rows of verify_structured() -> run_id, answer: a list of the assertions that stand, then of the disclosures, each
    with its citations. No other text reaches the reader. Runs with nothing verified have no row."""
    cites = F.array_join(F.transform("kept", lambda k: F.concat(F.lit("["), k, F.lit("]"))), " ")
    line = F.concat(F.lit("- "), F.regexp_replace("claim", r"\.+$", ""), F.lit(". "), cites)
    lines = verified.filter("verified").groupBy("run_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("claim_id", line.alias("line"))))), lambda x: x["line"]).alias(kind) for kind in ("assertion", "disclosure")])
    gap = F.when(F.size("disclosure") > 0, F.concat(F.array(F.lit(""), F.lit("**What this doesn't cover**"), F.lit("")), F.col("disclosure"))).otherwise(F.col("disclosure"))
    return lines.select("run_id", F.trim(F.regexp_replace(F.array_join(F.concat("assertion", gap), "\n"), r"^\n+", "")).alias("answer"))


def cited_sources(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that a supported claim of claim_report() keeps, by id: a semi join, so each passage comes once."""
    used = claims.filter("supported").select(F.col("run_id").alias("_run"), F.explode("kept").alias("_id"))
    return evidence.join(used, (F.col("run_id") == F.col("_run")) & (F.col("source_id") == F.col("_id")), "left_semi")


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")

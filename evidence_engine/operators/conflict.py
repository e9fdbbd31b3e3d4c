"""Contradictions between sources, and a ranking of their sides.

Sentences of different sources are compared when they share enough content terms. Two sentences with a
Jaccard of t share a term among the rarest n - ceil(t * n) + 1 of each, so the candidates are an equi-join
on those terms; there is no cap on comparisons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_terms, jaccard
from ..functions.values import source_values
from .quality import authority, freshness, published_year

# Thresholds by type, and the words of negation, hedging and precision.
BASE, POLARITY, TYPES = 0.22, 0.34, {"pct": 0.22, "money": 0.22, "date": 0.30, "quarter": 0.30, "num": 0.42}
NEGATION = r"(?i)\b(?:not|never|no|none|neither|nor|without|failed\s+to|declined\s+to|denied|refused|rejected|did\s?n[o']t|does\s?n[o']t|was\s?n[o']t|were\s?n[o']t|is\s?n[o']t|are\s?n[o']t|cannot|can\s?not)\b"
HEDGE = r"(?i)\b(?:around|about|approximately|roughly|circa|near(?:ly)?|some|estimated|reportedly|allegedly|rumou?red|claims?|unverified|unconfirmed|may|might|could|appears?|seems?)\b"
PRECISE = r"\d+[.,]\d|\d{3,}"
DECISIVE, WEIGHTS = 0.15, (0.40, 0.30, 0.18, 0.12)


def units(evidence: DataFrame) -> DataFrame:
    """evidence (source_id, source) -> sentences of over 30 characters with at least 4 content terms."""
    lines = evidence.select("source_id", F.posexplode(F.split(F.coalesce("source", F.lit("")), r"""(?<=[.!?])\s+(?=[A-Z"'])|\n+""")).alias("pos", "sentence")).withColumn("sentence", F.trim("sentence"))
    lines = lines.filter(F.char_length("sentence") > 30).withColumn("terms", content_terms(F.col("sentence"))).filter("size(terms) >= 4")
    return lines.withColumn("values", source_values(F.col("sentence"))).withColumn("negated", F.col("sentence").rlike(NEGATION)).withColumn("unit", F.struct("source_id", "pos"))


def detect(evidence: DataFrame) -> DataFrame:
    """evidence (source_id, source) -> one row a conflict: kind, source_a, source_b, value_type, value_a, value_b,
    overlap, excerpt_a, excerpt_b, shared_terms. Of equal conflicts the first sentence pair counts."""
    u = units(evidence)
    posted = u.select("unit", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("unit").orderBy("df", "term")
    prefix = posted.join(df, "term").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("n") - F.ceil(BASE * F.col("n") - 1e-9) + 1).select("unit", "n", "term")
    other = prefix.select(F.col("unit").alias("unit2"), F.col("n").alias("n2"), F.col("term").alias("term2"))
    near = prefix.join(other, (F.col("term") == F.col("term2")) & (F.col("unit.source_id") < F.col("unit2.source_id")) & (F.least("n", "n2") >= BASE * F.greatest("n", "n2"))).select("unit", "unit2").distinct()
    left = near.join(u.select("unit", *[F.col(c).alias(f"{c}_a") for c in ("sentence", "terms", "values", "negated")]), "unit")
    right = u.select(F.col("unit").alias("unit2"), *[F.col(c).alias(f"{c}_b") for c in ("sentence", "terms", "values", "negated")])
    pairs = left.join(right, "unit2").withColumn("overlap", jaccard(F.col("terms_a"), F.col("terms_b"))).filter(F.col("overlap") >= BASE)

    def key(v):
        return F.when(v.startswith("money:"), F.substring_index(v, ":", 2)).otherwise(F.substring_index(v, ":", 1))

    kinds = F.array_distinct(F.transform("values_a", key))
    typed = pairs.withColumn("type", F.explode(kinds))

    def of_type(c):
        return F.array_sort(F.filter(c, lambda v: key(v) == F.col("type")))

    typed = typed.withColumn("va", of_type("values_a")).withColumn("vb", of_type("values_b"))
    kind = F.substring_index("type", ":", 1)
    need = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in TYPES.items()], F.lit(BASE))
    typed = typed.filter((F.size("vb") > 0) & ~F.arrays_overlap("va", "vb") & (F.col("overlap") >= need))
    typed, pairs = (x.withColumn("shared", F.array_sort(F.array_intersect("terms_a", "terms_b"))) for x in (typed, pairs))
    common = ["unit", "unit2", "overlap", "sentence_a", "sentence_b", "shared"]
    value = typed.select(*common, F.lit("value").alias("kind"), "type", F.col("va")[0].alias("value_a"), F.col("vb")[0].alias("value_b"))
    polar = pairs.filter((F.col("negated_a") != F.col("negated_b")) & (F.col("overlap") >= POLARITY) & ~F.arrays_overlap("values_a", "values_b"))

    def stance(c):
        return F.when(F.col(c), "denied").otherwise("asserted")

    polar = polar.select(*common, F.lit("polarity").alias("kind"), F.lit("polarity").alias("type"), stance("negated_a").alias("value_a"), stance("negated_b").alias("value_b"))
    both = value.unionByName(polar)
    same = Window.partitionBy("unit.source_id", "unit2.source_id", "kind", "type", F.when(F.col("kind") == "value", F.struct("value_a", "value_b"))).orderBy("unit.pos", "unit2.pos")
    return both.withColumn("r", F.row_number().over(same)).filter("r = 1").select("kind", F.col("unit.source_id").alias("source_a"), F.col("unit2.source_id").alias("source_b"), F.substring_index("type", ":", 1).alias("value_type"), "value_a", "value_b", F.round("overlap", 3).alias("overlap"), F.substring("sentence_a", 1, 220).alias("excerpt_a"), F.substring("sentence_b", 1, 220).alias("excerpt_b"), F.col("shared").alias("shared_terms"))


def specificity(text):
    """How firmly an excerpt commits to its figure."""
    hedged, precise = F.regexp_count(text, F.lit(HEDGE)) > 0, F.regexp_count(text, F.lit(PRECISE)) > 0
    return F.when(hedged & ~precise, 0.1).when(hedged, 0.45).when(precise, 0.9).otherwise(0.6)


def _standing(sources: DataFrame | None, assessed: DataFrame, as_of_year: int, sensitive: bool) -> DataFrame:
    """One row a source: what was assessed, else what its text and address say, else neutral."""
    known = assessed.select("source_id", *[F.col(c).alias(f"a_{c}") for c in ("corroboration", "authority", "freshness", "published_year", "corroborators")])
    if sources is not None:
        year = published_year(F.col("source"), as_of_year)
        own = sources.select("source_id", F.when(F.coalesce("url", F.lit("")) != "", authority(F.col("url"))).otherwise(0.5).alias("own_authority"), year.alias("own_year"), freshness(year, as_of_year, 1.5 if sensitive else 8.0).alias("own_freshness"))
        known = own.join(known, "source_id", "full")
    else:
        known = known.withColumns({"own_authority": F.lit(0.5), "own_year": F.lit(None).cast("int"), "own_freshness": F.lit(0.6)})
    there = F.col("a_authority").isNotNull()
    return known.select("source_id", F.struct(
        F.coalesce("a_corroboration", F.lit(0.0)).alias("corroboration"), F.coalesce("a_authority", "own_authority").alias("authority"), F.coalesce("a_freshness", "own_freshness").alias("recency"),
        F.when(there, F.col("a_published_year")).otherwise(F.col("own_year")).alias("year"), F.coalesce("a_corroborators", F.lit(0)).cast("long").alias("corroborators")).alias("standing"))


def _reasons(s, firm):
    """Why a side stands where it does."""
    return F.array_join(F.filter(F.array(
        F.when(s["corroborators"] > 0, F.format_string("corroborated by %d other domain(s)", s["corroborators"])),
        F.when(s["authority"] >= 0.85, "primary or academic publisher").when(s["authority"] <= 0.25, "low-authority publisher"),
        F.when(s["year"].isNotNull(), F.format_string("dated %d", s["year"])),
        F.when(firm >= 0.8, "states a precise figure").when(firm <= 0.3, "hedged or imprecise"),
    ), lambda x: x.isNotNull()), ", ")


def resolve(conflicts: DataFrame, assessed: DataFrame, sources: DataFrame | None = None, as_of_year: int = 2024, sensitive: bool = False) -> DataFrame:
    """conflicts of detect(), assessed of quality.assess(), sources (source_id, source, url) -> both scores and the reasons for
    them, margin, whether it is decisive, and the preferred side then. A source that wasn't assessed stands by what its own text
    and address say, neutral where they say nothing. No side is ever dropped."""
    known = _standing(sources, assessed, as_of_year, sensitive)
    out = conflicts
    for side in "ab":
        out = out.join(known.select(F.col("source_id").alias(f"source_{side}"), F.col("standing").alias("s")), f"source_{side}", "left")
        parts = [F.coalesce(F.col(f"s.{c}"), F.lit(v)) for c, v in (("corroboration", 0.0), ("authority", 0.5), ("recency", 0.6))]
        firm = specificity(F.col(f"excerpt_{side}"))
        score = WEIGHTS[1] * parts[1] + WEIGHTS[2] * parts[2] + WEIGHTS[3] * firm + WEIGHTS[0] * parts[0]
        out = out.withColumn(f"score_{side}", F.round(score, 3)).withColumn(f"reasons_{side}", _reasons(F.col("s"), firm)).drop("s")
    out = out.withColumn("margin", F.round(F.abs(F.col("score_a") - F.col("score_b")), 3))
    return out.withColumn("decisive", F.col("margin") >= DECISIVE).withColumn("preferred", F.when(F.col("margin") >= DECISIVE, F.when(F.col("score_a") > F.col("score_b"), F.col("source_a")).otherwise(F.col("source_b"))))


# ---- reports -----------------------------------------------------------------------------------------


def readable(token):
    """A canonical value as one would write it."""
    parts = F.split(token, ":")
    return F.when(token.startswith("pct:"), F.concat(parts[1], F.lit("%"))).when(token.startswith("money:"), F.concat(F.element_at(parts, 3), F.lit(" "), parts[1])).otherwise(F.element_at(parts, -1))


def _cite(c):
    return F.concat(F.lit("["), F.col(c), F.lit("]"))


def described(conflicts: DataFrame) -> DataFrame:
    """conflicts plus description: who disagrees about what, in a sentence."""
    what = F.coalesce(F.nullif(F.array_join(F.slice("shared_terms", 1, 5), ", "), F.lit("")), F.lit("the same subject"))
    polar = F.concat(_cite("source_a"), F.lit(" and "), _cite("source_b"), F.lit(" disagree on whether "), what, F.lit(" holds."))
    value = F.concat(_cite("source_a"), F.lit(" and "), _cite("source_b"), F.lit(" give different "), F.col("value_type"), F.lit(" values for "), what, F.lit(": "), readable(F.col("value_a")), F.lit(" vs "), readable(F.col("value_b")), F.lit("."))
    return conflicts.withColumn("description", F.when(F.col("kind") == "polarity", polar).otherwise(value))


def described_resolutions(resolved: DataFrame) -> DataFrame:
    """Rows of resolve() plus description: the conflict, and which side is better supported and why, or that neither is."""
    first = F.col("score_a") >= F.col("score_b")
    best, rest, why = F.when(first, _cite("source_a")).otherwise(_cite("source_b")), F.when(first, _cite("source_b")).otherwise(_cite("source_a")), F.when(first, F.col("reasons_a")).otherwise(F.col("reasons_b"))
    firm = F.concat(F.lit(" "), best, F.lit(" is better supported ("), F.coalesce(F.nullif(why, F.lit("")), F.lit("higher combined standing")), F.lit("); "), rest, F.lit(" is retained but ranked lower."))
    open_ = F.concat(F.lit(" The signals do not separate these sources (margin "), F.format_string("%.2f", "margin"), F.lit("); both are reported."))
    return described(resolved).withColumn("description", F.concat("description", F.when(F.col("decisive"), firm).otherwise(open_)))


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    """One row: contradictions and distinct pairs of sources."""
    return conflicts.agg(F.count(F.lit(1)).alias("contradictions"), F.countDistinct("source_a", "source_b").alias("pairs"))


def prompt_block(described_conflicts: DataFrame, limit: int = 6) -> DataFrame:
    """One row, block: the first conflicts by their sources with both excerpts, for a prompt; empty without any."""
    lines = F.concat(F.lit("- "), F.col("description"), F.lit("\n    "), _cite("source_a"), F.lit(" "), F.col("excerpt_a"), F.lit("\n    "), _cite("source_b"), F.lit(" "), F.col("excerpt_b"))
    few = described_conflicts.orderBy("source_a", "source_b", "kind", "value_type").limit(limit).select(F.struct("source_a", "source_b", "kind", "value_type", lines.alias("line")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return few.agg(F.when(F.count(F.lit(1)) > 0, F.concat(F.lit("CONTRADICTIONS: sources disagree. Attribute each figure to its source and report both sides.\n"), text)).otherwise("").alias("block"))

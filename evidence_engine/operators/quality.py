"""Source quality: authority of the publisher, freshness, corroboration by other domains."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import host, registrable_domain
from ..functions.values import source_values

# Tiers by suffix and by known domain, hosts of low quality, and the date forms.
SUFFIX_TIERS = (((".gov", ".gov.uk", ".mil", ".europa.eu", ".int"), 1.0), ((".edu", ".ac.uk", ".edu.au", ".ac.jp"), 0.9))
DOMAIN_TIERS = {"wikipedia.org": 0.75, "britannica.com": 0.75, "docs.python.org": 0.75, "developer.mozilla.org": 0.75, "arxiv.org": 0.9, "nature.com": 0.9, "science.org": 0.9, "pubmed.ncbi.nlm.nih.gov": 0.9, "doi.org": 0.9, "jstor.org": 0.9, "reuters.com": 0.65, "apnews.com": 0.65, "bbc.co.uk": 0.65, "bbc.com": 0.65, "ft.com": 0.65, "wsj.com": 0.65, "economist.com": 0.65, "bloomberg.com": 0.65, "nytimes.com": 0.65, "theguardian.com": 0.65}
LOW = r"(^|\.)(answers|ehow|wikihow|buzzfeed|contentfarm|articlebase|ezinearticles|scraper|aggregator|blogspot|wordpress|medium|substack)\."
UNKNOWN, POOR = 0.45, 0.2
TIME_SENSITIVE = r"(?i)\b(current|latest|now|today|recent|recently|this\s+(?:year|month|quarter)|as\s+of|up[\s-]?to[\s-]?date|newest|202[4-9]|nowadays|still)\b"
ISO_YEAR, STATED_YEAR = r"\b(20[0-2]\d|19[89]\d)-\d{2}-\d{2}\b", r"(?i)\b(?:published|updated|posted|last\s+modified)[:\s]+[^\n]{0,40}?(20[0-2]\d)\b"


def authority(url):
    """Publisher class in [0, 1]; a known three-label host counts as well as its subdomains."""
    h = host(url)
    out = F.when(h == "", UNKNOWN).when(h.rlike(LOW), POOR)
    for suffixes, tier in SUFFIX_TIERS:
        for suffix in suffixes:
            out = out.when(h.endswith(suffix), tier)
    for name, tier in DOMAIN_TIERS.items():
        out = out.when((h == name) | h.endswith("." + name), tier)
    return out.otherwise(UNKNOWN)


def published_year(text, as_of_year):
    """Latest plausible year that the first 4000 characters state; null if none."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 4000)
    years = F.transform(F.concat(F.regexp_extract_all(head, F.lit(ISO_YEAR), F.lit(1)), F.regexp_extract_all(head, F.lit(STATED_YEAR), F.lit(1))), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: (y >= 1990) & (y <= as_of_year + 1)))


def freshness(year, as_of_year, half_life):
    age = F.greatest(F.lit(0), F.lit(as_of_year) - year)
    return F.when(year.isNull(), 0.6).otherwise(F.round(F.exp(-age * math.log(2) / half_life), 3))


def time_sensitive(question):
    """Does a question ask for what is current?"""
    return F.coalesce(question, F.lit("")).rlike(TIME_SENSITIVE)


def assess(evidence: DataFrame, as_of_year: int, sensitive: bool = False) -> DataFrame:
    """evidence (source_id, url, source) -> source_id, domain, authority, freshness, published_year, corroborators,
    corroboration, quality. A domain corroborates a source with which it shares at least two values: an equi-join on
    distinct (domain, value), so the values of one domain are counted before they are joined."""
    year = published_year(F.col("source"), as_of_year)
    e = evidence.select("source_id", registrable_domain(F.col("url")).alias("domain"), authority(F.col("url")).alias("authority"), year.alias("published_year"), source_values(F.col("source")).alias("values"))
    e = e.withColumn("freshness", freshness(F.col("published_year"), as_of_year, 1.5 if sensitive else 8.0))
    own = e.select("source_id", "domain", F.explode("values").alias("value"))
    of_domain = own.select(F.col("domain").alias("other"), "value").distinct()
    met = own.join(of_domain, "value").filter("domain <> other").groupBy("source_id", "other").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    backed = met.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_other"))
    out = e.join(backed, "source_id", "left").withColumn("corroborators", F.coalesce("n_other", F.lit(0)).cast("long"))
    out = out.withColumn("corroboration", F.least(F.lit(1.0), F.col("corroborators") / 2))
    return out.withColumn("quality", F.round(0.45 * F.col("authority") + 0.25 * F.col("freshness") + 0.30 * F.col("corroboration"), 3)).select("source_id", "domain", "authority", "freshness", "published_year", "corroborators", "corroboration", "quality")


def quality_report(assessed: DataFrame, runs: DataFrame, sensitive: bool = False, min_authority: float = 0.3, min_domains: int = 2) -> DataFrame:
    """Rows of assess(), runs (run_id, source_id) -> one row a run: sources, mean authority, distinct domains, diversity, and warnings:
    few domains, weak publishers, stale where the question asks for what is current, figures that nobody else has."""
    a = runs.join(assessed, "source_id")
    weak, stale, alone = F.col("authority") <= min_authority, F.col("published_year").isNotNull() & (F.col("freshness") < 0.4), F.col("corroborators") == 0

    def names(when=F.lit(True)):
        return F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("domain")))), ", ")

    def number(condition):
        return F.sum(condition.cast("long"))

    g = a.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sources"), F.round(F.avg("authority"), 3).alias("mean_authority"), F.countDistinct("domain").alias("domains"), names().alias("_all"),
        number(weak).alias("_weak"), names(weak).alias("_weak_names"), number(stale).alias("_stale"), F.min(F.when(stale, F.col("published_year"))).alias("_oldest"), number(alone).alias("_alone"),
    )
    few = F.when((F.col("domains") < min_domains) & (F.col("sources") > 1), F.format_string("%d web sources come from %d domain(s) (%s); corroboration is limited", "sources", "domains", "_all"))
    poor = F.when(F.col("_weak") > 0, F.format_string("%d web source(s) are from low-authority domains: %s", "_weak", "_weak_names"))
    old = F.when(F.lit(sensitive) & (F.col("_stale") > 0), F.format_string("current information is asked for, but %d source(s) seem to date from %d or earlier", "_stale", "_oldest"))
    single = F.when((F.col("_alone") > 0) & (F.col("domains") >= min_domains), F.format_string("%d web source(s) report figures that no other domain confirms", "_alone"))
    warnings = F.filter(F.array(few, poor, old, single), lambda x: x.isNotNull())
    return g.select("run_id", "sources", "mean_authority", "domains", F.round(F.col("domains") / F.col("sources"), 3).alias("diversity"), warnings.alias("warnings"))

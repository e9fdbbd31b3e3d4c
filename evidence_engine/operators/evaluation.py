"""Evaluation of runs against cases, and labels of annotators, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .agreement import cohen_kappa, confusion, fleiss_kappa
from .grounding import ABSENCE

# Forms that attribute a statement, the least share of verified sentences, reliable numbers of items, noise bands by metric.
ATTRIBUTION = (
    r"(?i)\b(?:claim(?:s|ed)?|alleg(?:es|ed)|assert(?:s|ed)|report(?:s|ed)\s+(?:that|by)|"
    r"according\s+to|says?|said|states?|stated|per\s+\w+|sources?\s+(?:close|say|claim)|"
    r"unverified|unconfirmed|could\s+not\s+(?:be\s+)?confirm|conflict)\b"
)
VERIFIED, RELIABLE_RETEST, POSITIVE = 0.8, 40, ("supported", "partial")
LOWER_IS_BETTER = ("false_abstention", "errors", "fabricated_citation_cases", "answers_with_no_citations", "mean_latency_s", "total_cost_usd")
NOISE = {"total_cost_usd": 0.25, "mean_latency_s": 0.25, "wall_clock_s": 0.5}


def read_cases(spark: SparkSession, path: str, schema: str, only: str | None = None) -> DataFrame:
    """JSON lines without blank and // lines; only cases whose id holds `only`, if given."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("//") & (F.trim("value") != ""))
    cases = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return cases.filter(F.contains("id", F.lit(only))) if only else cases


def assertive(answer):
    """An answer without the lines that state an absence or attribute something, in lower case on one line."""
    lines = F.filter(F.split(F.coalesce(answer, F.lit("")), r"\r\n|\n|\r"), lambda x: ~x.rlike(ABSENCE) & ~x.rlike(ATTRIBUTION))
    return F.lower(F.array_join(lines, " "))


def is_answer(outcome):
    return outcome.isin("answered", "partial")


def case_checks(cases: DataFrame, runs: DataFrame, min_support: float = 0.6) -> DataFrame:
    """cases (id, expect_route, expect_outcome array, expect_min_rounds, must_cite array, must_not array, expect_injection,
    require_clean), runs (id, answer, route, outcome, rounds, support_rate, n_claims, injections, audited, verified_rate,
    checked, cited, fabricated, is_clean, cost, seconds, error) -> one row a case: checks (map of name to boolean, of those that apply), passed,
    and what the summary needs. A case without checks, or whose run failed, is not passed; "hybrid" is no other route's match."""
    r = cases.join(runs, "id", "left")
    low, said = F.lower(F.coalesce("answer", F.lit(""))), assertive(F.col("answer"))
    answered, none = is_answer(F.col("outcome")), F.array().cast("array<string>")
    audited = answered & F.coalesce("audited", F.lit(False))
    expected = F.coalesce("expect_outcome", none)

    def entry(when, name, value):
        return F.when(when, F.named_struct(F.lit("key"), F.lit(name), F.lit("value"), F.coalesce(value, F.lit(False))))

    def needles(column, prefix, test):
        return F.transform(F.coalesce(column, none), lambda x: F.named_struct(F.lit("key"), F.concat(F.lit(prefix), x), F.lit("value"), test(F.lower(x))))

    fixed = F.array(
        entry(F.coalesce("expect_route", F.lit("")) != "", "route", F.col("route") == F.col("expect_route")),
        entry(F.col("expect_min_rounds").isNotNull(), "ran_rounds", F.col("rounds") >= F.col("expect_min_rounds")),
        entry(F.size(expected) > 0, "outcome", F.array_contains(expected, F.col("outcome"))),
        entry(F.coalesce("expect_injection", F.lit(False)), "injection_detected", F.col("injections") > 0),
        entry(answered & (F.col("n_claims") > 0), "grounded", F.col("support_rate") >= min_support),
        entry(audited, "no_fabricated_citations", F.col("fabricated") == 0),
        entry(audited & (F.col("checked") > 0), "answer_citations_supported", F.col("verified_rate") >= VERIFIED),
        entry(audited & F.coalesce("require_clean", F.lit(False)), "clean_audit", F.col("is_clean") & (F.col("cited") > 0)),
    )
    every = F.concat(F.filter(fixed, lambda x: x.isNotNull()), needles("must_cite", "cites:", lambda x: F.contains(low, x)), needles("must_not", "excludes:", lambda x: ~F.contains(said, x)))
    every = F.when(F.col("error").isNull() & F.col("outcome").isNotNull(), every).otherwise(F.slice(every, 1, 0))
    r = r.withColumn("list", every)
    passed = (F.size("list") > 0) & F.forall("list", lambda x: x["value"])
    return r.select(
        "id", F.map_from_entries(F.array_distinct("list")).alias("checks"), passed.alias("passed"), F.coalesce("expect_route", F.lit("")).alias("expect_route"), F.get(expected, F.lit(0)).alias("expected"), "route", "outcome",
        F.round("support_rate", 3).alias("support_rate"), "rounds", F.when(audited & (F.col("checked") > 0), F.round("verified_rate", 3)).alias("verified_rate"), F.when(audited, F.col("cited")).otherwise(0).alias("cited"), F.when(audited, F.col("fabricated")).otherwise(0).alias("fabricated"), "cost", "seconds", "error",
    )


def eval_summary(results: DataFrame) -> DataFrame:
    """Rows of case_checks() -> one row of the summary's metrics; null where no case counts for one."""
    route = F.col("expect_route") != ""
    exact, over = F.col("route") == F.col("expect_route"), (F.col("route") == "hybrid") & (F.col("expect_route") != "hybrid")
    abstain, answer = F.col("expected") == "abstained", F.col("expected") == "answered"
    injection = F.element_at("checks", "injection_detected")

    def share(of, when=None, digits=3):
        x = F.coalesce(of, F.lit(False)).cast("double") if when is not None else of
        return F.round(F.avg(x if when is None else F.when(when, x)), digits)

    def number(condition):
        return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0))

    def mean(c, digits):
        return F.coalesce(F.round(F.sum(F.coalesce(c, F.lit(0.0))) / F.nullif(F.count(F.lit(1)), F.lit(0)), digits), F.lit(0.0))

    return results.agg(
        F.count(F.lit(1)).alias("cases"), number(F.col("passed")).alias("passed"), F.coalesce(share(F.col("passed").cast("double")), F.lit(0.0)).alias("pass_rate"),
        share(exact, route).alias("route_accuracy"), share(over, route).alias("route_over_retrieval"), F.round(F.avg("verified_rate"), 3).alias("answer_citation_validity"),
        number(is_answer(F.col("outcome")) & (F.coalesce("cited", F.lit(0)) == 0)).alias("answers_with_no_citations"), number(F.col("fabricated") > 0).alias("fabricated_citation_cases"),
        share(F.col("outcome") == "abstained", abstain).alias("abstain_precision"), share(F.col("outcome").isin("abstained", "clarify"), answer).alias("false_abstention"),
        share(injection, injection.isNotNull()).alias("injection_detection"), mean("support_rate", 3).alias("mean_support_rate"), mean("rounds", 2).alias("mean_rounds"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("total_cost_usd"), mean("seconds", 2).alias("mean_latency_s"), number(F.coalesce("error", F.lit("")) != "").alias("errors"),
    )


def metrics(summary: DataFrame) -> DataFrame:
    """A summary's row as (metric, value, cases), null metrics left out."""
    names = [c for c in summary.columns if c != "cases"]
    return summary.select("cases", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).filter("m.value is not null").select("m.metric", "m.value", "cases")


def regressions(new: DataFrame, base: DataFrame, noise: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, cases) of two runs -> metric, before, now, delta, verdict. Cost and time may drift by a share of what
    they were; runs over different numbers of cases are not compared."""
    both = new.select("metric", F.col("value").alias("now"), "cases").join(base.select("metric", F.col("value").alias("before"), F.col("cases").alias("cases_before")), "metric")
    delta = F.col("now") - F.col("before")
    worse = F.when(F.col("metric").isin(*LOWER_IS_BETTER), delta > 1e-9).otherwise(delta < -1e-9)
    band = F.coalesce(*[F.when(F.col("metric") == k, F.lit(v)) for k, v in (NOISE if noise is None else noise).items()], F.lit(0.0))
    small = (F.col("before") != 0) & (F.abs(delta) / F.abs("before") <= band)
    verdict = F.when(F.col("cases") != F.col("cases_before"), "unlike samples").when(worse & ~small, "regressed").otherwise("ok")
    return both.select("metric", "before", "now", F.round(delta, 6).alias("delta"), verdict.alias("verdict"))


def write_results(results: DataFrame, path: str) -> None:
    results.withColumn("checks", F.to_json("checks")).write.mode("overwrite").json(path)


def report_lines(results: DataFrame) -> DataFrame:
    """A line of text for each case: PASS, FAIL or ERROR, route, outcome, support and the checks that failed."""
    failed = F.array_join(F.array_sort(F.map_keys(F.map_filter("checks", lambda k, v: ~v))), ", ")
    mark = F.when(F.col("passed"), "PASS").when(F.coalesce("error", F.lit("")) != "", "ERROR").otherwise("FAIL")
    return results.select("id", F.concat_ws(" ", "id", mark, "route", "outcome", F.format_string("%.2f", F.coalesce("support_rate", F.lit(0.0))), F.coalesce(F.nullif("error", F.lit("")), F.nullif(failed, F.lit("")), F.lit("all ok"))).alias("line"))


# ---- annotators --------------------------------------------------------------------------------------


def _latest(labels: DataFrame) -> DataFrame:
    return labels.groupBy("annotator", "item_id").agg(F.max("label").alias("label"))


def shared_labels(labels: DataFrame) -> DataFrame:
    """labels (annotator, item_id, label) -> item_id, labels in the annotators' order, of the items that all of them labelled."""
    own = _latest(labels)
    everyone = own.agg(F.countDistinct("annotator").alias("everyone"))
    items = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("annotator", "label"))), lambda x: x["label"]).alias("labels"))
    return items.join(F.broadcast(everyone), F.col("n") == F.col("everyone")).select("item_id", "labels")


def agreement_report(labels: DataFrame) -> DataFrame:
    """labels -> one row: method (cohen for two annotators, fleiss for more), kappa, items compared, annotators. A retest, which is
    the same person again, belongs in retest_report()."""
    own = labels.filter(~F.col("annotator").endswith("-retest"))
    both = shared_labels(own)
    raters = own.select("annotator").distinct().count()
    if raters < 2:
        return both.agg(F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("kappa"), F.lit(0).cast("long").alias("items"), F.lit(raters).cast("long").alias("annotators"))
    if raters == 2:
        k = cohen_kappa(both.select(F.get("labels", F.lit(0)).alias("a"), F.get("labels", F.lit(1)).alias("b"))).select("kappa", "items")
    else:
        k = fleiss_kappa(both.select(F.col("item_id").alias("item"), F.explode("labels").alias("label"))).select("kappa", "items")
    return k.select(F.lit("cohen" if raters == 2 else "fleiss").alias("method"), F.round("kappa", 3).alias("kappa"), "items", F.lit(raters).cast("long").alias("annotators"))


def retest_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """(item_id, label) of one annotator twice -> one row: items, changed, stability, kappa, reliable. Self-consistency, which can't
    show a guideline that is misread the same way twice."""
    both = first.select("item_id", F.col("label").alias("a")).join(second.select("item_id", F.col("label").alias("b")), "item_id")
    changed = both.agg(F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0)).alias("changed"))
    out = cohen_kappa(both).select("items", "kappa", "reading").join(F.broadcast(changed))
    return out.select("items", "changed", F.round(1 - F.col("changed") / F.nullif("items", F.lit(0)), 3).alias("stability"), F.round("kappa", 3).alias("kappa"), "reading", (F.col("items") >= RELIABLE_RETEST).alias("reliable"))


def majority_share(labels: DataFrame) -> DataFrame:
    """labels -> item_id, label (the commonest; ties to the smaller), share, n."""
    n = _latest(labels).groupBy("item_id", "label").agg(F.count(F.lit(1)).alias("c"))
    top = n.groupBy("item_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "label")).alias("top"), F.sum("c").alias("n"))
    return top.select("item_id", F.col("top.label").alias("label"), F.round(-F.col("top.c") / F.col("n"), 3).alias("share"), "n")


def gold(labels: DataFrame, adjudicated: DataFrame | None = None) -> DataFrame:
    """Gold labels: what all annotators agree on, else what was adjudicated (item_id, label): item_id, label, agreement, adjudicated."""
    shared = shared_labels(labels).select("item_id", F.explode("labels").alias("label"), F.col("item_id").alias("annotator"))
    share = majority_share(shared.withColumn("annotator", F.monotonically_increasing_id().cast("string")))
    unanimous = share.filter("share = 1").select("item_id", "label", F.col("share").alias("agreement"), F.lit(False).alias("adjudicated"))
    if adjudicated is None:
        return unanimous
    settled = share.filter("share < 1").join(adjudicated.select("item_id", F.col("label").alias("settled")), "item_id")
    return unanimous.unionByName(settled.select("item_id", F.col("settled").alias("label"), F.col("share").alias("agreement"), F.lit(True).alias("adjudicated")))


def score_against_gold(items: DataFrame, golden: DataFrame) -> DataFrame:
    """items (item_id, pipeline_verdict), gold() -> one row: scored items, confusion, precision, recall, f1 and the share of gold labels
    that were adjudicated."""
    met = golden.join(items.filter("pipeline_verdict is not null"), "item_id").select(F.col("label").isin(*POSITIVE).alias("gold"), (F.col("pipeline_verdict") == "accepted").alias("predicted"))
    share = golden.agg(F.round(F.avg(F.col("adjudicated").cast("double")), 3).alias("adjudicated_share"))
    return confusion(met).join(F.broadcast(share))


def labelling_order(items: DataFrame, annotator: str, done: DataFrame | None = None) -> DataFrame:
    """items in an order of the annotator's own that is the same every time, those already labelled left out: adds order_key."""
    todo = items if done is None else items.join(done.select("item_id").distinct(), "item_id", "left_anti")
    key = F.sha2(F.concat(F.lit(annotator + "\0"), F.col("item_id").cast("string")), 256)
    return todo.withColumn("order_key", key).orderBy("order_key", "item_id")


def retest_sample(labels: DataFrame, annotator: str, n: int) -> DataFrame:
    """So many of an annotator's items for a second pass, by hash: the feature is the limit."""
    own = labels.filter(F.col("annotator") == annotator).select("item_id").distinct()
    return own.orderBy(F.sha2(F.concat(F.lit(annotator + "-retest\0"), F.col("item_id").cast("string")), 256), "item_id").limit(n)

"""Agreement of annotators, scores against gold labels, and comparison of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How many joint items make a kappa reliable, and the bands of its reading by their floors.
RELIABLE = 100
BANDS = ((0.81, "almost perfect"), (0.61, "substantial"), (0.41, "moderate"), (0.21, "fair"), (0.01, "slight"))


def reading(kappa):
    out = F.when(kappa.isNull(), F.lit(None).cast("string"))
    for floor, name in BANDS:
        out = out.when(kappa >= floor, name)
    return out.otherwise("poor")


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> one row: items, observed, expected, kappa, reliable, reading. Null where nothing was
    labelled; 1 where both annotators only ever gave one same label."""
    table = pairs.filter("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    same = table.agg(F.sum("n").alias("items"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agreed"))
    left, right = table.groupBy(F.col("a").alias("x")).agg(F.sum("n").alias("na")), table.groupBy(F.col("b").alias("y")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("x") == F.col("y")).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("products"))
    out = same.join(F.broadcast(chance)).select(F.coalesce("items", F.lit(0)).cast("long").alias("items"), (F.col("agreed") / F.nullif("items", F.lit(0))).alias("o"), (F.coalesce("products", F.lit(0.0)) / F.nullif(F.col("items").cast("double") * F.col("items"), F.lit(0.0))).alias("e"))
    kappa = F.when(F.col("e") == 1, F.when(F.col("o") == 1, 1.0).otherwise(0.0)).otherwise((F.col("o") - F.col("e")) / F.nullif(1 - F.col("e"), F.lit(0.0)))
    return out.select("items", F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.round(kappa, 6).alias("kappa"), (F.col("items") >= RELIABLE).alias("reliable"), reading(kappa).alias("reading"))


def fleiss_kappa(labels: DataFrame) -> DataFrame:
    """labels (item, label), the same number of raters for every item -> one row: items, raters, kappa."""
    counts = labels.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    items = counts.groupBy("item").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    total = items.agg(F.count(F.lit(1)).alias("items"), F.max("n").alias("raters"), F.avg(F.col("same") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))).alias("p"), F.sum("n").alias("all"))
    share = counts.groupBy("label").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"))
    e = F.col("squares") / (F.col("all").cast("double") * F.col("all"))
    return total.join(F.broadcast(share)).select("items", "raters", F.round(F.when(e == 1, 1.0).otherwise((F.col("p") - e) / F.nullif(1 - e, F.lit(0.0))), 6).alias("kappa"))


def confusion(pairs: DataFrame) -> DataFrame:
    """pairs (gold boolean, predicted boolean) -> tp, fp, fn, tn, precision, recall, f1."""

    def count(c, name):
        return F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)

    g, p = F.col("gold"), F.col("predicted")
    out = pairs.agg(count(g & p, "tp"), count(~g & p, "fp"), count(g & ~p, "fn"), count(~g & ~p, "tn"))

    def ratio(a, b):
        return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)

    return out.select("tp", "fp", "fn", "tn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def compare(new: DataFrame, base: DataFrame, band: float, lower_is_better: tuple[str, ...]) -> DataFrame:
    """Metrics (metric, value, cases) of two runs -> metric, delta, verdict. Runs over different numbers of
    cases are not compared."""
    both = new.join(base.select("metric", F.col("value").alias("before"), F.col("cases").alias("cases_before")), "metric")
    delta = F.round(F.col("value") - F.col("before"), 6)
    good = F.when(F.col("metric").isin(*lower_is_better), -delta).otherwise(delta)
    verdict = F.when(F.col("cases") != F.col("cases_before"), "unlike samples").when(F.abs(delta) <= band, "same").when(good > 0, "better").otherwise("worse")
    return both.select("metric", delta.alias("delta"), verdict.alias("verdict"))

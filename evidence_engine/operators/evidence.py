"""Evidence: numbered, taken from the web or from chunks, gathered, ranked, packed to a budget and fenced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import host, registrable_domain, token_count, truncate_tokens
from .governance import wrapped
from .grounding import first_per_key

# Tokens that a passage's header costs, the least that is worth showing of a cut passage, and the marks.
HEADER_COST, LEAST_CUT = 24, 120
CUT_MARK, SNIPPET_MARK, NOTHING = " […truncated]", "(search snippet only, page not retrieved) ", "(no evidence retrieved)"


def numbered(hits: DataFrame, run: str = "run_id", order: str = "rank", prefix=None) -> DataFrame:
    """hits plus source_id: S1, S2, ... in order in each run, or with another prefix (a column or text) before the number."""
    prefix = F.lit("S") if prefix is None else F.lit(prefix) if isinstance(prefix, str) else prefix
    return hits.withColumn("source_id", F.concat(prefix, F.row_number().over(Window.partitionBy(run).orderBy(order)).cast("string")))


def hop_prefix(hop):
    return F.concat(F.lit("H"), hop.cast("string"), F.lit("x"))


def distinct_urls(results: DataFrame, key: str = "url") -> DataFrame:
    """results (run_id, rank, url, ...) with each url of a run kept where it comes first; key: another column that tells pages apart."""
    return first_per_key(results, ["run_id", key], "rank")


def web_evidence(results: DataFrame, pages: DataFrame, chunk_tokens: int = 320, start: int = 1, key: str = "url") -> DataFrame:
    """results (run_id, rank, url, title, snippet), pages (url, text) -> run_id, source_id, label, source, origin, url.

    A page's text is cut to four chunks; without one the snippet stands in, marked; without either the result is left out.
    Numbers follow the place among the run's results, those left out included. Results meet their pages by url; where one url
    stands for several pages, key names a column of both tables that tells them apart. Of several texts of a page the first in
    the order of texts that isn't blank is taken, so a result comes once."""
    body = F.trim(F.coalesce("page_text", F.lit("")))
    texts = pages.groupBy(F.col(key).alias("_u")).agg(F.min(F.when(F.trim("text") != "", F.col("text"))).alias("page_text"))
    met = results.join(texts, F.col(key) == F.col("_u"), "left")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("rank")) + F.lit(start - 1)
    source = F.when(body != "", truncate_tokens(body, 4 * chunk_tokens)).when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit(SNIPPET_MARK), "snippet"))
    label = F.concat(F.coalesce(F.nullif("title", F.lit("")), "url"), F.lit(" ["), F.coalesce(F.nullif(host(F.col("url")), F.lit("")), "url"), F.lit("]"))
    out = met.withColumn("source_id", F.concat(F.lit("W"), place.cast("string"))).withColumn("source", source)
    return out.filter("source is not null").select("run_id", "source_id", label.alias("label"), "source", F.lit("web").alias("origin"), "url")


def gather(local: DataFrame, hops: DataFrame, fetched: DataFrame, pool: DataFrame, runs: DataFrame) -> DataFrame:
    """One round's evidence for each of runs (run_id, round, route, web_available): the hops' first in round 1 unless local
    evidence has their id, then local evidence unless the route is web, then for web and hybrid routes the pages held from
    earlier rounds if the route is hybrid and there are any, else those fetched now. Columns as in `local`, with group 0 to 2."""
    columns = local.columns
    r = runs.select(F.col("run_id").alias("_run"), "round", "route", "web_available")
    of_run = F.col("run_id") == F.col("_run")
    ours = local.join(r.filter(F.col("route").isin("local", "hybrid")), of_run, "left_semi")
    taken = ours.select(F.col("run_id").alias("_run"), F.col("source_id").alias("_id"))
    lead = hops.join(r.filter("round = 1"), of_run, "left_semi").join(taken, of_run & (F.col("source_id") == F.col("_id")), "left_anti")
    web = r.filter(F.col("route").isin("web", "hybrid") & F.col("web_available"))
    held = pool.select(F.col("run_id").alias("_held")).distinct()
    again = web.filter("route = 'hybrid'").join(held, F.col("_run") == F.col("_held"), "left_semi")
    fresh = web.join(again.select(F.col("_run").alias("_again")), F.col("_run") == F.col("_again"), "left_anti")
    parts = [lead, ours, pool.join(again, of_run, "left_semi").unionByName(fetched.join(fresh, of_run, "left_semi"))]
    out = [p.select(*columns, F.lit(i).alias("group")) for i, p in enumerate(parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def ranked(evidence: DataFrame, assessed: DataFrame) -> DataFrame:
    """evidence (run_id, source_id, origin, score, place, ...) plus rank: local passages keep their places and come first, web
    ones follow by quality, then by score, both falling."""
    known = assessed.select(F.col("source_id").alias("_s"), "quality")
    met = evidence.join(known, F.col("source_id") == F.col("_s"), "left").drop("_s")
    web = F.col("origin") == "web"
    order = Window.partitionBy("run_id").orderBy(web, F.when(web, -F.coalesce("quality", F.lit(0.0))), F.when(web, -F.coalesce("score", F.lit(0.0))), "place")
    return met.withColumn("rank", F.row_number().over(order))


def packed(evidence: DataFrame, budget: int) -> DataFrame:
    """evidence (run_id, rank, source_id, label, source, url) -> what fits a token budget: run_id, rank, source_id, tokens, cut, block.

    Passages are taken whole in order up to the first that overflows; of that one so much is shown as is left, if
    that is over 120 tokens, and nothing after it. A running sum and the place of the first overflow."""
    header = token_count(F.concat_ws(" ", "source_id", "label", F.coalesce("url", F.lit("")))) + HEADER_COST
    w = Window.partitionBy("run_id").orderBy("rank")
    e = evidence.withColumn("header", header).withColumn("cost", token_count(F.col("source")) + F.col("header"))
    e = e.withColumn("upto", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("over", F.sum((F.col("upto") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(budget) - (F.col("upto") - F.col("cost")) - F.col("header")
    e = e.withColumn("left", left).filter((F.col("over") == 0) | ((F.col("over") == 1) & (F.col("left") > LEAST_CUT)))
    cut = F.col("over") == 1
    body = F.when(cut, F.concat(truncate_tokens(F.col("source"), F.col("left").cast("int")), F.lit(CUT_MARK))).otherwise(F.col("source"))
    return e.select("run_id", "rank", "source_id", F.when(cut, F.col("left")).otherwise(F.col("cost") - F.col("header")).cast("long").alias("tokens"), cut.alias("cut"), wrapped(F.col("source_id"), F.col("label"), body, F.coalesce("url", F.lit(""))).alias("block"))


def prompt_text(blocks: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, evidence: each run's packed blocks as one text, or a note that there are none."""
    text = blocks.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("evidence"))
    return runs.select("run_id").join(text, "run_id", "left").select("run_id", F.coalesce("evidence", F.lit(NOTHING)).alias("evidence"))


def domains(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("domain", registrable_domain(F.col("url")))

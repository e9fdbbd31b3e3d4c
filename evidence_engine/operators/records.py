"""What a run leaves behind: the audit chain, the evidence ledger and the embedding cache, as tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .governance import in_order

# The events of an audit record.
EVENTS = ("query", "access_granted", "access_denied", "injection", "contradiction", "answered", "abstained")


# ---- audit -------------------------------------------------------------------------------------------


def payload(*columns: str):
    """What a record's hash covers besides its predecessor: the columns as JSON, nulls kept, in the order named."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def append(events: DataFrame, key: str, order: str, columns: list[str], log: DataFrame | None = None) -> DataFrame:
    """New records of a hash chain for each key: events plus payload, prev_hash and record_hash, ready to be appended.

    record_hash is the sha256 of prev_hash, a separator and the payload, and prev_hash the predecessor's record_hash,
    so a hash commits to all that went before. The first follows the tail of `log` where that has the key, else
    the empty string. Writing is a fold in order; a key's records stream through it."""
    made = events.withColumn("payload", payload(*columns))
    if log is not None:
        made = made.join(tails(log, key, order).select(F.col(key).alias("_k"), F.col("record_hash").alias("tail")), F.col(key) == F.col("_k"), "left").drop("_k")
    else:
        made = made.withColumn("tail", F.lit(""))
    kinds = {f.name: f.dataType.simpleString() for f in made.schema}

    def step(state, r):
        prev = (getattr(r, "tail") or "") if state is None else state
        own = hashlib.sha256(f"{prev}\u0001{r.payload}".encode()).hexdigest()
        return own, (*(getattr(r, c) for c in names), prev, own)

    names = [key, order, "payload"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", prev_hash string, record_hash string"
    return in_order(made.select(*names, "tail"), key, [order], step, schema)


def tails(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record_hash of each key, from which a chain goes on."""
    return log.groupBy(key).agg(F.max_by("record_hash", order).alias("record_hash"))


def verify(log: DataFrame, key: str, order: str) -> DataFrame:
    """A written log (key, order, payload, prev_hash, record_hash) -> one row a key: records, broken_link and broken_content
    (how many), valid, and broken_at, the first record that fails. In parallel from what is stored: a record must link to the
    record_hash before it and hash to its own."""
    before = F.coalesce(F.lag("record_hash").over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    link = ~F.col("prev_hash").eqNullSafe(before)
    content = ~F.col("record_hash").eqNullSafe(F.sha2(F.concat(F.coalesce("prev_hash", F.lit("")), F.lit("\u0001"), F.coalesce("payload", F.lit(""))), 256))
    seen = log.withColumn("link", link).withColumn("content", content)
    out = seen.groupBy(key).agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("link").cast("long")).alias("broken_link"), F.sum(F.col("content").cast("long")).alias("broken_content"), F.min(F.when(F.col("link") | F.col("content"), F.col(order))).alias("broken_at"))
    return out.withColumn("valid", F.col("broken_at").isNull())


def read_log(spark, path: str, schema: str, tenant: str | None = None) -> DataFrame:
    """Records of a log of JSON lines; lines that aren't records are left out, and other tenants' too if one is named."""
    log = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return log if tenant is None else log.filter(F.col("tenant") == tenant)


def run_records(runs: DataFrame) -> DataFrame:
    """runs (run_id, subject, tenant, question, granted, denied, injections, n_contradictions, outcome, confidence, cited) ->
    their audit records (run_id, nth, event, subject, tenant, detail as JSON). The question is hashed, not stored; events
    without content (nothing granted, denied or found) have no record."""
    q = F.substring(F.sha2(F.coalesce("question", F.lit("")), 256), 1, 16).alias("question_hash")

    def names(c):
        return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))

    def record(nth, event, when, *detail):
        return F.when(when, F.struct(F.lit(nth).alias("nth"), event.alias("event"), F.to_json(F.struct(q, *detail)).alias("detail")))

    answered = F.col("outcome").isin("answered", "partial")
    records = F.array(
        record(0, F.lit("query"), F.lit(True), F.char_length(F.coalesce("question", F.lit(""))).alias("question_chars")),
        record(1, F.lit("access_granted"), F.size(names("granted")) > 0, names("granted").alias("documents")),
        record(2, F.lit("access_denied"), F.size(names("denied")) > 0, names("denied").alias("documents")),
        record(3, F.lit("injection"), F.size(names("injections")) > 0, names("injections").alias("kinds")),
        record(4, F.lit("contradiction"), F.col("n_contradictions") > 0, F.col("n_contradictions").alias("count")),
        record(5, F.when(answered, "answered").otherwise("abstained"), F.lit(True), "outcome", "confidence", names("cited").alias("cited")),
    )
    return runs.select("run_id", "subject", "tenant", F.inline(F.filter(records, lambda r: r.isNotNull())))


# ---- ledger ------------------------------------------------------------------------------------------


def content_hash(text):
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def ledger_evidence(evidence: DataFrame) -> DataFrame:
    """evidence (run_id, round, source_id, raw, source, ...) -> one snapshot a (run, source): the first round's, as a claim was
    checked against that. Adds raw_hash, sanitized_hash and was_modified."""
    first = Window.partitionBy("run_id", "source_id").orderBy("round")
    kept = evidence.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    return kept.withColumn("raw_hash", content_hash(F.col("raw"))).withColumn("sanitized_hash", content_hash(F.col("source"))).withColumn("was_modified", F.col("raw_hash") != F.col("sanitized_hash"))


def ledger_edges(pairs: DataFrame) -> DataFrame:
    """Verdicts -> an edge for each claim and citation, failures included: the id as known, else as cited, with the overlap, the
    missing values and the passage's content hash."""
    name = F.coalesce("source_id", F.col("citation"), F.lit(""))
    return pairs.select("run_id", "claim_id", "claim", name.alias("source_id"), "verdict", F.round("overlap", 6).alias("overlap"), F.array_join("missing", ",").alias("missing"), content_hash(F.col("source")).alias("content_hash"))


def sources_for(edges: DataFrame, claim: str, verdict: str = "supported") -> DataFrame:
    return edges.filter((F.col("claim") == claim) & (F.col("verdict") == verdict)).select("run_id", "source_id")


def claims_from(edges: DataFrame, source_id: str, verdict: str = "supported") -> DataFrame:
    return edges.filter((F.col("source_id") == source_id) & (F.col("verdict") == verdict)).select("run_id", "claim_id", "claim")


def integrity(evidence: DataFrame) -> DataFrame:
    """Snapshots whose texts no longer hash to what was recorded: run_id, source_id, broken (raw, sanitized)."""
    bad = F.filter(F.array(F.when(content_hash(F.col("raw")) != F.col("raw_hash"), "raw"), F.when(content_hash(F.col("source")) != F.col("sanitized_hash"), "sanitized")), lambda x: x.isNotNull())
    return evidence.withColumn("broken", bad).filter(F.size("broken") > 0).select("run_id", "source_id", F.array_join("broken", ",").alias("broken"))


def ledger_summary(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a run: sources, edges by verdict, passages that sanitising changed."""
    counts = edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("edges"), *[F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("supported", "dropped", "fabricated")])
    sources = evidence.groupBy("run_id").agg(F.count(F.lit(1)).alias("sources"), F.sum(F.col("was_modified").cast("long")).alias("modified"))
    out = sources.join(counts, "run_id", "full")
    return out.select("run_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sources", "edges", "supported", "dropped", "fabricated", "modified")])


def ledger_json(evidence: DataFrame, edges: DataFrame, include_text: bool = True) -> DataFrame:
    """run_id, json: each run's ledger as one document. Without texts the hashes still prove what was used."""
    shown = [c for c in evidence.columns if c != "run_id" and (include_text or c not in ("raw", "source"))]
    e = evidence.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("source_id", *[c for c in shown if c != "source_id"]))).alias("evidence"))
    g = edges.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "source_id", "verdict", "overlap", "missing"))).alias("edges"))
    totals = ledger_summary(evidence, edges)
    summary = F.struct(*[c for c in totals.columns if c != "run_id"])
    return totals.select("run_id", summary.alias("summary")).join(e, "run_id", "left").join(g, "run_id", "left").select("run_id", F.to_json(F.struct("run_id", "evidence", "edges", "summary")).alias("json"))


def save_ledger(evidence: DataFrame, edges: DataFrame, path: str, include_text: bool = True) -> None:
    """Freeze a ledger: written once as JSON lines, an error if it is there already."""
    ledger_json(evidence, edges, include_text).select("json").write.mode("error").text(path)


def annotation_items(edges: DataFrame, evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Edges met with the snapshots they name and their run's question -> distinct items to label: item_id, question, claim,
    source_id, source_text, pipeline_verdict. Accepted and rejected pairs alike, else recall couldn't be measured."""
    e = evidence.select(F.col("run_id").alias("_r"), F.col("source_id").alias("_s"), F.coalesce(F.nullif("source", F.lit("")), "raw").alias("source_text"))
    met = edges.join(e, (F.col("run_id") == F.col("_r")) & (F.col("source_id") == F.col("_s"))).filter("source_text <> ''").join(runs.select("run_id", "question"), "run_id")
    item = F.substring(F.sha1(F.concat_ws("\0", "claim", "source_id", F.substring("source_text", 1, 2000))), 1, 16)
    rows = met.select(item.alias("item_id"), "question", "claim", "source_id", "source_text", F.when(F.col("verdict") == "supported", "accepted").otherwise("rejected").alias("pipeline_verdict"))
    return rows.groupBy("item_id").agg(*[F.min_by(c, F.struct("question", "pipeline_verdict")).alias(c) for c in rows.columns[1:]])


# ---- embedding cache ---------------------------------------------------------------------------------


def text_key(text):
    """Names a text's vector whatever its place."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 24)


def cache_read(spark, path: str, model: str, version: int = 1) -> DataFrame:
    """Vectors of one model and version: text_key, vector. A missing cache is an empty one."""
    try:
        held = spark.read.parquet(path)
    except Exception as e:  # only where nothing is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "text_key string, vector array<float>")
    return held.filter((F.col("model") == model) & (F.col("version") == version)).select("text_key", "vector")


def cache_split(texts: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts (id, text) -> (hits with vector, distinct missing text_key and text)."""
    keyed = texts.withColumn("text_key", text_key(F.col("text")))
    return keyed.join(cached, "text_key"), keyed.join(cached, "text_key", "left_anti").groupBy("text_key").agg(F.min("text").alias("text"))


def cache_write(fresh: DataFrame, path: str, model: str, version: int = 1) -> None:
    """Append new vectors (text_key, vector), a partition for each model and version."""
    fresh.select("text_key", F.col("vector").cast("array<float>").alias("vector"), F.lit(model).alias("model"), F.lit(version).alias("version")).write.mode("append").partitionBy("model", "version").parquet(path)


def embed_cached(texts: DataFrame, cached: DataFrame, embed) -> DataFrame:
    """texts (id, text) with vectors: cached ones by join, others by embed(DataFrame text_key, text) -> text_key, vector, which
    sees each missing text once."""
    _, missing = cache_split(texts, cached)
    known = cached.unionByName(embed(missing).select("text_key", F.col("vector").cast("array<float>").alias("vector")))
    return texts.withColumn("text_key", text_key(F.col("text"))).join(known, "text_key", "left")


def hit_rate(texts: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: hits, misses, hit_rate; 0 without lookups."""
    met = texts.select(text_key(F.col("text")).alias("text_key")).join(cached.select("text_key", F.lit(True).alias("hit")).distinct(), "text_key", "left")
    n = met.agg(F.coalesce(F.sum(F.coalesce("hit", F.lit(False)).cast("long")), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("n"))
    return n.select("hits", (F.col("n") - F.col("hits")).alias("misses"), F.when(F.col("n") > 0, F.round(F.col("hits") / F.col("n"), 3)).otherwise(0.0).alias("hit_rate"))

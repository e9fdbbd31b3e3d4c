"""Streaming forms: event windows with late data, breakers, budgets, the audit chain, the ledger, the cache, callbacks."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records
from ..operators.governance import step_breaker


def event_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """events (ts, event_type, value), batch or stream -> counts and sums by tumbling window."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "total")


def breaker_stream(calls: DataFrame, threshold: int = 3, cooldown: float = 30.0) -> DataFrame:
    """A stream of calls (name, at, seq, ok) -> name, seq, decision; each name's breaker is kept as state."""

    def update(key, batches, state):
        held = state.get if state.exists else (0, float("nan"))
        current = (held[0], None if pd.isna(held[1]) else held[1])
        pdf = pd.concat(list(batches)).sort_values(["at", "seq"])
        out = []
        for r in pdf.itertuples():
            current, decision = step_breaker(current, r.at, r.ok, threshold, cooldown)
            out.append(decision)
        state.update((current[0], float("nan") if current[1] is None else current[1]))
        yield pd.DataFrame({"name": pdf["name"], "seq": pdf["seq"], "decision": out})

    return calls.groupBy("name").applyInPandasWithState(update, "name string, seq long, decision string", "failures int, opened double", "append", "NoTimeout")


def budget_stream(calls: DataFrame, max_cost: float, max_calls: int, max_seconds: float) -> DataFrame:
    """A stream of calls (run_id string, seq, elapsed, cost) -> run_id, seq, calls, spent, reason: what each run has used up to the
    call and which cap it has then reached, time before cost before calls, null while there is room."""

    def update(key, batches, state):
        calls_, spent = state.get if state.exists else (0, 0.0)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            calls_, spent = calls_ + 1, spent + r.cost
            reason = "time" if r.elapsed >= max_seconds else "cost" if spent >= max_cost else "calls" if calls_ >= max_calls else None
            out.append((key[0], r.seq, calls_, round(spent, 6), reason))
        state.update((calls_, spent))
        yield pd.DataFrame(out, columns=["run_id", "seq", "calls", "spent", "reason"])

    return calls.groupBy("run_id").applyInPandasWithState(update, "run_id string, seq long, calls int, spent double, reason string", "calls int, spent double", "append", "NoTimeout")


def audit_sink(path: str, key: str, order: str, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends each batch's records to the log at `path`, going on from the tail of what is there. A batch that is
    run again after a fault replaces its own records, so none is written twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = None
        if batch_id:
            with contextlib.suppress(FileNotFoundError):
                log = spark.read.parquet(path).filter(F.col("batch") < batch_id)
        made = records.append(batch, key, order, columns, log)
        made.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def ledger_stream(evidence: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of evidence (run_id, source_id, at, ...): the first record of a (run, source) goes on, later ones don't."""
    return evidence.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "source_id"])


def cache_stream(texts: DataFrame, cached: DataFrame) -> DataFrame:
    """A stream of texts (text, ...) -> those that a cache table lacks, with their text_key."""
    return texts.withColumn("text_key", records.text_key(F.col("text"))).join(cached.select("text_key").distinct(), "text_key", "left_anti")


def to_callback(callback: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hands events to a callback on the driver, row by row. What the
    callback raises is not the stream's affair."""

    def write(batch: DataFrame, _: int) -> None:
        for row in batch.toLocalIterator(prefetchPartitions=False):
            with contextlib.suppress(Exception):
                callback(row.asDict(recursive=True))

    return write

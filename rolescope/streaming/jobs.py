"""Structured Streaming jobs: incremental matching, freshness, running counters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rolescope.operators import normalize, query_match, stats
from rolescope.plans.spread import spread_input
from rolescope.settings import Settings


def stream_match(
    postings: DataFrame, queries: DataFrame, target: str, checkpoint: str, key: list[str],
    settings: Settings = Settings(), trigger: dict | None = None, on_partial: Callable[[DataFrame, int], None] | None = None,
):
    """Match landed postings as they arrive; `read_matches` reads what is there, `finish_matches` makes it one table.

    Queries are made ready once and again when their table changes, which a batch sees by a fingerprint of its
    rows. A batch writes its matches under its own folder and then its entry of the manifest, so that a batch
    that is run again replaces its own rows and a half-written one is never read. `on_partial` is called with
    the written rows of each batch and its number.
    """
    held: dict = {}

    def ready() -> query_match.PreparedQueries:
        stamp = queries.agg(F.count("*"), F.sum(F.xxhash64(*queries.columns).cast("decimal(38,0)"))).first()
        if held.get("stamp") != stamp:
            held.update(stamp=stamp, queries=query_match.prepare(queries, settings))
        return held["queries"]

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = query_match.match_queries(normalize.normalize_postings(spread_input(batch)), ready(), key, settings)
        part = f"{target}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(part)
        batch.sparkSession.createDataFrame([(batch_id, part)], MANIFEST).write.mode("overwrite").parquet(f"{target}/_manifest/{batch_id}")
        if on_partial is not None:
            on_partial(batch.sparkSession.read.parquet(part), batch_id)

    return (
        postings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"})).start()
    )


MANIFEST = "batch_id long, path string"


def _manifest(spark: SparkSession, target: str) -> list:
    """Parts to read; those that a final table took in are left out. One row per batch since."""
    rows = spark.read.schema(MANIFEST + ", upto long").option("recursiveFileLookup", "true").parquet(f"{target}/_manifest").collect()
    final = max((r for r in rows if r.upto is not None), key=lambda r: r.upto, default=None)
    return [r for r in rows if r == final or (r.upto is None and (final is None or r.batch_id > final.upto))]


def read_matches(spark: SparkSession, target: str) -> DataFrame:
    """All matches so far, from the final table where there is one and the batches after it."""
    return spark.read.parquet(*[r.path for r in _manifest(spark, target)])


def finish_matches(spark: SparkSession, target: str) -> DataFrame:
    """Write one final table in place of the batches so far; a reader sees the batches or the table, never both."""
    parts = _manifest(spark, target)
    upto, path = max(max(r.batch_id, r.upto if r.upto is not None else -1) for r in parts), f"{target}/_final/{uuid.uuid4().hex}"
    spark.read.parquet(*[r.path for r in parts]).write.parquet(path)
    spark.createDataFrame([(-1, path, upto)], MANIFEST + ", upto long").coalesce(1).write.mode("overwrite").parquet(f"{target}/_manifest/final-{upto}")
    return spark.read.parquet(path)


def stream_fresh(requests: DataFrame, ttl_hours: float, key: str = "url", ts: str = "ts") -> DataFrame:
    """Requests kept when those within the time to live of the last kept one are suppressed.

    State per key is one number. The distinct times of a batch are walked in order; a time before the last
    kept one is suppressed as well. State is dropped once the watermark passes its life.
    """
    gap = ttl_hours * 3600.0

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # distinct times only, batch by batch; then one jump per kept time instead of one step per request
        times = reduce(np.union1d, (np.unique(b["_s"].dropna()) for b in batches))
        kept, at = [], 0 if last is None else np.searchsorted(times, last + gap)
        while at < len(times):
            last = float(times[at])
            kept.append(last)
            at = max(at + 1, np.searchsorted(times, last + gap))
        if last is None:  # only requests without a time
            return
        state.update((last,))
        expiry = int((last + gap) * 1000)
        if expiry > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expiry)
        yield pd.DataFrame({key: [k[0]] * len(kept), "_s": kept})

    kind = requests.schema[key].dataType.simpleString()
    timed = requests.select(key, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, f"{int(gap)} seconds")
    rows = timed.withColumn("_s", F.col(ts).cast("double"))
    kept = rows.groupBy(key).applyInPandasWithState(
        keep, f"{key} {kind}, _s double", "last double", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(key, F.timestamp_seconds("_s").alias(ts))


def stream_source_stats(evaluated: DataFrame) -> DataFrame:
    """Running raw, matched and filtered counters per source (update mode)."""
    return stats.source_stats(evaluated)

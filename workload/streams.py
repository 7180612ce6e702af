"""Streaming jobs drained once over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolescope import schemas as S
from rolescope.operators import normalize, query_match, stats
from rolescope.streaming import jobs
from workload import query, sql as q, tables as b
from workload.tables import scratch
from workload.ranking import FRESH
from workload.normalizing import STATS


def stream(spark, d, name):
    """A table as a stream, be it one file or a folder of part files: a pattern may name either, a plain path only a folder."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}[.]parquet")


def drain(df, spark, name, mode="append"):
    """Run a stream to its end into a parquet folder (append) or a table of final counts (complete)."""
    out, state = scratch(spark, name), scratch(spark, name + "-state")
    writer = df.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(out).awaitTermination()
    else:
        writer.outputMode(mode).foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


def stream_postings(spark, d):
    # one small file is one task; the texts are spread before anything is computed on them
    docs = stream(spark, d, "documents").repartition(spark.sparkContext.defaultParallelism)
    rows = docs.select(
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), "source",
        F.concat(F.lit("https://example.org/doc/"), F.col("doc_id")).alias("source_url"),
        b.first_line().alias("title"), F.concat(F.lit("Group "), "source").alias("company"),
        F.col("lang").alias("location"), F.lit("unknown").alias("work_mode"), F.col("text").alias("description"),
        normalize.skill_mentions("text", b.TERMS).alias("required_skills"),
        normalize.domain_signals("text", b.DOMAINS, b.INDUSTRIES).alias("domain_signals"))
    return S.conform(rows, S.POSTING, keep=["ord"])


@query("stream_match", f"with {q.MATCH} select doc_id, matched, round_even(total * 100, 2) score from best")
def stream_match(spark, d):
    out, state = scratch(spark, "match"), scratch(spark, "match-state")
    jobs.stream_match(stream_postings(spark, d), b.queries(spark, d), out, state, ["ord"],
                      trigger={"availableNow": True}).awaitTermination()
    rows = jobs.finish_matches(spark, out)
    return rows.select(F.col("ord").alias("doc_id"), "query_match.matched", F.col("query_match.best_query_score").alias("score"))


@query("stream_fresh", FRESH)
def stream_fresh(spark, d):
    kept = jobs.stream_fresh(stream(spark, d, "events"), 24.0, key="user_id", ts="ts")
    return drain(kept, spark, "fresh").select("user_id", F.unix_micros("ts").alias("ts_us"))


@query("stream_source_stats", f"with {q.MATCH}, {STATS} select * from stats")
def stream_source_stats(spark, d):
    evaluated = query_match.match_queries(stream_postings(spark, d), b.queries(spark, d), ["ord"])
    return drain(jobs.stream_source_stats(evaluated), spark, "stats", "complete").select("source", *stats.COUNTERS)

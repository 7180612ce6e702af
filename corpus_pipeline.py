"""From raw documents to packed training bins, in five stages; each works on all that the one before kept."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from rolescope.llm import common, decontaminate, language_id, packing, simhash, suffix_dedup  # noqa: E402
from rolescope.session import ship_package  # noqa: E402

LEAST_SCORE = 0.2  # share of a text's grams that its language contains; clean prose has twice that at least


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    common.batches_of_bounded_bytes(spark)
    ship_package(spark, ROOT)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter or hardly a known gram go. The model
    learns from the same documents outside the held-out fold."""
    _ready(spark)
    model = language_id.train(docs.where(language_id.fold("doc_id", 3) != 1))
    judged = language_id.predict(docs.select(common.row(docs).alias("doc"), F.col("text")), model)
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the one with the least id."""
    _ready(spark)
    return simhash.keep_one(docs, distance=3)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated 200-byte strings, n_chars counted anew; documents left without a character
    go, unless they were empty before. A character of which some bytes go goes whole."""
    _ready(spark)
    out = suffix_dedup.remove_repeats(docs, width=200, as_text=True)
    changed = F.size("removed_spans") > 0
    kept = out.where(~changed | (F.col("kept") != "")).withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    _ready(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training bins."""
    _ready(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language), ("simhash", drop_near_duplicates), ("suffix_dedup", remove_repeated_strings),
    ("decontaminate", drop_contaminated), ("packing", pack_documents),
]
ORACLE_SQL = None  # fingerprints, language models and alignments are not SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed bins of the documents table; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

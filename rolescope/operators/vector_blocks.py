"""Best evidence by vectors: blocks of requirements meet their profile's blocks of evidence, in numpy.

Like `operators.evidence_index`, with a matrix product instead of postings lists. All pairs of a profile are scored;
none is a row, and a task holds two blocks of a bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolescope.functions import text as t
from rolescope.functions.vector_kernel import best_of_blocks
from rolescope.plans.spread import first_per_key
from rolescope.session import land

ASKED_BLOCK, HELD_BLOCK = 4096, 16384  # vectors in a block, on average
BLOCK_BYTES = 16 << 20                 # and bytes of them
FOUND = "_row bigint, _item bigint, similarity double"


def _whole(v: Column) -> Column:
    """A vector, null if one of its places is missing."""
    return t.let(v, lambda u: F.when(~F.exists(u, lambda x: x.isNull()), u))


def _blocks(rows: DataFrame, size: int, vector: str, name: str) -> DataFrame:
    """(profile_id, name): how many blocks a profile's rows are cut into."""
    return rows.groupBy("profile_id").agg(F.greatest(
        F.ceil(F.count("*") / size), F.ceil(F.sum(F.size(vector)) * 8 / BLOCK_BYTES)).cast("int").alias(name))


def retrieve_by_vectors(
    requirements: DataFrame, evidence: DataFrame, key: list[str], k: int, text: str, asked_vector: Column, held_vector: Column,
) -> DataFrame:
    """Top-k evidence of the same profile per requirement by the dot product, clamped to 0-1, earlier first.

    A missing vector, or one of another length, scores 1, as least() passes over a null. Items without a number and blank requirements are left out.
    """
    asked = land(requirements.where(t.strip(text) != "").select(*dict.fromkeys([*key, text]), _whole(asked_vector).alias("asked")).withColumn(
        "_row", F.monotonically_increasing_id()), "asked")
    held = land(evidence.where(F.col("ord").isNotNull()).select("profile_id", "ord", "text", "source_section", _whole(held_vector).alias("held")).withColumn(
        "_item", F.monotonically_increasing_id()), "held")
    parts = land(_blocks(asked, ASKED_BLOCK, "asked", "asked_parts").join(_blocks(held, HELD_BLOCK, "held", "held_parts"), "profile_id"), "parts")
    units = parts.agg(F.coalesce(F.sum("asked_parts"), F.lit(0))).first()[0]
    profiles = parts.count()
    # by number, so that tasks with little data and much work are not put together
    tasks = min(4 * units + 1, 4 * (units - profiles) + int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    asked_blocks = (
        asked.select("profile_id", "_row", "asked").join(parts, "profile_id").groupBy("profile_id", part("_row", "asked_parts").alias("part"))
        .agg(F.collect_list(F.struct("_row", "asked")).alias("_b"))
        .select("profile_id", "part", F.col("_b._row").alias("rows"), F.col("_b.asked").alias("asked")))
    held_blocks = (
        held.select("profile_id", "_item", "ord", "held").join(parts, "profile_id")
        .groupBy("profile_id", "asked_parts", part("_item", "held_parts").alias("held_part"))
        .agg(F.collect_list(F.struct("_item", F.col("ord").cast("long").alias("ord"), "held")).alias("_b"))
        .select("profile_id", F.explode(F.sequence(F.lit(0), F.col("asked_parts") - 1)).alias("part"),
                F.col("_b._item").alias("items"), F.col("_b.ord").alias("ords"), F.col("_b.held").alias("held")))
    at = ["profile_id", "part"]
    # merged, so that the evidence of a block of requirements comes in a row
    met = held_blocks.repartition(tasks, *at).join(asked_blocks.repartition(tasks, *at).hint("merge"), at)
    found = met.mapInArrow(lambda batches: best_of_blocks(batches, k), FOUND)
    rows = found.join(asked.drop("asked"), "_row").join(held.select(
        "_item", F.col("ord").alias("evidence_ord"), F.col("text").alias("evidence"), "source_section"), "_item")
    # rows of a repeated key share k places
    top = first_per_key(rows, key, [F.desc("similarity"), "evidence_ord"], k)
    return top.select(*key, text, "evidence_ord", "evidence", "source_section", "similarity")

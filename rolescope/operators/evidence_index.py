"""Best evidence by token Jaccard for profiles of any size, without a row for a pair that is compared.

Equal token sets ("bags") of a profile are one entry however many items repeat them. Bags of requirements and of
evidence are cut into blocks of bounded size, and every block of requirements meets its profile's blocks of
evidence one after the other in one task, through the postings lists of a block (`functions.evidence_kernel`). The
task keeps k items per requirement, so what is shuffled or written is the blocks, repeated per block that they meet,
and the best items. Requirements with fewer than k items in common with the evidence are filled with the
profile's first items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rolescope.functions import text as t
from rolescope.functions.evidence_kernel import best_of_blocks
from rolescope.plans.spread import first_per_key
from rolescope.session import land

ASKED_BLOCK = 32768  # bags of requirements in a block at most, on average
ASKED_LEAST = 8192   # and so many before smaller blocks give every slot one
HELD_BLOCK = 65536   # bags of evidence in a block, on average
TOP = "profile_id string, asked_bag binary, _top array<struct<neg: double, evidence_ord: bigint>>"


def _words(text: str) -> Column:
    """The sorted token set as one string; tokens hold no blank, so it is unambiguous."""
    return F.array_join(F.array_sort(t.token_set(text)), " ")


def _bag(words: Column) -> Column:
    """16 bytes that stand for a token set."""
    return F.unhex(F.md5(words))


def _bags(evidence: DataFrame, k: int) -> DataFrame:
    """(profile_id, bag, words, ords): each distinct token set with the first k items that have it."""
    rows = evidence.select("profile_id", "ord", _words("text").alias("words")).where("words <> ''")
    first = first_per_key(rows.withColumn("bag", _bag(F.col("words"))), ["profile_id", "bag"], ["ord"], k)
    held = first.groupBy("profile_id", "bag").agg(F.first("words").alias("words"), F.array_sort(F.collect_list("ord")).alias("ords"))
    return held.where(F.size("ords") > 0)  # an item without a number is not found


def _parts(asked: DataFrame, bags: DataFrame) -> DataFrame:
    """(profile_id, asked_parts, held_parts): the blocks of every profile that has both sides."""
    slots = 2 * asked.sparkSession.sparkContext.defaultParallelism
    blocks = lambda size: F.ceil(F.count("*") / size).cast("int")
    most = F.greatest(blocks(ASKED_BLOCK), F.least(F.lit(slots), blocks(ASKED_LEAST)))
    return asked.groupBy("profile_id").agg(most.alias("asked_parts")).join(
        bags.groupBy("profile_id").agg(blocks(HELD_BLOCK).alias("held_parts")), "profile_id")


def _best(asked: DataFrame, bags: DataFrame, k: int) -> DataFrame:
    """(profile_id, asked_bag, _top): up to k items that share a token, most similar and then earliest first."""
    parts = land(_parts(asked, bags), "parts")
    units, work = parts.agg(F.coalesce(F.sum("asked_parts"), F.lit(0)), F.count("*")).first()
    least = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by number, so that tasks with little data and much work are not put together
    tasks = min(4 * units + 1, 4 * (units - work) + least)
    part = lambda bag, n: F.pmod(F.xxhash64(bag), F.col(n)).cast("int")
    asked_blocks = (
        asked.join(parts, "profile_id").groupBy("profile_id", part("asked_bag", "asked_parts").alias("part"))
        .agg(F.collect_list(F.struct("asked_bag", "words")).alias("_b"))
        .select("profile_id", "part", F.col("_b.asked_bag").alias("asked_bags"), F.col("_b.words").alias("asked_words")))
    held_blocks = (
        bags.join(parts, "profile_id").groupBy("profile_id", "asked_parts", part("bag", "held_parts").alias("held_part"))
        .agg(F.collect_list(F.struct("words", "ords")).alias("_b"))
        .select("profile_id", F.explode(F.sequence(F.lit(0), F.col("asked_parts") - 1)).alias("part"),
                F.col("_b.words").alias("words"), F.col("_b.ords").alias("ords")))
    at = ["profile_id", "part"]
    # merged, so that the evidence of a block of requirements comes in a row; a task holds one pair of blocks at a time
    met = held_blocks.repartition(tasks, *at).join(asked_blocks.repartition(tasks, *at).hint("merge"), at)
    return met.mapInArrow(lambda batches: best_of_blocks(batches, k), TOP)


def retrieve_by_tokens(requirements: DataFrame, evidence: DataFrame, key: list[str], k: int, text: str) -> DataFrame:
    """Top-k evidence of the same profile per requirement, most similar and then earliest first.

    `evidence`: (profile_id, ord, text, source_section), ord unique within a profile. `key` identifies a requirement
    and holds profile_id; blank requirements give no rows, null texts count as blank. Blocks of a hot profile lie
    spread over the tasks, one block of its requirements in each.
    """
    asked_rows = land(
        requirements.where(t.strip(t.text_or_empty(text)) != "").select(*key, text)
        .withColumn("_words", _words(text)).withColumn("asked_bag", _bag(F.col("_words"))), "asked")
    asked = asked_rows.select("profile_id", "asked_bag", F.col("_words").alias("words")).dropDuplicates(["profile_id", "asked_bag"])
    bags = land(_bags(evidence, k), "bags")
    top = land(_best(land(asked.where("words <> ''"), "asked-bags"), bags, k), "top")
    return _filled(asked_rows, asked.drop("words"), top, evidence, key, k, text)


def _filled(asked_rows: DataFrame, asked: DataFrame, top: DataFrame, evidence: DataFrame, key: list[str], k: int, text: str) -> DataFrame:
    """Lists filled up to k by the first items without a common token, joined to the requirements and the items' texts."""
    # fewer than k items have a token in common where a list is short, so 2k - 1 first items hold enough others
    first = first_per_key(evidence.select("profile_id", "ord"), ["profile_id"], ["ord"], 2 * k - 1)
    first = first.groupBy("profile_id").agg(F.array_sort(F.collect_list("ord")).alias("_first"))
    own = F.coalesce("_top", F.array().cast(top.schema["_top"].dataType))
    others = F.transform(
        F.array_except("_first", F.transform(own, lambda e: e["evidence_ord"])),
        lambda o: F.struct(F.lit(0.0).alias("neg"), o.alias("evidence_ord")))
    lists = asked.join(top, ["profile_id", "asked_bag"], "left").join(first, "profile_id").select(
        "profile_id", "asked_bag", F.slice(F.concat(own, others), 1, k).alias("_list"))
    rows = asked_rows.join(lists, ["profile_id", "asked_bag"]).select(*key, text, F.explode("_list").alias("_e"))
    held = evidence.select("profile_id", F.col("ord").alias("evidence_ord"), F.col("text").alias("evidence"), "source_section")
    return rows.select(*key, text, "_e.evidence_ord", F.abs("_e.neg").alias("similarity")).join(
        held, ["profile_id", "evidence_ord"]).select(*key, text, "evidence_ord", "evidence", "source_section", "similarity")

"""Plan helpers that keep hot groups from landing in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rolescope.session import cut_lineage


def spread_input(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Repartition a scan only when its files give fewer splits than the cluster has slots."""
    wanted = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def gather_input(df: DataFrame, bytes_per_task: int = 16 << 20) -> DataFrame:
    """A scan in fewer tasks when it has more than its files' bytes are worth: every small file counts as 4 MB in a split."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-size // bytes_per_task))
    return df.coalesce(wanted) if df.rdd.getNumPartitions() > wanted else df


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], row_key: list[str], salts: int = 8, how: str = "inner"
) -> DataFrame:
    """Equi-join whose hot keys are cut into `salts` parts: the small side is repeated per salt."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*row_key), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, key: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """First n rows per key. Spark limits every input partition to n rows per key before the shuffle."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def rank_rows(
    df: DataFrame, part_by: list[str], order: list[tuple[str, bool]], ord_col: str, name: str = "rank",
) -> DataFrame:
    """Exact 1-based rank per group without sending a whole group to one task.

    Rows are cut into ranges of the sort order, whatever their groups' sizes, and written, so that both
    reads below see the same ranges. A group's rows per range are counted map-side; a running sum over
    the ranges of a group (as many as there are partitions at most) gives each range's offset, and only
    the rows of one range are numbered together. `order` holds (column, descending) pairs, `ord_col` is unique.
    """
    by = [F.col(c).desc() if down else F.col(c).asc() for c, down in order] + [F.col(ord_col).asc()]
    placed = cut_lineage(
        df.repartitionByRange(*[F.col(c).asc() for c in part_by], *by).withColumn("_at", F.spark_partition_id()))
    key = [*part_by, "_at"]
    before = W.partitionBy(*part_by).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*key).agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(c).alias(f"_of_{c}") for c in key], "_offset")
    )
    numbered = placed.withColumn("_inside", F.row_number().over(W.partitionBy(*key).orderBy(*by)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key])
    return numbered.join(offsets, same).select(
        *df.columns, (F.col("_offset") + F.col("_inside")).cast("long").alias(name))

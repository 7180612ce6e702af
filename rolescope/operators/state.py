"""State of finished work: a versioned table (key, fingerprint, output) beside the outputs themselves.

A version is written whole under a number of its own and becomes current by its entry among the commits. A job
that dies before that leaves the version before it current; a reader never sees half a version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COMMITS = "version long, path string"


def current_version(spark: SparkSession, target: str) -> tuple[int, str | None]:
    """(number, path) of the current version; (0, None) before the first."""
    try:
        commits = spark.read.schema(COMMITS).option("recursiveFileLookup", "true").parquet(f"{target}/_commits")
        last = commits.orderBy(F.desc("version")).first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    return (last.version, last.path) if last else (0, None)


def read_state(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The current state; no rows before the first commit."""
    _, path = current_version(spark, target)
    return spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)


def commit_state(state: DataFrame, target: str) -> int:
    """Make a whole state table current; its number."""
    spark = state.sparkSession
    version = current_version(spark, target)[0] + 1
    path = f"{target}/versions/{version}"
    state.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(version, path)], COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{target}/_commits/{version}")
    return version


def pending_inputs(inputs: DataFrame, state: DataFrame, outputs: DataFrame, key: list[str]) -> DataFrame:
    """Input rows still to be worked on, with `reason`: new, changed, or lost.

    `inputs` has the key and a fingerprint, `state` the same of finished work, `outputs` the keys whose output
    exists. A key is changed if its fingerprint differs from the state's, lost if it is equal but no output of it
    exists. Null keys equal each other. Rows of equal keys are judged one by one; a key that occurs more than
    once in `state` counts as finished for each of its fingerprints.
    """
    def same(a: DataFrame, b: DataFrame, columns: list[str]):
        out = F.lit(True)
        for c in columns:
            out = out & a[c].eqNullSafe(b[f"_{c}"])
        return out

    named = lambda df, *more: df.select(*[F.col(c).alias(f"_{c}") for c in key], *more).distinct()
    known, exact = named(state, F.lit(1).alias("_known")), named(state, F.col("fingerprint").alias("_fingerprint"), F.lit(1).alias("_exact"))
    made = named(outputs, F.lit(1).alias("_made"))
    plain = [c for c in inputs.columns]
    rows = inputs.join(known, same(inputs, known, key), "left").select(*plain, "_known")
    rows = rows.join(exact, same(rows, exact, [*key, "fingerprint"]), "left").select(*plain, "_known", "_exact")
    rows = rows.join(made, same(rows, made, key), "left").select(*plain, "_known", "_exact", "_made")
    reason = F.when(F.col("_known").isNull(), "new").when(F.col("_exact").isNull(), "changed").when(F.col("_made").isNull(), "lost")
    return rows.withColumn("reason", reason).where("reason is not null").select(*plain, "reason")


def with_finished(state: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The state after some work: finished rows in place of their keys' older ones."""
    ids = done.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    on = F.lit(True)
    for c in key:
        on = on & state[c].eqNullSafe(ids[f"_{c}"])
    return state.join(ids, on, "left_anti").unionByName(done.select(*state.columns).distinct())

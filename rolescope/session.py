"""Session settings and lineage cutting that survives losing an executor."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",  # pages and texts differ widely in size
}


def build_session(name: str = "rolescope", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; only a local session may fall back to /tmp."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        shared = tempfile.mkdtemp(prefix="rolescope-checkpoint-")
    context.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative operators call it once per round."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: lineage ends here, columns stay prunable."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession, root: str) -> None:
    """Send the Python package to the workers once per context; Arrow functions import it there."""
    context = spark.sparkContext
    if getattr(context, "_rolescope_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="rolescope-package-"), "rolescope.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "rolescope")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    context._rolescope_shipped = True

"""What several operators share: scratch tables, row keys, words, bounded bit filters."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolescope.session import ensure_checkpoint_dir

NO_ID = (1 << 63) - 1  # stands for a null doc_id: after every id
FILTER_BITS_MAX = 28  # a filter that travels to the tasks has at most 2**28 bits (32 MB)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches_of_bounded_bytes(spark: SparkSession) -> None:
    """Texts differ widely in length, so batches to Python are bounded in bytes and not only in rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def id_order(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def text_key(text: str = "text") -> Column:
    """With the id, it tells documents apart that share an id; rows equal in both have equal results."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def row(docs: DataFrame) -> Column:
    """All columns in one, whatever they are called."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(id_order(doc_id).alias("a"), text_key(text).alias("b"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of an Arrow column without nulls, copied nowhere."""
    column = pc.cast(column, pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "<i8", len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def filter_bits(n_keys: int, per_key: int = 16) -> int:
    """log2 of the bits for a filter over so many keys; beyond the bound only more false hits."""
    return min(FILTER_BITS_MAX, max(16, int(n_keys * per_key - 1).bit_length()))


def bit_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """Bytes of a filter of 2**bits bits with the lowest bits of each key set; `keys` has the long column key."""
    slot = F.col("key").bitwiseAND((1 << bits) - 1)
    words = (keys.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(key & 63 as int))").alias("bit"))
             .groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow())
    out = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    if words.num_rows:
        out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint8)


def in_filter(filter_bytes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.astype(np.uint64) & np.uint64(len(filter_bytes) * 8 - 1)
    return (filter_bytes[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

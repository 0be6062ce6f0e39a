"""Helpers that the text operators share: shared-folder tables, hold-out rule, word pattern."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from functools import cache

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tables import shared_dir

# Words are maximal runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model may learn from (null ids are held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


def give_back(result):
    """``result``, after memory that this Python worker has freed is handed back to the system.

    Idle workers would otherwise keep what their largest group needed.
    """
    pa.default_memory_pool().release_unused()
    _trim()(0)
    return result


def one_row_an_id(sample: DataFrame) -> DataFrame:
    """Of each id's rows the one with the smallest hash of its text."""
    others = [c for c in sample.columns if c not in ("doc_id", "text")]
    row = F.struct(F.xxhash64("text").alias("_hash"), "text", *others)
    return sample.groupBy("doc_id").agg(F.min(row).alias("_row")).select("doc_id", "_row.text", *[f"_row.{c}" for c in others])


def whole_texts(sample: DataFrame, most_bytes: int) -> DataFrame:
    """One row for each id of a sample of bounded ids, of no more than ``most_bytes`` of text together.

    Of an id's rows the one with the smallest hash of its text stays. Ids enter in order of their hashes,
    with their whole texts; those that do not fit any more are left out. The driver only sees the ids and sizes.
    """
    each = one_row_an_id(sample)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = each.select("doc_id", size.alias("size"), F.xxhash64("doc_id").alias("place")).toPandas()
    fits, left = [], most_bytes
    for r in sizes.sort_values(["place", "doc_id"]).itertuples():
        if r.size <= left:
            fits.append((int(r.doc_id),))
            left -= r.size
    if len(fits) == len(sizes):
        return each
    ids = sample.sparkSession.createDataFrame(fits, "doc_id long")
    return each.join(F.broadcast(ids), "doc_id")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A written table survives lost executors, unlike a local checkpoint.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs that nothing refers to.

    The first pass frees the frames that Python let go, the second the shuffles that only these held.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

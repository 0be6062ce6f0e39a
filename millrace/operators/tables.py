"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The configured folder; a temporary one only where none is configured and all runs in one process.

    On a cluster each machine would write to its own disk, so that a missing setting is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(spark, "_millrace_dir", None)
        if path is None:
            path = "file://" + tempfile.mkdtemp(prefix="millrace-")
            spark._millrace_dir = path
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: a short lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores: shuffled by ``key`` only if it comes in fewer parts than there are cores.

    A table in few files would leave cores idle under expressions that cost far more than a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` shuffled by ``key`` into several parts for each core, as many whatever adaptive execution would join.

    For expressions and windows that cost far more than the shuffle: parts as many as cores, and one more,
    take two rounds, and few parts make large sorts.
    """
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, key)


def over_distinct(df: DataFrame, keys: list[str], compute, name: str) -> DataFrame:
    """``df`` with the columns that ``compute`` adds to a table of the different values of ``keys``.

    Columns that are expensive to work out and depend on few values (names, places, reposted texts) are
    worked out once for each value, written, and joined back: by broadcast while the written table is
    small, else by a shuffle on a digest, so that long texts are compared by 16 bytes. Nulls are values.
    Values that ``compute`` leaves out get nulls.
    """
    digest = F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    values = df.select(*keys).distinct().withColumn("_digest", digest)
    found = cut(compute(values).drop(*keys), name)
    return df.withColumn("_digest", digest).join(found, "_digest", "left").drop("_digest")

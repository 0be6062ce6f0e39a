"""State tables that survive restarts: files by batch and bucket, and a manifest that says which of them count.

A batch writes new files only. A keyed table is cut into buckets by a hash of its key; a batch rewrites
the buckets that its rows touch and leaves the others where they are; a log table gets the batch's rows.
The manifest, written last, names for every bucket the batch that wrote it and the batches whose logs
count. What a failed attempt left behind is not named and is overwritten by the next; a batch that was
committed is not done again. Readers see one version, whole.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
NONE = -1  # no batch


@dataclass
class Version:
    """The tables after a batch: for every keyed table each bucket's batch, for every log the batches that count."""

    batch: int
    buckets: dict[str, list[int]] = field(default_factory=dict)
    logs: dict[str, list[int]] = field(default_factory=dict)


class Store:
    """Versioned tables under ``root``, a folder that all executors share. ``key`` names every table's key column."""

    def __init__(self, spark: SparkSession, root: str, key: str = "identity", buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.n = spark, root.rstrip("/"), key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int")

    def latest(self) -> Version | None:
        """The version that the last committed batch left."""
        try:
            rows = self.spark.read.schema("version string, batch int").json(f"{self.root}/manifest")
            last = rows.orderBy(F.desc("batch")).first()  # a row for each batch
        except AnalysisException:  # nothing was ever committed
            return None
        return Version(**json.loads(last.version)) if last else None

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that hold the rows' keys."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # one for each bucket at most

    def read(self, version: Version, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as of a version, or those of its buckets; partition columns alone choose the files.

        None if the version has no such rows.
        """
        batch, bucket = F.col("_batch"), F.col("_bucket")
        if name in version.buckets:
            held = version.buckets[name]
            chosen = {k: held[k] for k in (range(self.n) if buckets is None else buckets) if held[k] != NONE}
            by_batch: dict[int, list[int]] = {}
            for k, b in chosen.items():
                by_batch.setdefault(b, []).append(k)
            wanted = F.lit(False)
            for b, own in by_batch.items():
                wanted = wanted | ((batch == b) & bucket.isin(own))
            some = bool(chosen)
        else:
            wanted, some = batch.isin(version.logs.get(name, [])), bool(version.logs.get(name))
            wanted = wanted if buckets is None else wanted & bucket.isin(buckets)
        if not some:
            return None
        return self.spark.read.parquet(f"{self.root}/{name}").filter(wanted).drop("_batch", "_bucket")

    def _write(self, name: str, batch: int, rows: DataFrame) -> None:
        parted = rows.withColumn("_bucket", self.bucket())
        parted.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{name}/_batch={batch}")

    def commit(self, batch: int, keyed: dict[str, DataFrame], logs: dict[str, DataFrame], touched: list[int], before: Version | None = None) -> Version:
        """Write a batch's tables and then its manifest.

        ``keyed`` tables hold all rows of the touched buckets, as they are after the batch; ``logs`` hold
        the batch's own rows.
        """
        before = before or self.latest() or Version(NONE)
        for name, rows in (keyed | logs).items():
            self._write(name, batch, rows)
        after = Version(batch, dict(before.buckets), dict(before.logs))
        for name in keyed:
            held = list(before.buckets.get(name, [NONE] * self.n))
            for k in touched:
                held[k] = batch
            after.buckets[name] = held
        for name in logs:
            after.logs[name] = [*before.logs.get(name, []), batch]
        self._seal(after)
        return after

    def _seal(self, version: Version) -> None:
        row = self.spark.createDataFrame([(json.dumps(version.__dict__),)], "version string")
        row.coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/batch={version.batch}")

"""Asking, for every item that a chunk of documents holds, what all other chunks know of it.

Corpus statistics over items (shingles, n-grams, byte strings) would need a row for each occurrence.
Here documents lie in chunks of a few MB (dealt by hash, written once as a table bucketed by chunk, so
that later passes join to it without shuffling texts). A chunk sends its different items, sorted and
packed by bucket; a bucket's task merges what all chunks sent and answers each packet in the same order;
the chunk makes its items again and reads the answers. One bucket is in memory at a time. Frequent items
count once for each chunk, so that a hot item is no hot task.

A level deals items by ``STEP`` bits of their hash only, so that packets keep their size and number a
constant for each chunk. Where buckets would still be too large, relays stand between: a relay merges one
bucket of ``GROUP`` chunks, asks the next level by further bits as if it were a chunk, and hands the
answers down. Rows thus grow in proportion to the data, times the few levels.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, fresh_path, give_back, release

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
MOST_BUCKETS = 10_000  # files of the table of chunks; Spark allows 100,000 at most
STEP = 8
GROUP = 256
PACKET = "bucket long, chunk long, n int, data binary"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]


@dataclass
class Chunks:
    """A written table of documents with their chunk."""

    spark: SparkSession
    name: str
    path: str
    levels: list[int]  # the bits by which each level deals
    key_mask: np.uint64  # enough high bits of a hash to tell the items of this corpus apart, but for a few in a thousand

    def table(self, *columns: str) -> DataFrame:
        df = self.spark.table(self.name)
        return df.select("chunk", *columns) if columns else df

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def stage(docs: DataFrame, chunk_bytes: int | None = None) -> Chunks:
    """Write ``docs`` in chunks, dealt by a hash of id and text."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-total // (chunk_bytes or CHUNK_BYTES)))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long"))
    buckets = max(1, min(MOST_BUCKETS, n // 2))
    name, path = f"chunks_{uuid.uuid4().hex}", fresh_path(spark, "chunks")
    dealt = dealt.repartition(buckets, "chunk")
    dealt.write.bucketBy(buckets, "chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    del dealt
    release(spark)  # the shuffled texts are on disk once more until then
    bits = max(0, int(np.ceil(np.log2(max(1, total / BUCKET_BYTES)))))
    levels = [STEP] * (bits // STEP) + [bits % STEP] * (bits % STEP > 0)
    kept = min(64, max(40, int(total).bit_length() + 9))
    return Chunks(spark, name, path, levels or [0], np.uint64((1 << 64) - (1 << (64 - kept))))


def planes(values: np.ndarray) -> bytes:
    """Numbers from 0 as planes of bytes without the empty low and high ones, after where those begin and end."""
    values = np.ascontiguousarray(values, "<u8").reshape(-1)
    some = int(np.bitwise_or.reduce(values)) if len(values) else 0
    low = ((some & -some).bit_length() - 1) // 8 if some else 0
    high = max(low + 1, -(-some.bit_length() // 8))
    return bytes([low, high]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, low:high].T).tobytes()


def from_planes(data: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """The ``n`` numbers that are packed from ``at`` on, and where their bytes end."""
    low, high = data[at], data[at + 1]
    out = np.zeros((n, 8), np.uint8)
    out[:, low:high] = np.frombuffer(data, np.uint8, (high - low) * n, at + 2).reshape(high - low, n).T
    return out.view("<u8").ravel(), at + 2 + (high - low) * n


def table_of(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({c: pa.array(v, t) for c, v, t in zip(["bucket", "chunk", "n", "data"], columns, _TYPES, strict=True)})


class Sums:
    """Items are 64-bit keys with ``width`` counts; the answer to a key is the counts' totals.

    A whole is (sorted different keys, (keys, width) counts, the place of each part's keys in it); within a
    packet the bits of its bucket are taken off the keys, and what is answered is how much a total exceeds
    the sent count.
    """

    def __init__(self, width: int = 1):
        self.width = width

    def merged(self, parts):
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        place = np.empty(len(keys), np.int64)
        place[order] = np.cumsum(new) - 1
        counts = np.concatenate([c for _, c in parts])[order]
        totals = np.add.reduceat(counts, first, axis=0) if len(first) else counts
        return keys[first], totals, np.split(place, np.cumsum([len(k) for k, _ in parts])[:-1])

    def split(self, whole, used: int, step: int):
        keys, counts = whole[:2]
        starts = np.arange(1 << step, dtype=np.uint64) << np.uint64(64 - used - step) if step else np.zeros(1, np.uint64)
        edges = np.append(np.searchsorted(keys, starts), len(keys))
        for sub in np.flatnonzero(np.diff(edges)):
            a, b = edges[sub], edges[sub + 1]
            gaps = np.diff(keys[a:b] - starts[sub], prepend=np.uint64(0))
            yield int(sub), int(b - a), planes(gaps) + b"".join(planes(counts[a:b, k]) for k in range(self.width))

    def read(self, data: bytes, n: int):
        gaps, at = from_planes(data, n)
        counts = np.empty((n, self.width), np.int64)
        for k in range(self.width):
            counts[:, k], at = from_planes(data, n, at)
        return np.cumsum(gaps, dtype=np.uint64), counts

    def settle(self, whole):
        return whole[1]

    def reply(self, whole, answers, k: int, part) -> bytes:
        excess = answers[whole[2][k]] - part[1]
        return b"".join(planes(excess[:, w]) for w in range(self.width))

    def heard(self, whole, replies: list[tuple[bytes, int]], used: int, step: int):
        """The answers for a whole from the replies to its packets, in order of their buckets."""
        out, at = whole[1].copy(), 0
        for data, n in replies:
            end = 0
            for k in range(self.width):
                excess, end = from_planes(data, n, end)
                out[at : at + n, k] += excess.astype(np.int64)
            at += n
        return out


def ask(codec, chunk: int, whole, levels: list[int]) -> pa.Table:
    """A chunk's packets."""
    return table_of([(sub, chunk, n, data) for sub, n, data in codec.split(whole, 0, levels[0])])


def _parts(codec, t: pa.Table):
    t = t.sort_by([("chunk", "ascending"), ("bucket", "ascending")])
    return t, [codec.read(d, n) for d, n in zip(t.column("data").to_pylist(), t.column("n").to_pylist(), strict=True)]


def _answered(codec, t: pa.Table, parts, whole, answers) -> pa.Table:
    data = pa.array([codec.reply(whole, answers, k, p) for k, p in enumerate(parts)], pa.binary())
    return t.set_column(t.schema.get_field_index("data"), "data", data)


def exchange(asked: DataFrame, codec, levels: list[int], name: str, used: int = 0) -> DataFrame:
    """The written answers to all packets: rows as they were asked, with answers for ``data``.

    The shuffle of the packets can go afterwards: callers ``release`` it once they hold no reference.
    """
    spark = asked.sparkSession
    if len(levels) == 1:

        def merge(t: pa.Table) -> pa.Table:
            t, parts = _parts(codec, t)
            whole = codec.merged(parts)
            return give_back(_answered(codec, t, parts, whole, codec.settle(whole)))

        return cut(asked.groupBy("bucket").applyInArrow(merge, PACKET), name)

    used, step = used + levels[0], levels[1]
    held = cut(asked, f"{name}-asked").withColumn("relay", F.floor(F.col("chunk") / GROUP).cast("long"))

    def up(t: pa.Table) -> pa.Table:
        relay, bucket = t.column("relay")[0].as_py(), t.column("bucket")[0].as_py()
        _, parts = _parts(codec, t)
        rows = codec.split(codec.merged(parts), used, step)
        return give_back(table_of([((bucket << step) + sub, relay, n, data) for sub, n, data in rows]))

    def down(t: pa.Table, r: pa.Table) -> pa.Table:
        t, parts = _parts(codec, t)
        whole = codec.merged(parts)
        answers = codec.heard(whole, replies_of(r), used, step)
        return give_back(_answered(codec, t, parts, whole, answers).select(["bucket", "chunk", "n", "data"]))

    higher = exchange(held.groupBy("relay", "bucket").applyInArrow(up, PACKET), codec, levels[1:], name, used)
    release(spark)
    higher = higher.select(F.col("chunk").alias("relay"), F.shiftright("bucket", step).alias("of"), "bucket", "n", "data")
    back = held.groupBy("relay", "bucket").cogroup(higher.groupBy("relay", "of")).applyInArrow(down, PACKET)
    return cut(back, name)


def replies_of(t: pa.Table) -> list[tuple[bytes, int]]:
    """What ``heard`` takes, for the answers to one chunk."""
    t = t.sort_by("bucket")
    return list(zip(t.column("data").to_pylist(), t.column("n").to_pylist(), strict=True))

"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines). Every paragraph hashes to a wide vector of 32-bit
lanes, and a text's fingerprint is the sum of its paragraphs' vectors modulo 2^32: the order of the
paragraphs does not matter, and adding or subtracting one paragraph's vector inserts or deletes it.
The first ``EQUAL`` lanes are uniform hash bits, so that different multisets have different sums. The
other ``ALIKE`` lanes hold a signed count of the paragraph's words (16 bytes from every word's start, up
to the paragraph's end); they add up in the same way, and the cosine of two sums estimates how much of
the texts is shared. Of a word longer than 16 bytes, such as a line without blanks, further grams of 16
bytes count: of any ``STEP`` that follow each other the one with the smallest hash, so that every byte is
in some gram and the choice moves with the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EQUAL, ALIKE = 32, 256
LANES = EQUAL + ALIKE
BUCKET_BYTES, MOST_BUCKETS = 4 << 20, 20_000
RUN_BYTES = 4 << 20
GRAM, STEP, BLOCK = 16, 8, 1 << 18

_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # masks for the first k bytes
_K0, _K1, _K2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14)]] = True


def _hashes(loads: np.ndarray, at: np.ndarray, left: np.ndarray | int) -> np.ndarray:
    """Hashes of the ``left`` bytes (up to ``GRAM``) from each place."""
    h = (loads[at] & _KEEP[np.minimum(left, 8)]) * _K0
    h ^= h >> np.uint64(32)
    h = (h ^ (loads[at + 8] & _KEEP[np.maximum(left - 8, 0)])) * _K1
    h ^= h >> np.uint64(29)
    h *= _K2
    return h ^ (h >> np.uint64(32))


def _inner_grams(loads: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the chosen grams within words longer than ``GRAM``, without their first.

    Among equal hashes of one window (a run of one letter) a place divisible by ``STEP`` wins, so that a
    run counts as often as other text. ``BLOCK`` grams are hashed at a time, with ``STEP`` - 1 more on
    either side.
    """
    ends = np.cumsum(lengths - GRAM + 1)  # of each word's grams, among those of all words
    total, around = int(ends[-1]) if len(ends) else 0, STEP - 1
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for low in range(0, total, BLOCK):
        k = np.arange(max(0, low - around), min(total, low + BLOCK + around))
        word = np.searchsorted(ends, k, side="right")
        inside = k - ends[word] + lengths[word] - GRAM + 1
        at = starts[word] + inside
        h = _hashes(loads, at, GRAM)
        rank = h & ~np.uint64(STEP - 1) | (inside % STEP).astype(np.uint64)
        slot = k - k[0] + (word - word[0] + 1) * around  # no window holds grams of two words
        least = np.full(slot[-1] + STEP + around, ~np.uint64(0))
        least[slot] = rank
        least = np.lib.stride_tricks.sliding_window_view(least, STEP).min(1)
        least = np.lib.stride_tricks.sliding_window_view(least, STEP).max(1)[slot - around]
        chosen = (least == rank) & (inside > 0) & (k >= low) & (k < low + BLOCK)
        found.append((at[chosen], h[chosen]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One row of ``LANES`` 32-bit sums for each UTF-8 text."""
    out = np.zeros((len(texts), LANES), np.uint32)
    if not texts:
        return out
    for k, text in enumerate(texts):
        lanes = [hashlib.blake2b(p, digest_size=2 * EQUAL).digest() for p in text.split(b"\n")]
        out[k, :EQUAL] = np.frombuffer(b"".join(lanes), "<u2").reshape(-1, EQUAL).sum(0, dtype=np.uint32)
    joined = b"\n".join(texts) + b"\n" + bytes(16)
    data = np.frombuffer(joined, np.uint8)[:-16]
    blank = _BLANK[data]
    at = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(at):
        return out
    paragraph_ends = np.flatnonzero(data == 10)
    left = np.minimum(paragraph_ends[np.searchsorted(paragraph_ends, at)] - at, GRAM)
    lengths = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]])) - at
    loads = np.ndarray((len(data) + 8,), "<u8", joined, 0, (1,))
    more, h = _inner_grams(loads, at[lengths > GRAM], lengths[lengths > GRAM])
    h = np.concatenate([_hashes(loads, at, left), h])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    text_of = np.searchsorted(text_ends, np.concatenate([at, more]), side="right")
    cell = text_of * ALIKE + (h & np.uint64(ALIKE - 1)).astype(np.int64)
    sign = 1 - 2 * ((h >> np.uint64(20)) & np.uint64(1)).astype(np.int64)
    sums = np.bincount(cell, weights=sign, minlength=len(texts) * ALIKE)
    out[:, EQUAL:] = sums.astype(np.int64).astype(np.uint32).reshape(-1, ALIKE)
    return out


def insert(fingerprint: np.ndarray, paragraph: bytes) -> np.ndarray:
    """The fingerprint of the text with one more paragraph (which holds no line break)."""
    return fingerprint + fingerprints([paragraph])[0]


def delete(fingerprint: np.ndarray, paragraph: bytes) -> np.ndarray:
    """The fingerprint of the text with one paragraph less."""
    return fingerprint - fingerprints([paragraph])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, 1 for equal fingerprints, else the cosine of the counting lanes, from 0 to 1."""
    x, y = (v[:, EQUAL:].astype(np.int32).astype(np.float64) for v in (a, b))
    size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.clip((x * y).sum(1) / np.maximum(size, 1e-9), 0.0, 1.0)
    return np.where((a == b).all(1), 1.0, cosine)


def encoded(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u4").tobytes()).decode()


def edited_text(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def next_in_order(docs: DataFrame, bucket_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Deal documents into ranges of doc_id and add to each range the text that follows its last.

    Returns (bucket, key, doc_id, text, head): within a bucket, rows in order of (key, text) follow
    each other and the one row marked ``head`` comes after all others. The ranges are cut at quantiles of
    the ids, one for ``bucket_bytes`` of text and at most ``MOST_BUCKETS``, so that the driver's sketch
    and the table of first keys stay small; a bucket is streamed and may be of any size.
    """
    lowest = F.lit(-(2**63)).cast("long")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("key"), "doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = min(MOST_BUCKETS, max(1, -(-total // (bucket_bytes or BUCKET_BYTES))))
    probabilities = [i / n for i in range(1, n)]
    cuts = keyed.approxQuantile("key", probabilities, 0.2 / n) if probabilities else []
    cuts = np.unique(np.array(cuts, np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="right").astype(np.int32))

    firsts = keyed.select("key").withColumn("bucket", bucket_of("key")).groupBy("bucket").agg(F.min("key").alias("key"))
    before = F.lag("bucket").over(Window.orderBy("bucket"))  # a row per bucket
    firsts = firsts.select(F.coalesce(before, F.max("bucket").over(Window.partitionBy())).alias("bucket"), "key")
    # of many rows with one id only the first follows, so that they are not copied
    heads = keyed.join(F.broadcast(firsts), "key").groupBy("bucket", "key").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    heads = heads.select("bucket", "key", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("head"))
    rows = keyed.select(bucket_of("key").alias("bucket"), "key", "doc_id", "text", F.lit(False).alias("head"))
    return rows.unionByName(heads), n


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts; one row per row of ``docs``.

    The next document is the one with the next larger doc_id, after the last the first; rows of one
    doc_id follow each other in the order of their texts, and null ids come first. A null text counts
    as empty; an empty text is one empty paragraph. A lone document follows itself. An empty table
    gives an empty result. Other columns are ignored.
    """

    def finished(run: list[tuple[int | None, str, bool]]) -> pa.RecordBatch:
        """Results for all of a run of (doc_id, text, head) but the last; heads only follow."""
        texts = [t for _, t, _ in run]
        own = [i for i, (_, _, head) in enumerate(run[:-1]) if not head]
        after = [i + 1 for i in own]
        plain = fingerprints([t.encode("utf-8") for t in texts])
        edited = [edited_text(texts[i], texts[i + 1]).encode("utf-8") for i in own]
        changed = fingerprints(edited)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([run[i][0] for i in own], pa.int64()),
                "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
                "edited_sha256": [hashlib.sha256(t).hexdigest() for t in edited],
                "fingerprint": [encoded(plain[i]) for i in own],
                "edited_fingerprint": [encoded(f) for f in changed],
                "near_edited": likeness(plain[own], changed),
                "near_next": likeness(plain[own], plain[after]),
            },
            schema=out_schema,
        )

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row waits for the one after it; about ``RUN_BYTES`` of text are fingerprinted together."""
        run: list[tuple[int | None, str, bool]] = []
        size = 0
        for batch in batches:
            for doc_id, text, head in zip(*(batch.column(c) for c in ("doc_id", "text", "head")), strict=True):
                run.append((doc_id.as_py(), text.as_py() or "", head.as_py()))
                size += len(run[-1][1]) + LANES
                if size >= RUN_BYTES and len(run) > 1:
                    yield finished(run)
                    run, size = run[-1:], len(run[-1][1]) + LANES
        if len(run) > 1:
            yield finished(run)

    strings = ["edited_sha256", "fingerprint", "edited_fingerprint"]
    out_schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(c, pa.string()) for c in strings]
        + [("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    rows, _ = next_in_order(docs)
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "head", "key", F.coalesce("text", F.lit("")))
    return ordered.select("doc_id", "text", "head").mapInArrow(in_order, SCHEMA)


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

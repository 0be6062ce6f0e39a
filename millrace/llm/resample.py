"""Importance resampling towards a target distribution over hashed words and pairs of words.

Corpus counts come from segments: newlines cut texts into lines, each different line's words and pairs are
counted once and multiplied by how often the line occurs, and the pairs that a newline separates are
added from the documents. A document is scored alike: the different lines of a batch once, then its pairs
across lines. The drawn documents are ranked over range partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.sequence import numbered

from .common import cut, give_back
from .words import Words, in_blocks, words_of

BUCKETS = 10_000
SALT = 7
LEAST_WORDS = 20
PERCENT = 25
SCALE = 1000
CRC_POLYNOMIAL = 0xEDB88320
LONG_WORD = 64  # bytes; longer words go through zlib one by one


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CRC_POLYNOMIAL), t >> 1)
    return t.astype(np.uint32)


_CRC = _crc_table()


def _shifts() -> np.ndarray:
    """[n, k, b]: what byte b at place k of a checksum becomes when n zero bytes follow."""
    out = np.empty((LONG_WORD + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(LONG_WORD):
        out[n + 1] = _CRC[out[n] & 0xFF] ^ (out[n] >> 8)
    return out


_SHIFT = _shifts()


@dataclass
class Checksums:
    """crc32 of words, and of pairs of words with a blank between, from the words' own checksums."""

    words: Words
    crc: np.ndarray
    with_blank: np.ndarray

    @classmethod
    def of(cls, w: Words) -> Checksums:
        crc = np.full(len(w.starts), 0xFFFFFFFF, np.uint32)
        active = np.flatnonzero(w.sizes <= LONG_WORD)
        for j in range(LONG_WORD):
            active = active[w.sizes[active] > j]
            if not len(active):
                break
            crc[active] = _CRC[(crc[active] ^ w.data[w.starts[active] + j]) & 0xFF] ^ (crc[active] >> 8)
        crc = ~crc
        for i in np.flatnonzero(w.sizes > LONG_WORD):
            crc[i] = zlib.crc32(w.buffer[w.starts[i] : w.starts[i] + w.sizes[i]])
        state = ~crc
        return cls(w, crc, ~(_CRC[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> 8)))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """crc32 of word a, a blank and word b: a's checksum moved over the bytes of b, then b's own."""
        x, w = self.with_blank[a], self.words
        n = np.minimum(w.sizes[b], LONG_WORD)
        moved = _SHIFT[n, 0, x & 0xFF] ^ _SHIFT[n, 1, (x >> 8) & 0xFF] ^ _SHIFT[n, 2, (x >> 16) & 0xFF] ^ _SHIFT[n, 3, x >> 24]
        out = moved ^ self.crc[b]
        for i in np.flatnonzero(w.sizes[b] > LONG_WORD):
            at = w.starts[b[i]]
            out[i] = zlib.crc32(w.buffer[at : at + w.sizes[b[i]]], int(x[i]))
        return out


def _bucket(crc: np.ndarray, buckets: int) -> np.ndarray:
    return (crc % np.uint32(buckets)).astype(np.int64)


def _words(texts: list[str | None]) -> Words:
    return words_of(texts, alnum=True, lower=True, accents=False)


def count_lines(lines: list[str | None], times: np.ndarray, buckets: int) -> np.ndarray:
    """Counts by bucket of the words and pairs inside the lines, each line as often as it occurs."""
    w = _words(lines)
    sums = Checksums.of(w)
    first = np.flatnonzero(w.text_of[1:] == w.text_of[:-1])
    at = np.concatenate([_bucket(sums.crc, buckets), _bucket(sums.pairs(first, first + 1), buckets)])
    weights = times[np.concatenate([w.text_of, w.text_of[first]])]
    out = np.zeros(buckets, np.int64)
    np.add.at(out, at, weights)
    return out


def _across(w: Words) -> np.ndarray:
    """The words whose next word in the same text stands on a later line."""
    line = np.searchsorted(np.flatnonzero(w.data == 10), w.starts)
    return np.flatnonzero((w.text_of[1:] == w.text_of[:-1]) & (line[1:] != line[:-1]))


def count_across(texts: list[str | None], buckets: int) -> np.ndarray:
    """Counts by bucket of the pairs that a newline separates."""
    w = _words(texts)
    first = _across(w)
    return np.bincount(_bucket(Checksums.of(w).pairs(first, first + 1), buckets), minlength=buckets).astype(np.int64)


def _as_counts(total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.record_batch({"bucket": some.astype(np.int32), "n": total[some]})


def feature_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """How often features of each bucket occur in all rows of ``docs``."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            lines, times = b.column("line").to_pylist(), b.column("times").to_numpy()
            for a, z in in_blocks([len(x) for x in lines]):
                total += count_lines(lines[a:z], times[a:z], buckets)
        yield give_back(_as_counts(total))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, z in in_blocks([len(x) for x in texts]):
                total += count_across(texts[a:z], buckets)
        yield give_back(_as_counts(total))

    texts = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    separated = texts.filter(F.col("text").contains("\n"))
    names = "bucket int, n long"
    counts = lines.mapInArrow(within, names).unionByName(separated.mapInArrow(across, names))
    rows = counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row for each bucket
    out = [0] * buckets
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int], scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the smoothed shares' ratio) of each bucket."""
    n, s, t = len(corpus), sum(corpus), sum(target)
    return np.array([math.floor(scale * math.log((y + 1) * (s + n) / ((x + 1) * (t + n)))) for x, y in zip(corpus, target, strict=True)], np.int64)


def weigh(texts: list[str | None], gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text its words, and the sum of the gains of its words and pairs."""
    numbers: dict[str, int] = {}
    split = [(t or "").split("\n") for t in texts]
    line = np.array([numbers.setdefault(x, len(numbers)) for lines in split for x in lines], np.int64)
    text_of = np.repeat(np.arange(len(texts)), [len(lines) for lines in split])
    w = _words(list(numbers))
    sums = Checksums.of(w)
    bounds = w.bounds()
    n_words = np.diff(bounds)
    first = np.flatnonzero(w.text_of[1:] == w.text_of[:-1])
    of_line = np.zeros(len(numbers), np.int64)
    np.add.at(of_line, w.text_of, gain[_bucket(sums.crc, len(gain))])
    np.add.at(of_line, w.text_of[first], gain[_bucket(sums.pairs(first, first + 1), len(gain))])
    words, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    np.add.at(words, text_of, n_words[line])
    np.add.at(total, text_of, of_line[line])
    some = np.flatnonzero(n_words[line] > 0)
    left, right = some[:-1], some[1:]
    same = text_of[left] == text_of[right]
    left, right = left[same], right[same]
    pairs = sums.pairs(bounds[line[left] + 1] - 1, bounds[line[right]])
    np.add.at(total, text_of[left], gain[_bucket(pairs, len(gain))])
    return words, total


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``n_words``, ``n_features`` and ``weight`` (columns of these names are replaced)."""

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weights(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        parts = [weigh(values[a:z], gain) for a, z in in_blocks([len(x or "") for x in values])]
        words, total = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        features = words + np.maximum(words - 1, 0)
        weight = np.where(features > 0, total // np.maximum(features, 1), 0)
        out = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (words, features, weight)], ["n_words", "n_features", "weight"])
        return give_back(out)

    out = docs.withColumn("_weights", weights(text))
    return out.withColumns({c: F.col(f"_weights.{c}") for c in ("n_words", "n_features", "weight")}).drop("_weights")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    The score is the weight (floored mean gain of the row's features) plus Gumbel noise from a hash of the
    id, so that the highest scores are a draw without replacement. Of the rows with ``least_words`` words
    ``percent`` of a hundred get ranks from 1, ties to smaller ids; other rows' rank is null.
    Null and empty texts have no features and weight 0; a null id is hashed as an empty one and comes last
    among ties; rows with one id get equal noise, and ranks of their own. An empty target leaves smoothing
    alone to weigh; empty documents give an empty result. Other columns of either table are ignored.

    The driver holds the counts of ``buckets`` buckets; documents are read three times and only their
    different lines shuffle, counted within each task first, so that a frequent line is no hot key.
    """
    gain = gains(feature_counts(docs, buckets=buckets), feature_counts(target, buckets=buckets))
    rows = weighted(docs.select("doc_id", "text"), gain).drop("text")
    id_text = F.concat(F.lit(f"{SALT}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(id_text, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -float(SCALE))
    rows = cut(rows.withColumn("score", (F.col("weight") + noise).cast("long")), "resample-scores")
    able = F.col("n_words") >= least_words
    drawn = rows.filter(able).count() * percent // 100
    ranked = numbered(rows.filter(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features")], "rank", 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = rows.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resample(spark, sf_dir: str) -> DataFrame:
    """The contract's weight, score and rank of every document; ``resample`` says how odd rows are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _features(table: str) -> str:
    """(row_id, f): the features of every row of a table."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""SELECT row_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f
      FROM (SELECT row_number() OVER () AS row_id, {words} AS w FROM {table})"""


# checksums bit by bit: a table of 256 by folding, then one step for each byte of a feature
OP11_SQL = f"""
WITH c AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, {CRC_POLYNOMIAL}) ELSE x >> 1 END)) AS t),
d AS MATERIALIZED ({_features("documents")}),
g AS MATERIALIZED ({_features("benchmark")}),
k AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(f))), lambda i:
      CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))),
    lambda x, b: xor(x >> 8, t[xor(x, b) % 256 + 1])), 4294967295) % {BUCKETS} AS b
  FROM (SELECT f FROM d UNION SELECT f FROM g), c),
s AS (SELECT b, count(*) AS n FROM d JOIN k USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM g JOIN k USING (f) GROUP BY b),
q AS MATERIALIZED (SELECT b.b, CAST(floor({SCALE} * ln((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM d) + {BUCKETS}) /
    ((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM g) + {BUCKETS})))) AS BIGINT) AS gain
  FROM range({BUCKETS}) b(b) LEFT JOIN s ON s.b = b.b LEFT JOIN t ON t.b = b.b),
e AS (SELECT row_id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM d JOIN k USING (f) JOIN q ON q.b = k.b GROUP BY row_id),
r AS (SELECT n.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-{SCALE} * ln(-ln(
    (CAST('0x' || substr(sha256('{SALT}:' || coalesce(CAST(n.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS row_id, doc_id FROM documents) n LEFT JOIN e ON e.row_id = n.row_id),
o AS (SELECT doc_id, n_features, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, weight, score FROM r WHERE n_features >= {2 * LEAST_WORDS - 1})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * {PERCENT} // 100 FROM o) THEN place END AS rank FROM o
UNION ALL SELECT doc_id, n_features, weight, score, CAST(NULL AS BIGINT) FROM r WHERE n_features < {2 * LEAST_WORDS - 1}
"""

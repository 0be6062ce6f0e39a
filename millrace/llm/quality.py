"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are complete binary trees of one depth, kept as flat arrays, so that a block of documents
walks all trees with one indexing step a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held_out, one_row_an_id
from .words import in_blocks, mixed, words_of

SAMPLE_ROWS = 24_000  # labelled rows that the trees learn from at most
TREES, DEPTH, BINS, RATE, L2 = 80, 4, 64, 0.15, 1.0
MIN_LEAF = 20
PREDICT_FROM = 0.3

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "beyond_ascii": range(128, 256),
    "blank": [0x20, *range(9, 14)],
    "stop": [ord(c) for c in ".,;:?"],
    "shout": [ord("!")],
    "sign": [ord(c) for c in "#$%&*@^~=+<>{}[]\\/_"],
    "bar": [ord("|")],
}


def _entropy(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    share = counts / np.maximum(total, 1)[:, None]
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(1)


def _grouped(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For every owner the number of different keys and the count of its most frequent key."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]))
    runs = np.diff(np.append(first, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, o[first], runs)
    return np.bincount(o[first], minlength=n).astype(float), most


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of statistics for each text; all of them are defined for empty and null texts."""
    w = words_of(texts)
    n = w.n_texts
    sizes = np.diff(np.append(w.text_starts, len(w.data))) - 1
    text_of_byte = np.repeat(np.arange(n), sizes + 1)
    counts = np.bincount(text_of_byte * 256 + w.data, minlength=n * 256).reshape(n, 256)
    counts[:, 10] -= 1  # the line break that ends every text here
    per_byte = np.maximum(sizes, 1)
    columns = [np.log1p(sizes)]
    columns += [counts[:, list(c)].sum(1) / per_byte for c in _CLASSES.values()]
    lines = counts[:, 10] + 1
    columns += [_entropy(counts, sizes), np.log1p(lines), np.log1p(sizes / lines)]

    n_words = np.bincount(w.text_of, minlength=n).astype(float)
    some = np.maximum(n_words, 1)
    word_bytes = np.bincount(w.text_of, weights=w.sizes, minlength=n)
    squares = np.bincount(w.text_of, weights=w.sizes.astype(float) ** 2, minlength=n)
    mean = word_bytes / some
    hashes = w.hashes()
    kinds, most = _grouped(hashes, w.text_of, n)
    pair_of = w.text_of[1:]
    inside = w.text_of[1:] == w.text_of[:-1]
    pairs = mixed(hashes[1:] ^ (hashes[:-1] << np.uint64(1)), 3)[inside]
    pair_kinds, pair_most = _grouped(pairs, pair_of[inside], n)
    n_pairs = np.maximum(n_words - 1, 1)
    twice = np.bincount(pair_of[inside & (hashes[1:] == hashes[:-1])], minlength=n)
    last = w.data[w.starts + w.sizes - 1] if len(w.starts) else np.zeros(0, np.uint8)
    marked = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128))
    columns += [
        np.log1p(n_words),
        mean,
        np.sqrt(np.maximum(squares / some - mean * mean, 0)),
        kinds / some,
        most / some,
        np.log1p(kinds),
        pair_kinds / n_pairs,
        pair_most / n_pairs,
        twice / n_pairs,
        np.bincount(w.text_of, weights=w.sizes <= 2, minlength=n) / some,
        np.bincount(w.text_of, weights=w.sizes >= 12, minlength=n) / some,
        np.bincount(w.text_of, weights=marked, minlength=n) / some,
    ]
    # lines: repeated ones, and how many end like a sentence
    breaks = np.flatnonzero(w.data == 10)
    line_starts = np.concatenate([[0], breaks[:-1] + 1])
    line_of = np.searchsorted(w.text_starts, line_starts, side="right") - 1
    line_sizes = breaks - line_starts
    # a line's hash is the sum of its words' hashes, each mixed with the word's place, so that every byte counts
    first_word = np.searchsorted(w.starts, line_starts)
    line_of_word = np.searchsorted(breaks, w.starts)
    place = (np.arange(len(w.starts)) - first_word[line_of_word]).astype(np.uint64)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ mixed(place, 5), 6), dtype=np.uint64)])
    last_word = np.append(first_word[1:], len(w.starts))
    line_hash = mixed(summed[last_word] - summed[first_word] + line_sizes.astype(np.uint64), 4)
    line_kinds, line_most = _grouped(line_hash, line_of, n)
    closing = np.isin(w.data[np.maximum(breaks - 1, 0)], [ord(c) for c in ".!?"]) & (line_sizes > 0)
    columns += [
        line_kinds / lines,
        line_most / lines,
        np.bincount(line_of, weights=closing, minlength=n) / lines,
    ]
    return np.stack(columns, 1).astype(np.float32)


@dataclass
class Forest:
    """``feature`` and ``threshold``: (trees, inner nodes); ``leaf``: (trees, leaves)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        raw = self.base + self.leaf[tree, node - inner].sum(1) if trees else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost logistic loss. Without two classes the score is the smoothed share of ones."""
    n, m = x.shape if len(x) else (0, 1)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    if len(np.unique(y)) < 2:
        return Forest(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, 2**DEPTH)))
    cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).astype(np.float32)  # (BINS - 1, m)
    binned = np.stack([np.searchsorted(cuts[:, j], x[:, j], side="left") for j in range(m)], 1)
    raw = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            cell = (node - first) * BINS
            hist = np.empty((3, m, width, BINS))
            for j in range(m):
                at = cell + binned[:, j]
                for k, weight in enumerate((g, h, None)):
                    hist[k, j] = np.bincount(at, weight, width * BINS).reshape(width, BINS)
            left = hist.cumsum(3)[..., :-1]
            whole = hist.sum(3)[..., None]
            right = whole - left
            gain = left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2) - whole[0] ** 2 / (whole[1] + L2)
            gain[(left[2] < MIN_LEAF) | (right[2] < MIN_LEAF)] = 0
            gain = gain.transpose(1, 0, 2).reshape(width, -1)
            best = gain.argmax(1)
            split = gain[np.arange(width), best] > 1e-6
            f, b = best // (BINS - 1), best % (BINS - 1)
            feature[first : first + width] = f
            threshold[first : first + width] = np.where(split, cuts[b, f], np.inf)
            own = node - first
            goes_right = split[own] & (binned[np.arange(n), f[own]] > b[own])
            node = 2 * node + 1 + goes_right
        leaf_of = node - inner
        value = -np.bincount(leaf_of, g, 2**DEPTH) / (np.bincount(leaf_of, h, 2**DEPTH) + L2) * RATE
        raw += value[leaf_of]
        features.append(feature), thresholds.append(threshold), leaves.append(value)
    return Forest(base, np.array(features), np.array(thresholds), np.array(leaves))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of up to ``rows`` labelled documents that are not held out.

    The rows are those of the smallest hashes of their ids, so that reruns take the same ones. A
    document with several labels takes the largest; null ids and null labels are left out. Rows of one
    id all come along: see ``one_row_an_id``.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    """Fit the trees on up to ``rows`` labelled documents, one row for each id, whose statistics the driver gathers."""
    names = "doc_id long, y double, x array<float>"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, stop in in_blocks([len(t or "") for t in b["text"]]):
                part = b.iloc[start:stop]
                yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "x": list(statistics(part["text"].tolist()))})

    sample = one_row_an_id(labelled_sample(docs, labels, "quality", rows)).mapInPandas(measure, names).toPandas()
    sample = sample.sort_values(["doc_id", "y"], kind="stable")
    x = np.stack(sample["x"]) if len(sample) else np.zeros((0, 1), np.float32)
    return fit(x, (sample["y"].to_numpy() > 0).astype(float))


def score_column(forest: Forest):
    """A function of the text column that gives the score; null texts count as empty."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
        parts = [forest.score(statistics(text.slice(a, b - a).to_pylist())) for a, b in in_blocks(sizes)]
        return give_back(pa.array(np.concatenate(parts) if parts else np.zeros(0)))

    return score


def classify(docs: DataFrame, forest: Forest) -> DataFrame:
    """All rows and columns of ``docs`` with ``quality_score`` (0 to 1, higher: better) added.

    A column of that name is replaced. Empty and null texts are scored by their statistics, which are
    all zero. Repeated rows are scored alike. An empty table gives an empty result.
    """
    return docs.withColumn("quality_score", score_column(forest)("text"))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: score of every document and whether it is 0.3 at least."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classify(docs, forest)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality_score").alias("score"),
    ).withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))

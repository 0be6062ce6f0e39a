"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

A word's embedding is the sum of three rows: those of its hash, of its first 4 and of its first 6
bytes. Filters of several widths run over a text's words, each keeps its largest value (max pooling),
and a logistic layer gives the score. Only the words at which a filter peaks get a gradient, so that
training touches few rows. Embeddings start from how much more often a row occurs in toxic texts of
one half of the sample; the network is trained on most of the other half; on the rest of that half the
scores are calibrated for each language, as guessed from the text's frequent words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, whole_texts
from .quality import labelled_sample
from .words import Words, in_blocks, words_of

SAMPLE_ROWS = 12_000  # labelled rows that the network learns from at most
SAMPLE_BYTES = 64 << 20  # of all these texts
BUCKETS, DIM = 1 << 17, 8
WIDTHS, FILTERS = (1, 2, 3), 6
EPOCHS, BATCH, RATE = 4, 64, 0.05
FREQUENT_WORDS = 40  # for each language
SEED = 11


def _word_rows(w: Words) -> np.ndarray:
    """(words, 3) rows of the embedding table."""
    mask = np.uint64(BUCKETS - 1)
    parts = [w.hashes(), w.prefix_hash(4), w.prefix_hash(6)]
    return np.stack([(h >> np.uint64(20) & mask).astype(np.int64) + k * BUCKETS for k, h in enumerate(parts)], 1)


def _laid_out(rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words when each text is followed by enough empty places for the widest filter."""
    gap = max(WIDTHS)
    sizes = np.diff(bounds)
    starts = np.cumsum(sizes + gap) - (sizes + gap)
    at = np.arange(len(rows)) + np.repeat(starts - bounds[:-1], sizes)
    return at, starts, np.maximum(sizes, 1)


@dataclass
class Network:
    table: np.ndarray  # (3 * BUCKETS, DIM)
    filters: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    languages: list[str] = field(default_factory=list)
    language_words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    language_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))  # logits; the last is for no language

    def pooled(self, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, filters) largest values, the places where they occur, and the words' places."""
        at, starts, sizes = _laid_out(rows, bounds)
        n = int(starts[-1] + sizes[-1] + max(WIDTHS)) if len(starts) else 0
        x = np.zeros((n + max(WIDTHS), DIM), np.float32)
        x[at] = self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]
        values = np.concatenate([sum(x[k : n + k] @ f[k] for k in range(len(f))) for f in self.filters], 1)
        cuts = np.stack([starts, starts + sizes], 1).ravel()
        most = np.maximum.reduceat(values, cuts, axis=0)[::2]
        return np.maximum(most + self.bias, 0), values, at

    def logits(self, w: Words) -> np.ndarray:
        if not w.n_texts:
            return np.zeros(0)
        most, _, _ = self.pooled(_word_rows(w), w.bounds())
        return most @ self.out + self.out_bias

    def guessed_language(self, w: Words) -> np.ndarray:
        """The language with most of a text's words among its frequent ones; else the last number."""
        n = len(self.languages)
        if not n or not len(w.starts):
            return np.full(w.n_texts, n)
        h = w.hashes()
        k = np.minimum(np.searchsorted(self.language_words, h), len(self.language_words) - 1)
        hit = self.language_words[k] == h
        votes = np.bincount(w.text_of[hit] * n + self.language_of[k[hit]], minlength=w.n_texts * n).reshape(-1, n)
        return np.where(votes.max(1) > 0, votes.argmax(1), n)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        w = words_of(texts, letters_only=True, lower=True)
        shifted = self.logits(w) - self.thresholds[self.guessed_language(w)]
        return 1 / (1 + np.exp(-np.clip(shifted, -60, 60)))


def _start_values(batches: list[Words], y: np.ndarray) -> np.ndarray:
    """For each row the log odds of a text that has it being toxic, near 0 for rare rows."""
    counts = np.zeros((2, 3 * BUCKETS))
    at = 0
    for w in batches:
        rows, own = _word_rows(w), y[at : at + w.n_texts]
        at += w.n_texts
        for k in range(3):
            pair = np.unique(w.text_of * (3 * BUCKETS) + rows[:, k])
            text, row = pair // (3 * BUCKETS), pair % (3 * BUCKETS)
            for label in (0, 1):
                np.add.at(counts[label], row[own[text] == label], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    odds = np.log((counts[1] + 2 * share) / (counts[0] + 2 * (1 - share))) - np.log(share / (1 - share))
    return np.where(counts.sum(0) >= 4, np.clip(odds, -3, 5), 0)


def _frequent_words(batches: list[Words], langs: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Hashes of each language's most frequent words; a word shared by languages counts for the first."""
    totals: dict[str, dict[int, int]] = {}
    at = 0
    for w in batches:
        own = np.array([x or "" for x in langs[at : at + w.n_texts]], object)[w.text_of]
        at += w.n_texts
        h = w.hashes()
        for lang in sorted(set(own) - {""}):
            kinds, n = np.unique(h[own == lang], return_counts=True)
            into = totals.setdefault(lang, {})
            for k in np.argsort(-n, kind="stable")[: 8 * FREQUENT_WORDS]:
                into[int(kinds[k])] = into.get(int(kinds[k]), 0) + int(n[k])
    names = sorted(totals)
    owner: dict[int, tuple[float, int]] = {}
    for k, lang in enumerate(names):
        whole = sum(totals[lang].values())
        for word, n in sorted(totals[lang].items(), key=lambda x: (-x[1], x[0]))[:FREQUENT_WORDS]:
            owner[word] = max(owner.get(word, (0.0, -1)), (n / whole, k))
    hashes = np.array(sorted(owner), np.uint64)
    return names, hashes, np.array([owner[int(h)][1] for h in hashes], np.int64)


def _best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit that makes fewest errors, halfway between its neighbours."""
    order = np.argsort(logits, kind="stable")
    v, label = logits[order], y[order]
    errors = np.concatenate([[0], np.cumsum(label)]) + np.concatenate([np.cumsum((1 - label)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    k = best[len(best) // 2]
    low = v[k - 1] if k else v[0] - 1
    high = v[k] if k < len(v) else v[-1] + 1
    return float((low + high) / 2)


def fit(texts: list[str | None], y: np.ndarray, langs: list[str | None]) -> Network:
    """Train on a sample; without two classes the scores are the smoothed share of ones."""
    rng = np.random.default_rng(SEED)
    filters = [np.zeros((0, DIM, FILTERS), np.float32)] * len(WIDTHS)
    n_filters = FILTERS * len(WIDTHS)
    net = Network(np.zeros((3 * BUCKETS, DIM), np.float32), filters, np.zeros(n_filters, np.float32), np.zeros(n_filters), 0.0)
    net.filters = [rng.normal(0, 0.15, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    share = (y.sum() + 0.5) / (len(y) + 1)
    net.out_bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return net

    order = rng.permutation(len(texts))
    first, second = order[: len(order) // 2], order[len(order) // 2 :]
    check, second = second[: len(second) // 4], second[len(second) // 4 :]

    def blocks(chosen: np.ndarray) -> list[Words]:
        own = [texts[i] for i in chosen]
        ranges = in_blocks([len(t or "") for t in own])
        return [words_of(own[a:b], letters_only=True, lower=True) for a, b in ranges]

    start_blocks = blocks(first)
    net.languages, net.language_words, net.language_of = _frequent_words(start_blocks, [langs[i] for i in first])
    net.table[:, 0] = _start_values(start_blocks, y[first])
    net.table[:, 1:] = rng.normal(0, 0.02, (3 * BUCKETS, DIM - 1))
    for f in net.filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.1
    net.out[:] = 0.3
    net.bias[:] = -0.5
    params = {"bias": net.bias, "out": net.out, **{f"f{k}": f for k, f in enumerate(net.filters)}}
    squares = {k: np.full_like(v, 1e-3, dtype=np.float64) for k, v in params.items()}
    table_squares, bias_square = np.full(3 * BUCKETS, 1e-2), 1e-3
    for _ in range(EPOCHS):
        mixed_up = rng.permutation(second)
        for a in range(0, len(mixed_up), BATCH):
            chosen = mixed_up[a : a + BATCH]
            w = words_of([texts[i] for i in chosen], letters_only=True, lower=True)
            rows, bounds = _word_rows(w), w.bounds()
            most, values, at = net.pooled(rows, bounds)
            p = 1 / (1 + np.exp(-(most @ net.out + net.out_bias)))
            slope = (p - y[chosen]) / len(chosen)
            grads = {k: np.zeros_like(v, dtype=np.float64) for k, v in params.items()}
            grads["out"] += most.T @ slope
            back = slope[:, None] * net.out * (most > 0)
            grads["bias"] += back.sum(0)
            word_at = np.full(len(values) + max(WIDTHS) * 2, -1)
            word_at[at] = np.arange(len(at))
            table_rows, table_grads = [], []
            _, starts, sizes = _laid_out(rows, bounds)
            for t in range(len(chosen)):
                peaks = starts[t] + values[starts[t] : starts[t] + sizes[t]].argmax(0)
                for j in np.flatnonzero(back[t]):
                    width, column = j // FILTERS, j % FILTERS
                    for k in range(WIDTHS[width]):
                        if (word := word_at[peaks[j] + k]) >= 0:
                            own = rows[word]
                            grads[f"f{width}"][k, :, column] += back[t, j] * net.table[own].sum(0)
                            table_rows.append(own)
                            table_grads.append(back[t, j] * net.filters[width][k, :, column])
            for k, g in grads.items():
                squares[k] += g * g
                params[k] -= (RATE * g / np.sqrt(squares[k])).astype(params[k].dtype)
            bias_square += slope.sum() ** 2
            net.out_bias -= RATE * slope.sum() / np.sqrt(bias_square)
            if table_rows:
                touched, place = np.unique(np.concatenate(table_rows), return_inverse=True)
                total = np.zeros((len(touched), DIM))
                np.add.at(total, place, np.repeat(np.array(table_grads), 3, axis=0))
                table_squares[touched] += (total * total).mean(1)
                net.table[touched] -= RATE * total / np.sqrt(table_squares[touched])[:, None]

    logits, guessed = [], []
    for w in blocks(check):
        logits.append(net.logits(w)), guessed.append(net.guessed_language(w))
    logits, guessed = np.concatenate(logits), np.concatenate(guessed)
    whole = _best_threshold(logits, y[check])
    net.thresholds = np.full(len(net.languages) + 1, whole)
    for k in range(len(net.languages)):
        own = guessed == k
        if y[check][own].sum() >= 10 and (1 - y[check][own]).sum() >= 10:
            net.thresholds[k] = _best_threshold(logits[own], y[check][own])
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """Fit on up to ``rows`` labelled documents of ``SAMPLE_BYTES``; their language only calibrates, it is no input."""
    sample = labelled_sample(docs, labels, "toxic", rows)
    ids = docs.select("doc_id", "lang").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id")
    langs = ids.groupBy("doc_id").agg(F.max("lang").alias("lang"))
    table = whole_texts(sample, SAMPLE_BYTES).join(langs, "doc_id").toPandas().sort_values(["doc_id", "text"], kind="stable")
    return fit(table["text"].tolist(), (table["y"].to_numpy() > 0).astype(int), table["lang"].tolist())


def score_column(spark: SparkSession, net: Network):
    """A function of the text column; the network's size is fixed, so it is broadcast."""
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for text in parts:
            texts = text.tolist()
            done = [own.scores(texts[a:b]) for a, b in in_blocks([len(t or "") for t in texts])]
            yield pd.Series(np.concatenate(done) if done else np.zeros(0))

    return score


def classify(docs: DataFrame, net: Network) -> DataFrame:
    """All rows and columns of ``docs`` with ``toxicity`` (0 to 1, 0.5: the language's threshold) added.

    A column of that name is replaced. Texts without words, null ones included, get the score of no
    evidence. Repeated rows are scored alike. An empty table gives an empty result.
    """
    return docs.withColumn("toxicity", score_column(docs.sparkSession, net)("text"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classify(docs.select("doc_id", "text"), net)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

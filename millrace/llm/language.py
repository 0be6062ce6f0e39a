"""Language identification by a linear-chain conditional random field over a text's words.

Every word gets a score for each language from hashed features: its prefixes and suffixes (affixes),
its byte trigrams (n-grams) and the word itself (lexicon). Learned transitions tie neighbours together,
and forward-backward gives each word's probabilities, so that code-switched texts are labelled word by
word. The language of a text is the one with most of the words' probability.

Only texts carry a language, not words. The field is trained first with every word labelled by its
text's language; then words of the sample whose first model strongly says otherwise are relabelled,
and it is trained again, which is what teaches it to switch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, whole_texts
from .words import Words, in_blocks, mixed, words_of

SAMPLE_ROWS = 2_500  # texts that the field learns from at most
LANGUAGE_ROWS = 1_000  # of one language at most
SAMPLE_BYTES = 64 << 20  # of all these texts
ROWS = 1 << 16  # of the weight table
EPOCHS, BATCH_CHARS, RATE = 1, 300_000, 0.3
RELABEL_FROM = 0.9
UNKNOWN = "und"
_AFFIXES = (1, 2, 3, 4, 6)
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def _row(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(24) & np.uint64(ROWS - 1)).astype(np.int64)


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, affixes and lexicon) table rows; for each trigram its row and its word."""
    columns = [w.hashes()]
    for n in _AFFIXES:
        keep = np.minimum(w.sizes, n)
        columns.append(w.prefix_hash(n))
        columns.append(mixed(w.loads(w.starts + w.sizes - keep, keep), 40 + n))
    n_grams = np.maximum(w.sizes - 2, 0)
    word = np.repeat(np.arange(len(w.starts)), n_grams)
    before = np.cumsum(n_grams) - n_grams
    at = np.arange(len(word)) - np.repeat(before, n_grams) + np.repeat(w.starts, n_grams)
    grams = mixed(w.loads(at, np.full(len(at), 3)), 60) if len(at) else np.zeros(0, np.uint64)
    return np.stack([_row(c) for c in columns], 1), _row(grams), word


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # (ROWS, languages)
    start: np.ndarray
    transitions: np.ndarray  # log weights, from row to column

    def emissions(self, w: Words) -> np.ndarray:
        rows, grams, word = features(w)
        out = np.zeros((len(w.starts), len(self.languages)))
        for k in range(rows.shape[1]):
            out += self.weights[rows[:, k]]
        if len(grams):
            sizes = np.maximum(np.bincount(word, minlength=len(out)), 1)[:, None]
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(word, self.weights[grams, j], len(out)) / sizes[:, 0] * 2
        return out

    def marginals(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Each word's probabilities and the expected number of each transition."""
        scores = self.emissions(w)
        local = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
        return forward_backward(local, w.bounds(), np.exp(self.start), np.exp(self.transitions))


def forward_backward(
    local: np.ndarray, bounds: np.ndarray, start: np.ndarray, step: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """All texts at once, one word of each at a time; the texts are ordered by length."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    # the number of texts with more than t words
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    alpha = np.empty_like(local)
    a = np.zeros((0, 0))
    for t in range(longest):
        at = starts[: active[t]] + t
        a = local[at] * (start if t == 0 else a[: active[t]] @ step)
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    moves = np.zeros_like(step)
    b = np.ones((len(sizes), local.shape[1]))
    out = np.empty_like(local)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        if t + 1 < longest and (m := active[t + 1]):
            ahead = local[at[:m] + 1] * b[:m]
            both = alpha[at[:m]].T @ (ahead / np.maximum((alpha[at[:m]] @ step * ahead).sum(1, keepdims=True), 1e-300))
            moves += both * step
            behind = ahead @ step.T
            b[:m] = behind / behind.sum(1, keepdims=True)
        p = alpha[at] * b[:n]
        out[at] = p / p.sum(1, keepdims=True)
    return out, moves


def _learn(field: Field, blocks: list[Words], golds: list[np.ndarray]) -> None:
    """Gradient steps on the log-likelihood of the words' labels, in place."""
    n = len(field.languages)
    squares, move_squares, start_squares = np.full(field.weights.shape, 0.05), np.full((n, n), 1.0), np.full(n, 1.0)
    for _ in range(EPOCHS):
        for w, gold in zip(blocks, golds, strict=True):
            if not len(gold):
                continue
            p, moves = field.marginals(w)
            bounds = w.bounds()
            texts = max(1, int((np.diff(bounds) > 0).sum()))
            gap = p.copy()
            gap[np.arange(len(gold)), gold] -= 1
            rows, grams, word = features(w)
            grad = np.zeros_like(field.weights)
            shared = gap / np.maximum(np.bincount(word, minlength=len(gap)), 1)[:, None] * 2
            for j in range(n):
                for k in range(rows.shape[1]):
                    grad[:, j] += np.bincount(rows[:, k], gap[:, j], ROWS)
                if len(grams):
                    grad[:, j] += np.bincount(grams, shared[word, j], ROWS)
            grad /= texts
            squares += grad * grad
            field.weights -= RATE * grad / np.sqrt(squares)
            inside = np.ones(len(gold), bool)
            firsts = bounds[:-1][np.diff(bounds) > 0]
            inside[firsts] = False
            at = np.flatnonzero(inside)
            seen = np.bincount(gold[at - 1] * n + gold[at], minlength=n * n).reshape(n, n)
            move_grad = (moves - seen) / texts
            move_squares += move_grad**2
            field.transitions -= RATE * move_grad / np.sqrt(move_squares)
            start_grad = gap[firsts].sum(0) / texts
            start_squares += start_grad**2
            field.start -= RATE * start_grad / np.sqrt(start_squares)


def fit(texts: list[str | None], langs: list[str]) -> Field:
    names = sorted(set(langs))
    n = len(names)
    field = Field(names, np.zeros((ROWS, n)), np.zeros(n), np.full((n, n), -1.0) + 2.0 * np.eye(n))
    if n < 2:
        return field
    number = {x: k for k, x in enumerate(names)}
    blocks, golds = [], []
    for a, b in in_blocks([len(t or "") for t in texts], BATCH_CHARS):
        w = words_of(texts[a:b], letters_only=True, lower=True)
        blocks.append(w)
        golds.append(np.array([number[x] for x in langs[a:b]])[w.text_of])
    _learn(field, blocks, golds)
    again = []
    flat = Field(names, field.weights, np.zeros(n), np.zeros((n, n)) + 1.5 * np.eye(n))
    for w, gold in zip(blocks, golds, strict=True):
        p = flat.marginals(w)[0] if len(gold) else np.zeros((0, n))
        again.append(np.where(p.max(1) >= RELABEL_FROM, p.argmax(1), gold) if len(gold) else gold)
    _learn(field, blocks, again)
    return field


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, rows_a_language: int = LANGUAGE_ROWS) -> Field:
    """Fit on up to ``rows`` texts of ``SAMPLE_BYTES`` whose language is known and whose id is not held out.

    Ids enter in turns of the languages, each in order of its ids' hashes and with at most ``rows_a_language``
    of them, so that a language is learned however rare it is, while there are fewer than ``rows`` languages.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    # Spark cuts this rank to the first rows of each language before they are shuffled
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    turns = ids.withColumn("turn", turn).filter(F.col("turn") <= rows_a_language)
    chosen = turns.orderBy("turn", F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
    table = whole_texts(sample, SAMPLE_BYTES).toPandas()
    table = table[np.array([has_letter(t) for t in table["text"]], bool)].sort_values(["doc_id", "lang", "text"], kind="stable")
    return fit(table["text"].tolist(), table["lang"].tolist())


def label_texts(texts: list[str | None], field: Field) -> tuple[list[str], np.ndarray]:
    """The language of each text and its share of the words' probability."""
    n = len(field.languages)
    names, share = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not n:
        return names, share
    for a, b in in_blocks([len(t or "") for t in texts], 1 << 22):
        w = words_of(texts[a:b], letters_only=True, lower=True)
        p, _ = field.marginals(w)
        mass = np.stack([np.bincount(w.text_of, p[:, j], b - a) for j in range(n)], 1)
        best, whole = mass.argmax(1), mass.sum(1)
        for k in range(b - a):
            if whole[k] and has_letter(texts[a + k]):
                names[a + k] = field.languages[best[k]]
                share[a + k] = min(1.0, mass[k, best[k]] / whole[k])
    return names, share


def label_words(text: str | None, field: Field) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of a text, its letters in lower case."""
    w = words_of([text], letters_only=True, lower=True)
    if not len(w.starts) or not field.languages:
        return []
    p, _ = field.marginals(w)
    words = [w.buffer[s : s + k].decode("utf-8", "replace") for s, k in zip(w.starts, w.sizes, strict=True)]
    return [(x, field.languages[j], float(q[j])) for x, q, j in zip(words, p, p.argmax(1), strict=True)]


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """All rows and columns of ``docs`` with ``language`` (a learned one or ``und``) and ``language_share``.

    Columns of those names are replaced. Texts that are null or have no letter are ``und`` with share 0.
    Repeated rows are labelled alike. An empty table gives an empty result; without any text to learn
    from, all texts are ``und``.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)  # its size depends on the number of languages alone

    @F.pandas_udf("language string, share double")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for text in parts:
            names, share = label_texts(text.tolist(), own)
            yield pd.DataFrame({"language": names, "share": share})

    out = docs.withColumn("_labelled", label("text"))
    out = out.withColumn("language", F.col("_labelled.language")).withColumn("language_share", F.col("_labelled.share"))
    return out.drop("_labelled")


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("language").alias("lang_pred"),
        F.col("language_share").alias("score"),
    )

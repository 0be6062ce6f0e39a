"""Cross-entropy difference of a target and a background bigram model over one vocabulary.

The background model counts all documents, the target model those marked as wanted. Both interpolate
bigrams with unigrams that are smoothed over the same vocabulary, so that a word that the target lacks
costs the same model family in both. A document's score is the mean over its words of the background's
loss subtracted from the target's: the lower, the more the text is like the target.

Counts are gathered by asking (see ``exchange``): a chunk sends its different words and word pairs with
how often they occur in all and in wanted documents, and gets back the corpus totals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, release
from .exchange import PACKET, Chunks, Sums, ask, exchange, replies_of, stage, table_of
from .words import Words, mixed, words_of

BIGRAM_SHARE = 0.7  # weight of the bigram estimate where its first word is known
SMOOTHING = 0.5  # added to every word of the vocabulary
SCHEMA = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def _keys(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words, keys of the pair that ends at each word, and whether a word begins its text.

    A word's first pair is with the mark for a text's begin.
    """
    h = w.hashes()
    begins = np.ones(len(h), bool)
    begins[1:] = w.text_of[1:] != w.text_of[:-1]
    before = np.concatenate([np.zeros(min(1, len(h)), np.uint64), h[:-1]])
    before[begins] = 0
    return mixed(h, 71), mixed(before * np.uint64(3) ^ mixed(h, 72), 73), begins


def _counted(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys, the place of each given key and (keys, 2) counts: all and wanted."""
    kinds, place = np.unique(keys, return_inverse=True)
    counts = np.stack([np.bincount(place, minlength=len(kinds)), np.bincount(place, wanted, len(kinds)).astype(np.int64)], 1)
    return kinds, place, counts


class Counts(Sums):
    """Totals in all and in wanted documents; the first answer of a bucket also tells of its words.

    That is how many different ones there are, how often they occur, and how often in wanted documents.
    Answers are (totals, these three numbers).
    """

    def __init__(self):
        super().__init__(2)

    def settle(self, whole):
        is_word = whole[0] % 2 == 0
        return whole[1], np.array([is_word.sum(), *whole[1][is_word].sum(0)], np.int64)

    def reply(self, whole, answers, k: int, part) -> bytes:
        head = answers[1] if k == 0 else np.zeros(3, np.int64)
        return head.astype("<i8").tobytes() + super().reply(whole, answers[0], k, part)

    def heard(self, whole, replies, used: int, step: int):
        heads = np.frombuffer(b"".join(data[:24] for data, _ in replies), "<i8").reshape(-1, 3)
        return super().heard(whole, [(data[24:], n) for data, n in replies], used, step), heads.sum(0)


def losses(word: np.ndarray, before: np.ndarray, pair: np.ndarray, total: float, kinds: float) -> np.ndarray:
    """Negative log2 probabilities from the counts of a word, its predecessor and their pair."""
    uni = (word + SMOOTHING) / (total + SMOOTHING * max(kinds, 1))
    share = np.where(before > 0, BIGRAM_SHARE, 0.0)
    return -np.log2(share * pair / np.maximum(before, 1) + (1 - share) * uni)


def _gather(chunks: Chunks, wanted: DataFrame) -> DataFrame:
    """Totals of all keys for the chunks that hold them."""
    levels = chunks.levels
    texts = chunks.table("doc_id", "text")

    def ask_counts(t: pa.Table, marked: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table_of([])
        mark = set(marked.column("doc_id").to_pylist())
        is_wanted = np.array([d in mark for d in t.column("doc_id").to_pylist()], bool)
        w = words_of(t.column("text").to_pylist(), lower=True, accents=False)
        words, pairs, _ = _keys(w)
        # words have an even key, pairs an odd one
        keys = np.concatenate([words & ~np.uint64(1), pairs | np.uint64(1)])
        kinds, _, counts = _counted(keys, np.tile(is_wanted[w.text_of], 2))
        return give_back(ask(Counts(), t.column("chunk")[0].as_py(), (kinds, counts), levels))

    both = texts.groupBy("chunk").cogroup(wanted.groupBy("chunk"))
    totals = exchange(both.applyInArrow(ask_counts, PACKET), Counts(), levels, "lm-totals")
    release(chunks.spark)
    return totals


def _sizes(totals: DataFrame) -> DataFrame:
    """(kinds, all, wanted) of the words, from the numbers that each bucket's first answer carries."""
    head = F.expr("substring(data, 1, 24)")

    def read(batches):
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8").reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(raw[:, k]) for k in range(3)], ["kinds", "all", "wanted"])

    return totals.select(head.alias("head")).mapInArrow(read, "kinds long, all long, wanted long")


def score(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score), one row per row of ``docs``.

    ``wanted`` holds the doc_ids of the target. Losses are mean bits a word; score is target_loss less
    background_loss. Texts without words, null ones included, have null losses and score. Rows that repeat an
    id or a text are counted as often as they come. Without wanted documents the target is the smoothed
    uniform model. An empty table gives an empty result. Other columns are ignored.
    """
    chunks = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    ids = chunks.table("doc_id").distinct()
    wanted = cut(ids.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), "lm-wanted")
    totals = _gather(chunks, wanted)
    size = _sizes(totals).agg(*[F.sum(c).alias(c) for c in ("kinds", "all", "wanted")]).first()
    kinds, n_all, n_wanted = (float(size[c] or 0) for c in ("kinds", "all", "wanted"))
    levels = chunks.levels

    def marked_of(replies: pa.Table) -> list[int]:
        return replies.filter(pa.array(replies.column("bucket").to_numpy() < 0)).column("doc_id").to_pylist()

    def apply(t: pa.Table, replies: pa.Table) -> pa.Table:
        w = words_of(t.column("text").to_pylist(), lower=True, accents=False)
        words, pairs, begins = _keys(w)
        keys = np.concatenate([words & ~np.uint64(1), pairs | np.uint64(1)])
        mark = set(marked_of(replies))
        is_wanted = np.array([d in mark for d in t.column("doc_id").to_pylist()], bool)
        kinds_here, place, counts = _counted(keys, np.tile(is_wanted[w.text_of], 2))
        told = replies.filter(pa.array(replies.column("bucket").to_numpy() >= 0))
        got = Counts().heard((kinds_here, counts), replies_of(told), 0, levels[0])[0][place]
        word, pair = got[: len(words)], got[len(words) :]
        before = np.concatenate([np.zeros((min(1, len(word)), 2), np.int64), word[:-1]])
        before[begins] = 0
        n_words = np.bincount(w.text_of, minlength=w.n_texts)
        some = np.maximum(n_words, 1)
        means = []
        for k, total in ((1, n_wanted), (0, n_all)):
            loss = losses(word[:, k], before[:, k], pair[:, k], total, kinds)
            means.append(np.bincount(w.text_of, loss, w.n_texts) / some)
        none = n_words == 0
        out = pa.table(
            {
                "doc_id": t.column("doc_id"),
                "n_words": pa.array(n_words, pa.int64()),
                "target_loss": pa.array(means[0], pa.float64(), mask=none),
                "background_loss": pa.array(means[1], pa.float64(), mask=none),
                "score": pa.array(means[0] - means[1], pa.float64(), mask=none),
            }
        )
        return give_back(out)

    texts = chunks.table("doc_id", "text")
    marks = wanted.select(F.lit(-1).cast("long").alias("bucket"), "chunk", F.lit(0).alias("n"), F.lit(None).cast("binary").alias("data"), "doc_id")
    told = totals.withColumn("doc_id", F.lit(None).cast("long")).unionByName(marks)
    out = cut(texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(apply, SCHEMA), "lm-scores")
    chunks.drop()
    return out


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    wanted = labels.filter((F.col("quality") == 1) & (F.col("toxic") == 0))
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), wanted)

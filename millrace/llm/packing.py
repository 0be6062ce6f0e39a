"""Best-fit packing of documents into training sequences, planned on a histogram of lengths.

Documents are tokenised and cut into pieces where they lie. Only the number of pieces of each length
(at most ``capacity`` numbers) reaches the driver, which runs best-fit decreasing over counts: all
bins that look alike are handled at once. The plan says which ranks of a length go to which run of
sequences; pieces take their places by a join on (length, rank within the length).
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back

CAPACITY = 2048
END_ID = 0
CACHED_WORDS = 300_000  # about 45 MB a Python worker

# Characters for which lower-casing and composing act on each one alone: the rest takes the slow way.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e¡-±´-¸º»¿-įĲ-ňŊ-ž–-„]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class _Numbers(dict):
    """Words numbered in the order in which they are first looked up; new ones also go to a list."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordTokenizer:
    """Ids of whole texts from a word-level BPE file, with the ids of blank-separated words kept.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its
    words one after the other. Texts with unusual characters or special tokens are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # for words that are in lower case and split already
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        bytes_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_only])
        self.ends_piece = np.zeros(max(self.plain.get_vocab().values()) + 1, bool)
        for token, number in self.plain.get_vocab().items():
            self.ends_piece[number] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbers()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 16, np.int64)  # the ids of word i lie from bounds[i] to bounds[i + 1]
        self.used = 0

    def _learn(self) -> None:
        """Encode the words that were numbered since the last call; every piece ends with one ending token."""
        words, self.known.new = self.known.new, []
        pieces = [[w] if w.isalpha() else _PIECES.findall(w) for w in words]
        text = " ".join(x for own in pieces for x in own)
        flat = np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        last = np.flatnonzero(self.ends_piece[flat]) + 1
        last = last[np.cumsum([len(own) for own in pieces]) - 1]
        n = len(self.known)
        while n + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.bounds[n - len(words) + 1 : n + 1] = self.used + last
        self.used += len(flat)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > CACHED_WORDS:
            self._clear()
        number, out = self.known.__getitem__, []
        for text in texts:
            if "<|" in text or not _PLAIN.fullmatch(text):
                out.append(None)
            else:
                words = text.lower().split()
                out.append(np.fromiter(map(number, words), np.int64, len(words)))
        if self.known.new:
            self._learn()
        for k, at in enumerate(out):
            if at is None:
                out[k] = np.array(self.whole.encode(texts[k], add_special_tokens=False).ids, np.uint32)
            elif not len(at):
                out[k] = np.zeros(0, np.uint32)
            else:
                start = self.bounds[at]
                size = self.bounds[at + 1] - start
                after = np.cumsum(size)
                out[k] = self.ids[np.arange(after[-1]) + np.repeat(start - after + size, size)]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One per Python worker and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; (part, nth) numbers the pieces of one length within a task."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = tokenizer_of(tokenizer_path).encode_all
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                doc_ids = some.column(0).to_pylist()
                texts = [x or "" for x in some.column(1).to_pylist()]
                rows = []
                for doc_id, ids in zip(doc_ids, encode_all(texts), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((doc_id, piece, start, len(own), zlib.crc32(own), part, seen[len(own)]))
                        seen[len(own)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)
            give_back(None)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, PIECE_SCHEMA)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs (length, first rank, pieces, first sequence, pieces per sequence, first offset): the
    k-th piece of a run goes to sequence ``first + k // per`` at ``offset + (k % per) * length``. Runs
    number a small multiple of ``capacity``, whatever the counts.
    """
    plan = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, how many)
    frees: list[int] = []
    opened = 0

    def add(free: int, first: int, many: int) -> None:
        if free and many:
            if free not in room:
                room[free] = []
                insort(frees, free)
            room[free].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(frees, length)
            if k < len(frees):
                free = frees[k]
                first, many = room[free].pop()
                if not room[free]:
                    del room[free]
                    frees.pop(k)
                per = free // length
            else:
                free, per = capacity, capacity // length
                first, many = opened, -(-left // per)
                opened += many
            full = min(many, left // per)
            if full:
                plan.append((length, rank, full * per, first, per, capacity - free))
                rank, left = rank + full * per, left - full * per
                add(free - per * length, first, full)
            if full < many and left:  # fewer than ``per`` are left: they share one sequence
                plan.append((length, rank, left, first + full, left, capacity - free))
                add(free - left * length, first + full, 1)
                left, full = 0, full + 1
            add(free, first + full, many - full)
    return plan


PLAN_SCHEMA = "p_length int, first_rank long, n long, first_sequence long, per long, first_offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all rows of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A document is
    its ids and an end id; only documents longer than ``capacity`` are cut. Null and empty texts are
    a piece of one token. Repeated rows are packed as often as they come, null ids too. An empty
    table gives an empty result. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    table = cut(pieces(docs, tokenizer_path, capacity), "pack-pieces")
    by_part = cut(table.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(best_fit(counts, capacity), PLAN_SCHEMA)
    # ranks within a length: a task's pieces come after those of the tasks before it
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_start"))
    ranked = table.join(starts, ["length", "part"]).withColumn("rank", F.col("rank_start") + F.col("nth"))
    k = F.col("rank") - F.col("first_rank")
    placed = ranked.join(  # the plan's size follows from the capacity alone
        F.broadcast(runs), (F.col("length") == F.col("p_length")) & (k >= 0) & (k < F.col("n"))
    )
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("first_sequence") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (k % F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())

"""Suffix-array deduplication: bytes covered by 50-byte strings that start in an earlier document.

A blockwise construction over a difference cover. Modulo 13 the residues of the cover meet every
difference, so that any two suffixes that agree on 50 bytes both have, at one distance d < 13, a position
of the cover (a sampled suffix), and their order is that of the d bytes before it and then of the sampled
suffixes. So only sampled suffixes travel, and of those only the ones whose first 38 bytes several
documents hold (asked for by hash first, which can only let too many through).

They are sorted one bucket at a time, a bucket being all sampled suffixes whose first 38 bytes have a hash
with the same highest bits. One sort by bytes gives the ranks of the sampled suffixes at every depth from
38 to 50, another the ranks of the 12 bytes before them. Then, for one distance d after the other, the
suffixes that begin d bytes earlier are sorted by the rank of their d bytes, ties by the precomputed rank
of the cover sample at depth 50 - d; what ties on both agrees on all 50 bytes, and the earliest document
is known. Ranks come from comparing bytes, so that every match is certain.

A string that very many documents hold (``HOT``) would fill a bucket with its surroundings. Its suffixes
travel by themselves instead, 50 bytes each and once for each chunk, dealt by all their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, give_back, release
from .exchange import PACKET, Chunks, Sums, ask, exchange, from_planes, planes, replies_of, stage, table_of

LENGTH = 50
PERIOD, COVER = 13, (0, 1, 3, 9)  # a perfect difference cover
AROUND = PERIOD - 1  # bytes before a sampled string, and behind it, that a suffix of LENGTH may reach
SAMPLED = LENGTH - AROUND
HOT = 20_000  # occurrences in all documents, but for those in one document of a chunk
# a record: the sampled string, the bytes behind it, how many of them there are, how many before it, those backwards
BEHIND, BEFORE, WIDTH = LENGTH, LENGTH + 1, 64
WHOLE = 255  # in place of the number of bytes before: the record is a suffix by itself
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _name(load, n: int) -> np.ndarray:
    """Hashes of ``n``-byte strings whose 8-byte words ``load(offset)`` gives (n is 8 at least)."""
    h = load(0)
    for k, offset in enumerate([*range(8, n - 7, 8), *([n - 8] if n % 8 else [])]):
        h = h * _M[k % 3]
        h ^= h >> np.uint64(31)
        h ^= load(offset)
    h = h * _M[3]
    h ^= h >> np.uint64(29)
    h *= _M[0]
    return h ^ (h >> np.uint64(32))


class Text:
    """The documents of a chunk in order of their ids, joined. A null id is the least long."""

    def __init__(self, doc_ids: list[int | None], texts: list[str | None]):
        ids = [-(2**63) if i is None else i for i in doc_ids]
        self.order = sorted(range(len(ids)), key=ids.__getitem__)
        self.raw = [(texts[i] or "").encode("utf-8") for i in self.order]
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        self.sizes = np.array([len(r) for r in self.raw], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.n = int(self.sizes.sum())
        self.buffer = bytes(AROUND) + b"".join(self.raw) + bytes(LENGTH + 16)
        self.data = np.frombuffer(self.buffer, np.uint8)
        self.words = np.ndarray((len(self.buffer) - 7,), "<u8", self.buffer, 0, (1,))

    def document_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def sample(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled positions whose string ends within their document, their documents, and the strings' hashes."""
        at = (np.arange(0, self.n, PERIOD)[:, None] + np.array(COVER)).ravel()
        at = at[at < self.n]
        document = np.repeat(np.arange(len(self.ends)), np.diff(np.searchsorted(at, self.ends), prepend=0))
        fits = self.ends[document] - at >= SAMPLED
        at, document = at[fits], document[fits]
        from_here = at + AROUND
        return at, document, _name(lambda o: self.words[from_here + o], SAMPLED)

    def _bytes(self, at: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` bytes from each position on, as rows."""
        return np.lib.stride_tricks.sliding_window_view(self.data, n)[at + AROUND]

    def records(self, at: np.ndarray, document: np.ndarray) -> np.ndarray:
        """(positions, WIDTH) bytes for sampled positions; what lies outside their document is 0."""
        out = np.zeros((len(at), WIDTH), np.uint8)
        behind = np.minimum(self.ends[document] - at - SAMPLED, AROUND)
        before = np.minimum(at - (self.ends[document] - self.sizes[document]), AROUND)
        far = np.arange(AROUND)
        out[:, :LENGTH] = self._bytes(at, LENGTH)
        out[:, SAMPLED:LENGTH][far >= behind[:, None]] = 0
        out[:, BEHIND], out[:, BEFORE] = behind, before
        out[:, BEFORE + 1 :] = self._bytes(at - AROUND, AROUND)[:, ::-1]
        out[:, BEFORE + 1 :][far >= before[:, None]] = 0
        return out

    def whole_suffixes(self, at: np.ndarray) -> np.ndarray:
        """The records of suffixes that travel by themselves."""
        out = np.zeros((len(at), WIDTH), np.uint8)
        out[:, :LENGTH] = self._bytes(at, LENGTH)
        out[:, BEFORE] = WHOLE
        return out


def _text_of(t: pa.Table) -> Text:
    return Text(t.column("doc_id").to_pylist(), t.column("text").to_pylist())


def distances(records: np.ndarray) -> np.ndarray:
    """(records,) bit d is set where the suffix that begins d bytes before the sampled string is in the document."""
    behind, before = records[:, BEHIND].astype(np.int64), records[:, BEFORE].astype(np.int64)
    least = np.maximum(AROUND - behind, 0)
    bits = np.where(before >= least, (np.int64(2) << np.minimum(before, AROUND)) - (np.int64(1) << least), 0)
    return np.where(before == WHOLE, 1, bits).astype(np.uint16)


class Repeats(Sums):
    """For a hash that several documents hold the answer is 1, for one of more than ``hot`` counts 2, else 0."""

    def __init__(self, hot: int = HOT):
        super().__init__()
        self.hot = hot

    def settle(self, whole):
        return (whole[1][:, 0] > 1).astype(np.uint8) + (whole[1][:, 0] > max(1, self.hot))

    def reply(self, whole, answers, k: int, part) -> bytes:
        own = answers[whole[2][k]]
        return np.packbits(own > 0).tobytes() + np.packbits(own > 1).tobytes()

    def heard(self, whole, replies, used: int, step: int):
        parts = [np.zeros(0, np.uint8)]
        for data, n in replies:
            both = np.frombuffer(data, np.uint8).reshape(2, -1)
            parts.append(np.unpackbits(both, axis=1, count=n).sum(0, dtype=np.uint8))
        return np.concatenate(parts)


class Suffixes:
    """Items are records with the least id of a document that holds them.

    The answer to a record has bit d set if an earlier document holds the suffix that begins d bytes
    before the sampled string. A whole is (records in the order of their bytes, ids, the place of each
    part's records in it).
    """

    def merged(self, parts):
        records = np.concatenate([np.zeros((0, WIDTH), np.uint8), *[r for r, _ in parts]])
        ids = np.concatenate([np.zeros(0, np.int64), *[i for _, i in parts]])
        words = records.view(">u8").astype(np.uint64)
        order = np.lexsort(words.T[::-1])
        ordered = words[order]
        new = np.ones(len(order), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(1)
        first = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[order], first) if len(first) else ids
        return records[order[first]], least, np.split(place, np.cumsum([len(i) for _, i in parts])[:-1])

    def _dealt(self, records: np.ndarray, used: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Records in the order of their buckets, and where each bucket begins in it."""

        def load(o):
            return np.ascontiguousarray(records[:, o : o + 8]).view("<u8").ravel()

        deal = np.where(records[:, BEFORE] == WHOLE, _name(load, LENGTH), _name(load, SAMPLED))
        bucket = ((deal << np.uint64(used)) >> np.uint64(64 - step)).astype(np.int64) if step else np.zeros(len(deal), np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange((1 << step) + 1))

    def split(self, whole, used: int, step: int):
        records, ids = whole[:2]
        order, edges = self._dealt(records, used, step)
        packer = zstandard.ZstdCompressor(level=1)
        for sub in np.flatnonzero(np.diff(edges)):
            own = order[edges[sub] : edges[sub + 1]]
            unsigned = ids[own].view(np.uint64) ^ np.uint64(1 << 63)
            yield int(sub), len(own), packer.compress(planes(unsigned) + records[own].tobytes())

    def read(self, data: bytes, n: int):
        data = zstandard.ZstdDecompressor().decompress(data)
        unsigned, at = from_planes(data, n)
        return np.frombuffer(data, np.uint8, n * WIDTH, at).reshape(n, WIDTH), (unsigned ^ np.uint64(1 << 63)).view(np.int64)

    def settle(self, whole):
        records, ids = whole[:2]
        out = np.zeros(len(ids), np.uint16)
        of = np.flatnonzero(records[:, BEFORE] != WHOLE)  # suffixes by themselves that are here differ from each other
        if len(of) < 2:
            return out
        records, ids, valid = records[of], ids[of], distances(records[of])
        right = _common(records[:, :LENGTH])
        backwards = np.zeros((len(of), 16), np.uint8)
        backwards[:, :AROUND] = records[:, BEFORE + 1 :]
        words = backwards.view(">u8").astype(np.uint64)
        by_left = np.lexsort((words[:, 1], words[:, 0]))
        left = _common(backwards[by_left, :AROUND])
        for d in range(PERIOD):
            rank = np.concatenate([[0], np.cumsum(right < LENGTH - d)])
            some = np.flatnonzero(valid >> d & 1)
            same = rank[some][1:] == rank[some][:-1]
            some = some[np.append(False, same) | np.append(same, False)] if len(some) else some
            if not len(some):
                continue
            left_rank = np.empty(len(of), np.int64)
            left_rank[by_left] = np.concatenate([[0], np.cumsum(left < d)])
            suffix = left_rank[some] << 32 | rank[some]  # its d bytes, and the rank of the cover sample behind them
            order = np.argsort(suffix, kind="stable")
            suffix, some = suffix[order], some[order]
            first = np.flatnonzero(np.append(True, suffix[1:] != suffix[:-1]))
            least = np.repeat(np.minimum.reduceat(ids[some], first), np.diff(np.append(first, len(some))))
            out[of[some[ids[some] > least]]] |= np.uint16(1 << d)
        return out

    def answers_of(self, whole, answers, k: int, part) -> np.ndarray:
        """For a part's records: all distances if an earlier document holds the very record."""
        place = whole[2][k]
        return np.where(part[1] > whole[1][place], distances(part[0]), answers[place])

    def reply(self, whole, answers, k: int, part) -> bytes:
        return planes(self.answers_of(whole, answers, k, part))

    def heard(self, whole, replies, used: int, step: int):
        got = [from_planes(data, n)[0].astype(np.uint16) for data, n in replies]
        out = np.zeros(len(whole[1]), np.uint16)
        if got:
            out[self._dealt(whole[0], used, step)[0]] = np.concatenate(got)
        return out


def _common(ordered: np.ndarray) -> np.ndarray:
    """How many bytes each row, but the first, shares with the one before it."""
    differs = np.ones((max(0, len(ordered) - 1), ordered.shape[1] + 1), bool)
    differs[:, :-1] = ordered[1:] != ordered[:-1]
    return differs.argmax(1)


class Sample:
    """The cover sample of a chunk: occurrences, and the different hashes with a count.

    The count is 1 for a hash of one document, else that of its occurrences.
    """

    def __init__(self, text: Text, mask: np.uint64):
        self.at, self.document, name = text.sample()
        keys = name & mask
        self.order = np.argsort(keys)
        keys, document = keys[self.order], self.document[self.order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        self.first = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.first, len(keys)))
        n = np.ones(len(self.first), np.int64)
        if len(keys):
            several = np.minimum.reduceat(document, self.first) != np.maximum.reduceat(document, self.first)
            n[several] = self.sizes[several]
        self.whole = keys[self.first], n[:, None]

    def flags(self, replies: list[tuple[bytes, int]], levels: list[int]) -> np.ndarray:
        """For every occurrence the answer to its hash."""
        told = Repeats().heard(self.whole, replies, 0, levels[0])
        out = np.empty(len(self.at), np.uint8)
        out[self.order] = np.repeat(told, self.sizes)
        return out


def local_records(text: Text, sample: Sample, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, records, ids) of the sampled suffixes that several documents may hold."""
    at, document = sample.at[flags == 1], sample.document[flags == 1]
    hot, of = sample.at[flags == 2], sample.document[flags == 2]
    begin = (hot[:, None] - np.arange(PERIOD)).ravel()
    of = np.repeat(of, PERIOD)
    fits = (begin >= text.ends[of] - text.sizes[of]) & (begin + LENGTH <= text.ends[of])
    begin = np.unique(begin[fits])
    records = np.concatenate([text.records(at, document), text.whole_suffixes(begin)])
    return np.append(at, begin), records, text.ids[np.append(document, text.document_of(begin))]


def removed_bytes(text: Text, at: np.ndarray, distance_bits: np.ndarray) -> np.ndarray:
    """Which bytes are covered by the suffixes of LENGTH bytes that begin at the given distances before ``at``."""
    starts = np.zeros(text.n + 1, bool)
    for d in range(PERIOD):
        starts[at[(distance_bits >> d & 1) > 0] - d] = True
    begin = np.flatnonzero(starts)
    covered = np.zeros(text.n + LENGTH + 1, np.int32)
    covered[begin] += 1
    covered[begin + LENGTH] -= 1
    return np.cumsum(covered)[: text.n] > 0


def find_repeats(chunks: Chunks, hot: int) -> tuple[DataFrame, DataFrame]:
    """The answers to all chunks' cover samples, and to their records."""
    texts, levels, mask = chunks.table("doc_id", "text"), chunks.levels, chunks.key_mask

    def ask_sample(t: pa.Table) -> pa.Table:
        return give_back(ask(Repeats(), t.column("chunk")[0].as_py(), Sample(_text_of(t), mask).whole, levels))

    flags = exchange(texts.groupBy("chunk").applyInArrow(ask_sample, PACKET), Repeats(hot), levels, "cover-sample")
    release(chunks.spark)

    def ask_records(t: pa.Table, r: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table_of([])
        text = _text_of(t)
        sample = Sample(text, mask)
        _, records, ids = local_records(text, sample, sample.flags(replies_of(r), levels))
        return give_back(ask(Suffixes(), t.column("chunk")[0].as_py(), Suffixes().merged([(records, ids)]), levels))

    both = texts.groupBy("chunk").cogroup(flags.groupBy("chunk"))
    found = exchange(both.applyInArrow(ask_records, PACKET), Suffixes(), levels, "suffixes")
    release(chunks.spark)
    return flags, found


def remove_repeats(docs: DataFrame, text_out: bool = True, hot: int = HOT) -> DataFrame:
    """Every row of ``docs`` with what is left of its text after repeated strings are removed.

    A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id;
    strings are judged on the input. Columns: those of ``docs``, with ``text`` replaced by the remaining
    bytes (if ``text_out``; parts of a character that a cut leaves become U+FFFD) and n_bytes, n_removed,
    n_spans and kept_sha256 added (columns of those names, and one named ``chunk``, are replaced). Null
    texts count as empty and stay null. Texts under 50 bytes lose nothing. Rows of one id do not remove
    each other's bytes; null ids are one id, before all others but the least long. An empty table gives an
    empty result. A document is read whole by one task, so that its size bounds the memory of a task.
    """
    added = ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"]
    kept = [f for f in docs.schema if f.name not in {a.split()[0] for a in added} | {"chunk"}]
    kept = [f for f in kept if text_out or f.name in ("doc_id", "text")]
    schema = T.StructType([f for f in kept if text_out or f.name != "text"])
    for a in added:
        name, kind = a.split()
        schema = schema.add(name, T.LongType() if kind == "long" else T.StringType())
    chunks = stage(docs.select(*[f.name for f in kept]))
    levels, mask = chunks.levels, chunks.key_mask
    flags, found = find_repeats(chunks, hot)
    replies = flags.withColumn("kind", F.lit(0)).unionByName(found.withColumn("kind", F.lit(1)))

    def apply(t: pa.Table, r: pa.Table) -> pa.Table:
        text = _text_of(t)
        kind = r.column("kind").to_numpy()
        told = [replies_of(r.filter(pa.array(kind == k))) for k in (0, 1)]
        sample = Sample(text, mask)
        at, records, ids = local_records(text, sample, sample.flags(told[0], levels))
        whole = Suffixes().merged([(records, ids)])
        answers = Suffixes().heard(whole, told[1], 0, levels[0])
        gone = removed_bytes(text, at, Suffixes().answers_of(whole, answers, 0, (records, ids)))
        rows: list[tuple] = [()] * len(text.raw)
        for k, (i, raw) in enumerate(zip(text.order, text.raw, strict=True)):
            own = gone[text.ends[k] - text.sizes[k] : text.ends[k]]
            left = np.frombuffer(raw, np.uint8)[~own].tobytes()
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if len(own) else 0
            rows[i] = (len(raw), int(own.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if text_out else None)
        n_bytes, n_removed, n_spans, digest, left = zip(*rows, strict=True) if rows else [[]] * 5
        columns = {f.name: t.column(f.name) for f in kept if f.name != "text"}
        if text_out:
            was = t.column("text").to_pylist()
            columns["text"] = pa.array([None if w is None else x for w, x in zip(was, left, strict=True)], pa.string())
        for name, values in zip(["n_bytes", "n_removed", "n_spans"], [n_bytes, n_removed, n_spans], strict=True):
            columns[name] = pa.array(values, pa.int64())
        columns["kept_sha256"] = pa.array(digest, pa.string())
        return give_back(pa.table({f.name: columns[f.name] for f in schema}))

    out = chunks.table().groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(apply, schema)
    path = fresh_path(chunks.spark, "substrings")
    out.write.option("compression", "zstd").parquet(path)
    chunks.drop()
    return chunks.spark.read.schema(schema).parquet(path)


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every document: bytes, bytes and spans removed, hash of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, text_out=False)

"""Words of many texts at once, as numpy arrays over one joined UTF-8 buffer."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

PAD = 16
LONG_BYTES = 512  # words from here on are hashed one by one, so that no text costs a pass for every 8 bytes
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_K = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ALNUM = _LETTER.copy()
_ALNUM[48:58] = True
_VISIBLE = np.ones(256, bool)
_VISIBLE[[0x20, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """``starts`` and ``sizes`` in bytes of ``data``; ``text_of`` numbers the text of each word."""

    data: np.ndarray
    buffer: bytes
    starts: np.ndarray
    sizes: np.ndarray
    text_of: np.ndarray
    text_starts: np.ndarray
    n_texts: int

    def loads(self, at: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """The first ``keep`` (0 to 8) bytes from each position as one number."""
        whole = np.ndarray((len(self.buffer) - 7,), "<u8", self.buffer, 0, (1,))
        return whole[at] & _KEEP[keep]

    def prefix_hash(self, n: int) -> np.ndarray:
        """A hash of the first ``n`` (up to 8) bytes of every word."""
        return mixed(self.loads(self.starts, np.minimum(self.sizes, n)), n)

    def hashes(self) -> np.ndarray:
        """A hash of every whole word: its size and its first and last 8 bytes, and every 8 between."""
        h = mixed(self.loads(self.starts, np.minimum(self.sizes, 8)), 0)
        h = mixed(h ^ self.sizes.astype(np.uint64), 1)
        for k in np.flatnonzero(self.sizes > LONG_BYTES):
            word = self.buffer[self.starts[k] : self.starts[k] + self.sizes[k]]
            h[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        long = np.flatnonzero((self.sizes > 8) & (self.sizes <= LONG_BYTES))
        at = self.starts[long] + 8
        ends = self.starts[long] + self.sizes[long]
        while len(long):
            h[long] = mixed(h[long] ^ self.loads(at, np.minimum(ends - at, 8)), 2)
            more = ends - at > 8
            long, at, ends = long[more], at[more] + 8, ends[more]
        return h

    def bounds(self) -> np.ndarray:
        """The words of text k are those from bounds[k] to bounds[k + 1]."""
        return np.searchsorted(self.text_of, np.arange(self.n_texts + 1))


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt * 0x632BE59BD9B4E019 & (2**64 - 1))) * _K[0]
    h ^= h >> np.uint64(32)
    h *= _K[1]
    h ^= h >> np.uint64(29)
    return h


def words_of(texts: list[str | None], letters_only: bool = False, lower: bool = False, accents: bool = True, alnum: bool = False) -> Words:
    """Words of all texts; null texts count as empty.

    Words are runs of visible characters, or with ``letters_only`` of ASCII letters and any character
    beyond ASCII, with ``alnum`` of ASCII digits too. ``lower`` lowers A to Z and, with ``accents``, the accented capitals of Latin-1.
    """
    encoded = [t.encode("utf-8") if t else b"" for t in texts]
    buffer = b"\n".join(encoded) + b"\n" + bytes(PAD)
    data = np.frombuffer(buffer, np.uint8)
    if lower:
        data = _LOWER[data]
        accented = np.flatnonzero(data[:-1] == 0xC3) + 1 if accents else np.zeros(0, np.int64)
        accented = accented[(data[accented] >= 0x80) & (data[accented] <= 0x9E) & (data[accented] != 0x97)]
        data[accented] += 32
        buffer = data.tobytes()
    text_sizes = np.array([len(t) + 1 for t in encoded], np.int64)
    text_starts = np.cumsum(text_sizes) - text_sizes
    kind = (_ALNUM if alnum else _LETTER if letters_only else _VISIBLE)[data]
    kind[len(data) - PAD - 1 :] = False
    edges = np.flatnonzero(np.diff(kind, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    text_of = np.searchsorted(text_starts, starts, side="right") - 1
    return Words(data[:-PAD], buffer, starts, ends - starts, text_of, text_starts, len(texts))


def in_blocks(sizes: list[int], most: int = 1 << 20):
    """Consecutive (from, to) ranges of texts, each of about ``most`` characters or one longer text."""
    at = total = 0
    for k, size in enumerate(sizes):
        if k > at and total + size > most:
            yield at, k
            at, total = k, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)

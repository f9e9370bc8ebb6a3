"""Words of whole Arrow batches as numpy arrays, and 64-bit hashes of words and of word n-grams.

A batch is read as one byte buffer: word boundaries, hashes and n-grams are found for all its documents at once,
with no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text taken at a time; one longer document is taken alone.
CHUNK = 2 << 20
_SEEDS = (0x94D049BB133111EB, 0xD6E8FEB86659FD93)
_LANE = np.uint64(0x9E3779B97F4A7C15)
#: By the number of bytes of a word in a lane of eight: which bits of the lane are the word's.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Space, tab, line feed, vertical tab, form feed and carriage return part words; all else is in words.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits and all bytes of other characters are in words.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of consecutive pieces of a text column; nulls become empty texts."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


class Words:
    """Words of the rows of one chunk. ``starts`` and ``ends`` are byte positions in ``data``; row r has the words first[r] up to first[r + 1]."""

    def __init__(self, texts: pa.Array, member: np.ndarray = SPACED, lower: bool = False):
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        self.at = offsets - offsets[0]
        self.data = _LOWER[data] if lower else data
        inside = member[data]
        head = np.empty(len(data) + 1, bool)
        head[:-1] = inside
        head[1:-1] &= ~inside[:-1]
        head[-1] = False
        tail = np.zeros(len(data) + 1, bool)
        tail[1:] = inside
        tail[1:-1] &= ~inside[1:]
        cut = self.at[(self.at > 0) & (self.at < len(data))]
        cut = cut[inside[cut] & inside[cut - 1]]  # a word ends with its document
        head[cut] = True
        tail[cut] = True
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail)
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(n), self.counts)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes. Words are read in lanes of eight bytes, each mixed with the seed and its place before lanes
        are summed; hashes of two seeds are independent, and together 128 bits."""
        if not len(self):
            return np.empty(0, np.uint64)
        lens = self.ends - self.starts
        lanes = (lens + 7) >> 3
        begins = np.cumsum(lanes) - lanes
        place = np.arange(int(lanes.sum())) - np.repeat(begins, lanes)
        at = np.repeat(self.starts, lanes) + 8 * place
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        value = np.ndarray((len(self.data),), "<u8", padded, strides=(1,))[at] & _MASK[np.minimum(np.repeat(self.ends, lanes) - at, 8)]
        with np.errstate(over="ignore"):
            value = _mix(_mix(value ^ np.uint64(_SEEDS[seed])) + (place.astype(np.uint64) + np.uint64(1)) * _LANE)
            return _mix(np.add.reduceat(value, begins) + lens.astype(np.uint64) * np.uint64(_SEEDS[1 - seed]))

    def words(self, i: int, j: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j], strict=True)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each n consecutive values of ``h``; what spans two rows is the caller's to leave out."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out *= np.uint64(_SEEDS[seed])
        out += h[j : j + size]
    return _mix(out)


def within(row: np.ndarray, n: int) -> np.ndarray:
    """True where n consecutive words lie in one row."""
    return row[: len(row) - n + 1] == row[n - 1 :] if len(row) >= n else np.empty(0, bool)

"""Vectorised word handling for a batch of texts: one byte buffer, numpy offsets, 64-bit hashes.

Helpers for the kernels that run inside Spark tasks.  A batch of texts is laid out in one buffer with a
separator byte after every text, so no word and no word window can reach over the end of a text.
Hashes here only ever *propose* equal words or windows; each caller says how it confirms them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text that one step of a kernel holds; its numpy arrays take about 40 times as much.
CHUNK_BYTES = 1 << 20

#: Bytes from which on a word is hashed by itself.
LONG_WORD = 256

SPACE_BYTES = b"\t\n\x0b\x0c\r "
#: For bytes.translate: white space of the word pattern `[^\x20\x09-\x0D]+` becomes a blank.
BY_SPACE = bytes(32 if b in SPACE_BYTES else b for b in range(256))
#: The same, with A-Z lower-cased.
BY_SPACE_LOWER = BY_SPACE.lower()
#: For the word pattern `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on lower-cased text: digits, a-z and all above ASCII.
BY_ALNUM_LOWER = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers = made[0], made[1]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a list of texts: `buf`, `starts` and `ends` (bytes), `doc` (index of the text), `counts`, `first`."""

    def __init__(self, texts: list[bytes], table: bytes):
        self.data = (b" ".join(texts) + b" ").translate(table)
        self.buf = np.frombuffer(self.data, np.uint8)
        inside = self.buf != 32
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.doc = np.searchsorted(text_ends, self.starts, "right")
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.buf))
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up)))
        out = mix((run[self.ends] - run[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD).tolist():  # some long words collide under any base
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=8).digest(), "little")
        return out

    @cached_property
    def _plain(self) -> tuple[bytes, list[int], list[int]]:
        """All words joined by one blank, and where each begins and ends."""
        lengths = self.ends - self.starts
        ends = np.cumsum(lengths + 1) - 1
        return b" ".join(self.data.split()), (ends - lengths).tolist(), ends.tolist()

    def joined(self, i: int, n: int) -> bytes:
        """Words i to i + n, joined by one blank."""
        data, starts, ends = self._plain
        return data[starts[i] : ends[i + n - 1]]


def runs(hashes: np.ndarray, lengths: np.ndarray | int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of runs of words: of every run of a fixed length, or of the runs that begin at `at`."""
    up, down = powers(len(hashes) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])))
    if at is None:
        at = np.arange(max(0, len(hashes) - int(lengths) + 1))
    return mix((total[at + lengths] - total[at]) * down[at] + np.asarray(lengths, np.uint64))


def texts_of(column: pa.Array) -> list[bytes]:
    """The bytes of a binary column; null is empty."""
    return [x or b"" for x in column.to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts take at most `limit` bytes together, or hold one text."""
    for batch in batches:
        texts = texts_of(batch.column(column))
        lo, size = 0, 0
        for hi, text in enumerate(texts):
            if hi > lo and size + len(text) > limit:
                yield batch.slice(lo, hi - lo), texts[lo:hi]
                lo, size = hi, 0
            size += len(text) + 1
        if lo < len(texts):
            yield batch.slice(lo), texts[lo:]

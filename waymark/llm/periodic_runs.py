"""Periodic runs: stretches of words that repeat with a period, by the method of Gusfield and Stoye.

A run is a stretch of words with smallest period q, `least_exponent` periods long or longer, which no
neighbouring word extends.  Each word of a run occurs at least `least_exponent` times in its text, and each
three words in a row at least `least_exponent` - 1 times; texts are cut where that doesn't hold, again and
again within what is left, so that only stretches that may hold a run are searched.  On these, laid out as one
string with a mark of its own behind each:

1. Names of all factors of length 2**k (Karp, Miller and Rosenberg) order the suffixes and tell the longest
   common extension of two places, to the right and to the left, in a few steps and without hashes.
2. The string is cut into Lempel-Ziv blocks.  A square (two equal halves in a row) whose first occurrence
   isn't within a block touches a block's edge; extensions round the edges give, for each edge and length of
   half, the first square: a set that covers the leftmost occurrence of every square.
3. From each of these squares a walk along suffix links (from the locus of a square to that of the square one
   word on) marks the loci of all squares of the same length that follow it: together, the vocabulary of
   squares, each a range of the suffix array, the tree's locus.  Squares whose half is a repetition itself are
   left out, as their runs have a smaller period.
4. The occurrences of the vocabulary, all places of their ranges, are sorted by period and place; places in a
   row are one run.

Defined results: null and empty texts have no words and no runs; repeated rows give a row each; a null doc_id
is kept; an empty table gives an empty result; a text is searched whole, in memory that grows with its own
length (about 40 bytes a word and 100 a word of periodic stretches); other columns are dropped by `find_runs`
and kept, whatever their names, by `collapse`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .wordbuf import chunks

LEAST_EXPONENT, LEAST_LENGTH = 4, 6
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Run(NamedTuple):
    start: int
    length: int
    period: int


class Factors:
    """Names of the factors of a string of ints whose length is a power of two: equal names for equal factors, in their order.

    The string ends with a mark that occurs once, so factors that would reach over its end differ from all others.
    """

    def __init__(self, s: np.ndarray):
        self.n = len(s)
        self.names: list[np.ndarray] = []
        distinct, named = np.unique(s, return_inverse=True)
        while len(distinct) < self.n:
            self.names.append(named.astype(np.int32))
            width = 1 << (len(self.names) - 1)
            after = np.zeros(self.n, np.int64)
            after[: self.n - width] = named[width:] + 1
            distinct, named = np.unique(named * np.int64(self.n + 1) + after, return_inverse=True)
        self.rank = named.astype(np.int64)  # of each suffix
        self.suffixes = np.empty(self.n, np.int64)
        self.suffixes[self.rank] = np.arange(self.n)

    def extension(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols from i and j (different places) on are equal; or from i and j backwards, themselves included."""
        i, j, n = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):  # no factor twice as long as the longest named ones occurs twice
            width, names = 1 << k, self.names[k]
            a, b = (i - width + 1, j - width + 1) if back else (i, j)
            step = np.where((a >= 0) & (b >= 0) & (a < self.n) & (b < self.n), width, 0)
            inside = np.flatnonzero(step)
            step[inside] *= names[a[inside]] == names[b[inside]]
            n += step
            i, j = (i - step, j - step) if back else (i + step, j + step)
        return n

    def equal(self, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether the factors of length m at i and j are equal."""
        out = i == j
        level = np.frexp(m.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            if k < len(self.names):
                own = np.flatnonzero((level == k) & (np.maximum(i, j) + m <= self.n))
                a, b, names, last = i[own], j[own], self.names[k], m[own] - (1 << k)
                out[own] |= (names[a] == names[b]) & (names[a + last] == names[b + last])
        return out

    def locus(self, at: np.ndarray, m: np.ndarray, last: bool = False) -> np.ndarray:
        """The first (or last) rank of the suffixes that begin with the factor of length m at `at`."""
        known, far = self.rank[at], np.full(len(at), self.n - 1 if last else 0)
        while (open_ := np.flatnonzero(known != far)).size:
            a, b = known[open_], far[open_]
            mid = (a + b + (b > a)) // 2  # towards the far end, so that a step always narrows the range
            same = self.equal(self.suffixes[mid], at[open_], m[open_])
            known[open_] = np.where(same, mid, a)
            far[open_] = np.where(same, b, mid + np.where(b > a, -1, 1))
        return known


def blocks(f: Factors) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin; each is the longest factor that began before, or one symbol."""
    order = f.suffixes.tolist()
    n = f.n
    before, after = [-1] * (n + 1), [-1] * (n + 1)  # neighbours in the suffix array among the places not yet taken out
    for a, b in zip(order, order[1:], strict=False):
        after[a], before[b] = b, a
    low, high = [-1] * n, [-1] * n
    for i in range(n - 1, -1, -1):  # what is left are the places before i
        low[i], high[i] = a, b = before[i], after[i]
        after[a], before[b] = b, a
    longest = np.zeros(n, np.int64)
    for near in (np.array(low), np.array(high)):
        has = np.flatnonzero(near >= 0)
        longest[has] = np.maximum(longest[has], f.extension(has, near[has]))
    out, at, step = [], 0, np.maximum(longest, 1).tolist()
    while at < n:
        out.append(at)
        at += step[at]
    return np.array(out)


def _counted(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i n[i] times i, and the numbers from 0 to n[i] - 1."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def covering_squares(f: Factors, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length of the half, and last start: squares whose walks to the right cover the leftmost occurrence of every square."""
    size = np.diff(np.append(edges, f.n))
    found = []
    of, k = _counted(size[:-1])  # centre in the block, right end in the next one
    h, k = edges[of + 1], k + 1
    on, back = f.extension(h, h - k), np.zeros(len(h), np.int64)
    inside = np.flatnonzero(h - k > 0)
    back[inside] = f.extension(h[inside] - 1, h[inside] - k[inside] - 1, True)
    ok = (on > 0) & (on + back >= k)
    found.append((np.maximum(h - k - back, h - 2 * k + 1)[ok], k[ok], (h + on - 2 * k)[ok]))
    of, k = _counted(size + np.append(size[1:], 0))  # start before the block, centre in it
    h, k, end = edges[of], k + 1, (edges + size)[of]
    ok = (h > 0) & (h + k < f.n)
    h, k, end = h[ok], k[ok], end[ok]
    on, back = f.extension(h, h + k), f.extension(h - 1, h + k - 1, True)
    start = np.maximum(h - back, h - k + 1)
    ok = (on > 0) & (back > 0) & (on + back >= k) & (start + k <= end)
    found.append((start[ok], k[ok], (h + on - k)[ok]))
    start, k, last = (np.concatenate(x) for x in zip(*found, strict=True))
    # one walk for those that begin alike
    order = np.lexsort((start, k))
    start, k, last = start[order], k[order], last[order]
    new = np.flatnonzero(np.concatenate(([True], (start[1:] != start[:-1]) | (k[1:] != k[:-1])))) if len(k) else np.zeros(0, np.int64)
    return start[new], k[new], last[new]


def primitive(f: Factors, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the half of each square isn't a repetition itself."""
    ok, left = np.ones(len(half), bool), half.copy()
    prime = 2
    while (left > 1).any():
        if prime * prime > left.max():  # what is left of each is a prime
            at = np.flatnonzero(left > 1)
            step = half[at] // left[at]
            left[at] = 1
        else:
            at = np.flatnonzero(left % prime == 0)
            step = half[at] // prime
            while (more := left % prime == 0).any():
                left[more] //= prime
            prime += 1 if prime == 2 else 2
        if len(at):
            ok[at] &= ~f.equal(start[at], start[at] + step, 2 * half[at] - step)
    return ok


def repetitions(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of two periods or more in s, a string whose last symbol occurs once."""
    f = Factors(s)
    start, half, last = covering_squares(f, blocks(f))
    own = primitive(f, start, half)
    of, step = _counted((last - start + 1)[own])
    at, half = start[own][of] + step, half[own][of]  # the walks
    low = f.locus(at, 2 * half)
    _, first = np.unique(low * np.int64(f.n + 1) + half, return_index=True)
    at, half, low = at[first], half[first], low[first]  # the vocabulary
    of, step = _counted(f.locus(at, 2 * half, True) - low + 1)
    at, half = f.suffixes[low[of] + step], half[of]  # its occurrences
    order = np.lexsort((at, half))
    at, half = at[order], half[order]
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (half[1:] != half[:-1])))[: len(at)]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return at[begin], at[end[: len(begin)]] - at[begin] + 2 * half[begin], half[begin]


def _stretches(ok: np.ndarray, part: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the stretches of LEAST_LENGTH words or more in which all places are ok; a place reaches `reach` words on."""
    if not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.concatenate(([True], (ok[1:] != ok[:-1]) | (part[1:] != part[:-1]), [True]))
    at = np.flatnonzero(edge)
    lo, n = at[:-1], np.diff(at) + reach - 1
    held = ok[lo] & (n >= LEAST_LENGTH)
    return lo[held], n[held]


def candidates(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the stretches that may hold a run; words are ints, of different texts different ones."""
    enough = np.bincount(words)[words] >= LEAST_EXPONENT if len(words) else np.zeros(0, bool)
    lo, n = _stretches(enough, text, 1)
    while True:
        of, step = _counted(n)
        at = lo[of] + step
        if not len(at):
            return lo, n
        _, x = np.unique(of * np.int64(len(words) + 1) + words[at], return_inverse=True)
        _, two = np.unique(x[:-1] * np.int64(len(x) + 1) + x[1:], return_inverse=True)
        _, three, often = np.unique(two[:-1] * np.int64(len(x) + 1) + x[2:], return_inverse=True, return_counts=True)
        begin, size = _stretches(often[three] >= LEAST_EXPONENT - 1, of[:-2], 3)
        if size.sum() == n.sum():
            return lo, n
        lo, n = at[begin], size


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """By text (its words) the runs of LEAST_EXPONENT periods and LEAST_LENGTH words or more, by start and period."""
    counts = np.array([len(x) for x in texts], np.int64)
    first = np.cumsum(counts) - counts
    words, known = np.empty(int(counts.sum()), np.int64), 0
    for k, own in enumerate(texts):
        ids: dict[bytes, int] = {}
        words[first[k] : first[k] + len(own)] = [ids.setdefault(w, len(ids)) for w in own]
        words[first[k] : first[k] + len(own)] += known
        known += len(ids)
    out: list[list[Run]] = [[] for _ in texts]
    lo, n = candidates(words, np.repeat(np.arange(len(texts)), counts))
    if not len(lo):
        return out
    of, step = _counted(n + 1)  # each stretch and a mark of its own
    mark = step == n[of]
    s = np.where(mark, known + of, words[np.minimum(lo[of] + step, len(words) - 1)])
    start, length, period = repetitions(s)
    held = (length >= LEAST_EXPONENT * period) & (length >= LEAST_LENGTH)
    start, length, period = start[held], length[held], period[held]
    at = lo[of[start]] + step[start]
    doc = np.searchsorted(first, at, "right") - 1
    for k, a, m, p in sorted(zip(doc.tolist(), (at - first[doc]).tolist(), length.tolist(), period.tolist(), strict=True), key=lambda x: (x[0], x[1], x[3])):
        out[k].append(Run(a, m, p))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for r in runs:
        keep[r.start + r.period : r.start + r.length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def best(runs: list[Run]) -> Run | None:
    """The run of most periods; of equals the first to start, then the shorter period."""
    return min(runs, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period), default=None)


def find_runs(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, the number of runs, the best of them, digests of all runs and of the text without repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            split = [x.split() for x in texts]  # at \x20 and \x09-\x0D
            rows = []
            for words, runs in zip(split, runs_of(split), strict=True):
                listed = hashlib.sha256("".join(f"{r.start},{r.length},{r.period}\n" for r in runs).encode()).hexdigest()
                kept = hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
                top = best(runs)
                told = (top.start, top.length, top.period, 1000 * top.length // top.period) if top else (None,) * 4
                rows.append((len(runs), *told, listed, kept))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], _NAMES)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, SCHEMA)


def collapse(docs: DataFrame) -> DataFrame:
    """docs with every run cut to its first period; a text that loses words has the others joined by one blank, all else stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            split = [x.split() for x in texts]
            at = part.schema.get_field_index("text")
            plain = part.column("text").to_pylist()
            cut = [b" ".join(collapsed(w, r)) if r else t for t, w, r in zip(plain, split, runs_of(split), strict=True)]
            yield part.set_column(at, "text", pa.array(cut, pa.binary()))

    binary = docs.withColumn("text", F.col("text").cast("binary"))
    return binary.mapInArrow(run, StructType(binary.schema.fields)).withColumn("text", F.col("text").cast(docs.schema["text"].dataType))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by a digest of the doc_id, end in a stretch that repeats (a test of find_runs at scale)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            out = []
            for doc, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                h = crc32(str(doc).encode())
                if doc is not None and h % 10 == 0 and (words := text.split()):
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))])
                out.append(text)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "text"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, "doc_id long, text binary")

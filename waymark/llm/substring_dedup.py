"""Substring dedup: matching statistics of documents against suffix automata of earlier text.

A window of `size` words whose words also start earlier (smaller doc_id, or earlier in the same document) is
removed.  One automaton of a whole corpus can't be held, and streaming every document past every shard grows
with the square of the corpus; so documents are routed to the shards of reference text that can match them,
by anchors.  Each window names the least of its 8-word hashes (its minimizer); equal windows name equal
anchors at equal places, and windows in a row that name one occurrence of an anchor form a piece.

1. Pieces meet by anchor, in order of document and place.  Of an anchor that occurs once nothing can repeat.
   A piece whose hash occurred before is routed to the document of its first occurrence; pieces of different
   hashes that share an anchor are routed to a shard of that anchor.
2. Every document's routed spans go to their shards as words.  A shard's reference text becomes a suffix
   automaton, and the spans stream past it in order, which gives the longest match that ends at each word;
   where that reaches `size`, the window is a repeat.  Hashes only route: no word goes without such a match.
3. The spans covered by repeats leave each document.

Copies within one chunk of a task are compared there word for word and not shuffled.  A document's copies
are dealt to shards of at most `fanout`, each with the reference text; a shard's reference is at most `block`
pieces of one document, or `hot` pieces of one anchor; an anchor with more different pieces is dealt by single
windows, so that no group is collected and no automaton grows with the corpus.

Defined results: null and empty texts, and texts shorter than a window, lose nothing; rows that share a
doc_id are ordered by hashes of their text (96 bits), and equal rows lose the same words; a null doc_id comes
before all others; an empty table gives an empty result; texts of any length are handled whole; other columns
are dropped by `remove_repeats` and kept, whatever their names, by `without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .wordbuf import BY_SPACE, Words, chunks, mix, runs

WINDOW, ANCHOR = 20, 8
HOT_PIECES, FANOUT, BLOCK = 512, 64, 4096
_NO_ID = -(1 << 63)
#: What a mark says of a piece: a copy found within its chunk; a copy, or a reference of copies; one of several
#: pieces of an anchor; a piece of a hot anchor.
SAME, REFERENCE, COPY, CHECK, HOT = range(5)
_ROW = ["did", "t", "u"]
_MARKS = "did long, t long, u int, q int, kind int, key long"
_SPANS = "did long, t long, u int, start int, n int"


class Pieces:
    """The pieces of a list of texts: text index, anchor place q, first window, number of windows, all in words."""

    def __init__(self, words: Words, size: int):
        self.hashes = words.hashes()
        grams = runs(self.hashes, ANCHOR) if len(words) >= size else np.zeros(0, np.uint64)
        width = size - ANCHOR + 1
        if len(grams) >= width:
            whole = np.flatnonzero(words.doc[: len(words) - size + 1] == words.doc[size - 1 :])
            q = sliding_window_view(grams, width).argmin(1)[whole] + whole
        else:
            whole = q = np.zeros(0, np.int64)
        new = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        self.q, self.start = q[new], whole[new]
        self.n = np.diff(np.concatenate((new, [len(q)])))
        self.doc = words.doc[self.start]
        self.anchor = grams[self.q].view(np.int64) if len(q) else np.zeros(0, np.int64)
        self.key = runs(self.hashes, self.n + size - 1, self.start).view(np.int64) if len(q) else np.zeros(0, np.int64)
        self.local = self.start - words.first[self.doc]
        self.place = self.q - words.first[self.doc]


def _ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _occurrences(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts, BY_SPACE)
            p = Pieces(words, size)
            did, t, u = (_ints(part.column(c))[p.doc] for c in _ROW)
            order = np.lexsort((p.place, u, t, did, p.key, p.anchor))
            a, c, did, t, u, q = (x[order] for x in (p.anchor, p.key, did, t, u, p.place))
            copy = np.zeros(len(a), bool)
            if len(a):
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
                begin = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
                start, n = p.start[order].tolist(), (p.n[order] + size - 1).tolist()
                for i in np.flatnonzero(~new & ((did != did[begin]) | (t != t[begin]) | (u != u[begin]) | (q != q[begin]))).tolist():
                    j = int(begin[i])
                    copy[i] = words.joined(start[i], n[i]) == words.joined(start[j], n[j])
                a[copy] = mix((did[:1] ^ t[:1]).view(np.uint64)).view(np.int64)[0]  # these meet no others: a task for each chunk
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, c, did, t, u.astype(np.int32), q.astype(np.int32), copy)], ["a", "c", *_ROW, "q", "copy"])

    return run


def _routed(hot: int, fanout: int, block: int):
    """Rows in order of anchor, piece, document and place: which pieces may repeat, and the shard that tells."""

    def shard(first: tuple, n: int) -> int:
        return hash((*first[:3], first[3] // block, n // fanout))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = piece = first = last = None
        waiting: list[tuple] = []
        many, copies = False, 0

        def close() -> list[tuple]:
            return [] if many or len(waiting) < 2 else [(*x, CHECK, anchor) for x in waiting]

        for batch in batches:
            copied = batch.column("copy")
            if copied.true_count:
                mine = batch.filter(copied)
                kind = pa.array(np.full(len(mine), SAME, np.int32))
                yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in (*_ROW, "q")), kind, mine.column("a")], [*_ROW, "q", "kind", "key"])
            rest = batch.filter(pa.array(~copied.to_numpy(zero_copy_only=False)))
            a, c = _ints(rest.column("a")), _ints(rest.column("c"))
            # rows of an anchor that occurs once are skipped without a loop, but for the batch's last anchor
            alone = np.ones(len(a), bool)
            if len(a):
                alone[1:] &= a[1:] != a[:-1]
                alone[:-1] &= a[1:] != a[:-1]
                alone[0] &= a[0] != anchor
                alone[-1] = False
            at = np.flatnonzero(~alone)
            out = []
            for x, k, *row in zip(a[at].tolist(), c[at].tolist(), *(_ints(rest.column(n))[at].tolist() for n in (*_ROW, "q")), strict=True):
                own = tuple(row)
                if x != anchor:
                    out += close()
                    anchor, piece, waiting, many = x, None, [], False
                if k == piece:
                    if own != last:
                        if copies % fanout == 0:
                            out.append((*first, REFERENCE, shard(first, copies)))
                        out.append((*own, COPY, shard(first, copies)))
                        copies, last = copies + 1, own
                    continue
                piece, first, last, copies = k, own, own, 0
                if many:
                    out.append((*own, HOT, x))
                    continue
                waiting.append(own)
                if len(waiting) > hot:
                    out += [(*w, HOT, x) for w in waiting]
                    waiting, many = [], True
            if out:
                yield _batch(out, _MARKS)
        if out := close():
            yield _batch(out, _MARKS)

    return run


_TEXTS = "key long, did long, t long, u int, start int, kind int, words binary"


def _texts(size: int):
    """The words of routed spans, by shard; of hot anchors window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts, BY_SPACE)
            p = Pieces(words, size)
            at = {x: i for i, x in enumerate(zip(p.doc.tolist(), p.place.tolist(), strict=True))}
            start, local, count = p.start.tolist(), p.local.tolist(), p.n.tolist()
            rows, hot, least = [], [], {}
            for k, (marks, *own) in enumerate(zip(part.column("marks").to_pylist(), *(part.column(c).to_pylist() for c in _ROW), strict=True)):
                spans = sorted((m["kind"], m["key"], at[k, m["q"]]) for m in marks if m["kind"] != SAME)
                begin = 0
                for j, (kind, key, i) in enumerate(spans):
                    if kind == HOT:
                        for w in range(start[i], start[i] + count[i]):
                            row, text = (*own, local[i] + w - start[i]), words.joined(w, size)
                            least[text] = min(least.get(text, row), row)
                            hot.append((w, row, text))
                    elif kind == CHECK or j + 1 == len(spans) or spans[j + 1] != (kind, key, i + 1):
                        first = i if kind == CHECK else spans[begin][2]
                        n = start[i] - start[first] + count[i] + size - 1
                        rows.append((key, *own, local[first], kind, words.joined(start[first], n)))
                    else:
                        continue
                    begin = j + 1
            keys = runs(p.hashes, size, np.array([w for w, _, _ in hot], np.int64)).view(np.int64).tolist()
            for key, (_, row, text) in zip(keys, hot, strict=True):  # of equal windows of a chunk only the first has need to meet others
                rows.append((key, *row, CHECK, text) if least[text] == row else (hash(row), *row, SAME, b""))
            yield _batch(rows, _TEXTS)

    return run


class SuffixAutomaton:
    """Suffix automaton of several word sequences; words are any hashable things."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, sequence: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in sequence:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            clone_only = q is not None
            if not clone_only:
                new = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
            p = last
            if not clone_only:
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                if p < 0:
                    last = new
                    continue
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                    last = new
                    continue
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = clone
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            if clone_only:
                last = clone
            else:
                link[new] = clone
                last = new

    def matches(self, sequence: list) -> list[int]:
        """Length of the longest match that ends at each place."""
        nxt, link, length = self.next, self.link, self.length
        v, n, out = 0, 0, []
        for w in sequence:
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(w)
            v, n = (0, 0) if to is None else (to, n + 1)
            out.append(n)
        return out


def _compared(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, last = SuffixAutomaton(), None, None
        for batch in batches:
            out: list[tuple] = []
            for key, did, t, u, start, kind, text in zip(*(batch.column(n).to_pylist() for n in ("key", *_ROW, "start", "kind", "words")), strict=True):
                if last == (last := (key, did, t, u, start, kind)):  # a repeated row is no repeat of itself
                    continue
                if kind == SAME:
                    out.append((did, t, u, start, 1))
                    continue
                if key != now:
                    automaton, now = SuffixAutomaton(), key
                words, found = text.split(b" "), 0
                if kind != REFERENCE:
                    begin = None
                    for i, n in enumerate((*automaton.matches(words), 0)):
                        if n >= size:
                            begin = i if begin is None else begin
                        elif begin is not None:
                            out.append((did, t, u, start + begin - size + 1, i - begin))
                            found, begin = found + i - begin, None
                if kind != COPY and found < len(words) - size + 1:
                    automaton.add(words)
            yield _batch(out, _SPANS)

    return run


def _kept(size: int, carried: bool):
    names = [*_ROW, "n_words", "n_removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts, BY_SPACE)
            marks, spans = part.column("marks").to_pylist(), part.column("spans").to_pylist()
            step = np.zeros(len(words) + size + 1, np.int64)
            same = [(k, m["q"]) for k, found in enumerate(marks) for m in found or () if m["kind"] == SAME]
            if same:
                p = Pieces(words, size)
                wanted = np.zeros(len(words), bool)
                k, q = (np.array(x) for x in zip(*same, strict=True))
                wanted[q + words.first[k]] = True
                mine = np.flatnonzero(wanted[p.q])
                np.add.at(step, p.start[mine], 1)
                np.add.at(step, p.start[mine] + p.n[mine] + size - 1, -1)
            for k, found in enumerate(spans):
                for s in found or ():
                    step[words.first[k] + s["start"]] += 1
                    step[words.first[k] + s["start"] + s["n"] + size - 1] -= 1
            gone = np.cumsum(step)[: len(words)] > 0
            removed = np.bincount(words.doc[gone], minlength=len(texts))
            starts, ends, kept = words.starts.tolist(), words.ends.tolist(), []
            for k in range(len(texts)):
                lo, n = int(words.first[k]), int(words.counts[k])
                if not removed[k]:
                    kept.append(words.joined(lo, n) if n else b"")
                else:
                    left = np.flatnonzero(~gone[lo : lo + n]) + lo
                    kept.append(b" ".join([words.data[starts[i] : ends[i]] for i in left.tolist()]))
            made = [*(part.column(c) for c in _ROW), pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary())]
            if carried:
                made += [part.column("text"), part.column("rest")]
            yield pa.RecordBatch.from_arrays(made, [*names, "text", "rest"] if carried else names)

    return run


def _removed(docs: DataFrame, rest: Column | None, size: int, hot: int, fanout: int, block: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("t"), F.hash(text).alias("u"), text.alias("text")]
    base = docs.select(*own, *([] if rest is None else [rest.alias("rest")]))
    found = base.select(*_ROW, "text").mapInArrow(_occurrences(size), "a long, c long, did long, t long, u int, q int, copy boolean")
    routed = found.repartition("a").sortWithinPartitions("a", "c", *_ROW, "q").mapInArrow(_routed(hot, fanout, block), _MARKS)
    marks = routed.groupBy(*_ROW).agg(F.collect_set(F.struct("q", "kind", "key")).alias("marks"))
    asked = base.join(marks.where(F.exists("marks", lambda m: m["kind"] != SAME)), _ROW)
    texts = asked.mapInArrow(_texts(size), _TEXTS)
    matched = texts.repartition("key").sortWithinPartitions("key", *_ROW, "start", "kind").mapInArrow(_compared(size), _SPANS)
    spans = matched.groupBy(*_ROW).agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    gone = marks.select(*_ROW, F.filter("marks", lambda m: m["kind"] == SAME).alias("marks")).join(spans, _ROW, "left")
    schema = _parse_datatype_string("did long, t long, u int, n_words long, n_removed long, kept binary" + (", text binary" if rest is not None else ""))
    if rest is not None:
        schema = StructType([*schema.fields, StructField("rest", base.schema["rest"].dataType)])
    return base.join(gone, _ROW, "left").mapInArrow(_kept(size, rest is not None), schema)


def remove_repeats(docs: DataFrame, size: int = WINDOW, hot: int = HOT_PIECES, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one blank, as bytes) for every row."""
    out = _removed(docs, None, size, hot, fanout, block)
    return out.select(F.when(F.col("did") != _NO_ID, F.col("did")).alias("doc_id"), "n_words", "n_removed", "kept")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, size: int = WINDOW, hot: int = HOT_PIECES, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """docs with the repeats taken out of the texts; a text that loses nothing stays as it is, n_chars follows the text."""
    names = [c for c in docs.columns if c != "text"]
    rest = F.struct(F.col("text").isNull().alias("c0"), *[docs[c].alias(f"c{i + 1}") for i, c in enumerate(names)])
    out = _removed(docs, rest, size, hot, fanout, block)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).when(~F.col("rest.c0"), F.col("text")).cast(docs.schema["text"].dataType)
    made = {c: F.col(f"rest.c{i + 1}") for i, c in enumerate(names)} | {"text": text}
    if "n_chars" in names:
        made["n_chars"] = F.when(cut, F.length(F.col("kept").cast("string")).cast(docs.schema["n_chars"].dataType)).otherwise(made["n_chars"])
    return out.select(*[made[c].alias(c) for c in docs.columns])

"""Benchmark decontamination: a broadcast hash set of n-gram windows of the benchmark, scanned over all documents.

A window is `n` consecutive words of a lower-cased benchmark text; a shorter text is one window.  Documents
stream through numpy kernels: every word window of each occurring length is hashed and looked up in a bit
table, each hit is verified on its words, and all words of a verified occurrence are hit.  Benchmark texts
are broadcast up to `block_bytes`, and the documents are scanned once.  Of a larger benchmark all tasks get a
bit table of fixed size first; the windows it lets pass, told apart, meet the benchmark's in a join on their
words.  Windows that occur in both are broadcast, up to the same size, and a second scan finds them; no text is
shuffled.  Only where more of them occur than may be broadcast are they joined to the rows that have hits.

Defined results: null and empty texts have no words, no hits and are not contaminated; null item ids are
skipped with their texts; items of equal text are all reported; repeated rows give a row each with equal
results; empty tables give an empty result or no hits; documents of any length are scanned whole; other
columns are dropped by `scan` and kept, whatever their names, by `decontaminate` and `remove_spans`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import fresh, materialize, text_key
from .wordbuf import BY_ALNUM_LOWER, Words, chunks, mix, runs

WINDOW = 13
#: UTF-8 bytes of benchmark text that are broadcast at once; a worker's window set takes about 50 times as much.
BLOCK_BYTES = 4 << 20
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SPANS = "array<struct<start:int,end:int>>"
#: Tasks that the rows of one text are dealt over where hits are joined to rows.
FANOUT = 16
#: Size of the bit table of a benchmark too large to broadcast: 16 MB.
TABLE_BITS = 27


class WindowSet:
    """The windows of one block: by length a table of hash bits, and by its words the items that have a window."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.items: dict[bytes, tuple[str, ...] | list[str]] = {}
        hashes = defaultdict(list)
        words = Words([t for _, t in items], BY_ALNUM_LOWER)
        all_hashes = words.hashes()
        for k, (item, _) in enumerate(items):
            lo, count = int(words.first[k]), int(words.counts[k])
            if count:
                size, own = min(n, count), (item,)  # one tuple for all windows that only this item has
                for i in range(lo, lo + count - size + 1):
                    window = words.joined(i, size)
                    known = self.items.setdefault(window, own)
                    if known is not own and known[-1] != item:  # items come one after the other
                        if isinstance(known, tuple):
                            known = self.items[window] = list(known)
                        known.append(item)
                hashes[size].append(runs(all_hashes[lo : lo + count], size))
        self._lay_out(hashes)

    @classmethod
    def of_windows(cls, windows: list[tuple[bytes, list[str]]]) -> WindowSet:
        """From windows (their words joined by blanks) and the items of each."""
        made = cls([], 1)
        made.items = {window: items for window, items in windows}
        words = Words([w for w, _ in windows], BY_ALNUM_LOWER)
        all_hashes, hashes = words.hashes(), defaultdict(list)
        for size in np.unique(words.counts).tolist():
            own = words.first[:-1][words.counts == size]
            hashes[size].append(runs(all_hashes, np.full(len(own), size), own))
        made._lay_out(hashes)
        return made

    def _lay_out(self, hashes: dict[int, list[np.ndarray]]) -> None:
        self.tables = {}
        for size, found in hashes.items():
            every = np.concatenate(found)
            shift = np.uint64(64 - max(20, (16 * len(every)).bit_length()))  # at most one place in 16 is set
            table = np.zeros(1 << (64 - int(shift)), bool)
            table[every >> shift] = True
            self.tables[size] = table, shift

    def hits(self, words: Words) -> dict[int, tuple[list[list[int]], set[str]]]:
        """By text: united spans of hit words, and the items."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        hashes = words.hashes()
        for size, (table, shift) in self.tables.items():
            if len(words) < size:
                continue
            at = np.flatnonzero(table[runs(hashes, size) >> shift])
            at = at[words.doc[at] == words.doc[at + size - 1]]
            for i in at.tolist():
                if known := self.items.get(words.joined(i, size)):
                    doc = int(words.doc[i])
                    found[doc].append((i - int(words.first[doc]), i - int(words.first[doc]) + size))
                    items[doc].update(known)
        return {doc: (unite(spans), items[doc]) for doc, spans in found.items()}


def unite(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.selectExpr("cast(item_id as string) item_id", "cast(text as string) text").where("item_id is not null and text is not null")


def _windows(n: int):
    """Every window of every item: its number of words, its place in the bit table, its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts, BY_ALNUM_LOWER)
            hashes, rows = words.hashes(), []
            for k, item in enumerate(part.column("item_id").to_pylist()):
                lo, count = int(words.first[k]), int(words.counts[k])
                if count:
                    size = min(n, count)
                    places = _places(runs(hashes[lo : lo + count], size), size)
                    rows += [(item, size, place, words.joined(lo + i, size)) for i, place in enumerate(places.tolist())]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["item_id", "size", "place", "words"])

    return run


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    return (mix(hashes + np.uint64(size)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


_held: dict[str, WindowSet] = {}  # of one benchmark, by a worker


def _window_set(key: str, block: Broadcast, n: int) -> WindowSet:
    if key not in _held:
        _held.clear()
        _held[key] = WindowSet(block.value, n) if n else WindowSet.of_windows(block.value)
    return _held[key]


def _bit_table(windows: DataFrame) -> np.ndarray:
    """The places of all windows as bits; Spark packs them, 16 KB a row."""

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 17, bool)
        bits[rows["bit"].to_numpy()] = True
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    places = windows.select(F.shiftright("place", 17).cast("int").alias("part"), (F.col("place") % (1 << 17)).cast("int").alias("bit")).distinct()
    table = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for row in places.groupBy("part").applyInPandas(packed, "part int, bits binary").collect():  # 16 MB at most
        table[row["part"] << 14 : (row["part"] + 1) << 14] = np.frombuffer(row["bits"], np.uint8)
    return table


def _candidates(docs: DataFrame, windows: DataFrame, columns: str) -> DataFrame:
    """Windows of documents whose bit is set: size and words, and if asked for the text's key and where it starts."""
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # n of them at most
    bits = docs.sparkSession.sparkContext.broadcast(_bit_table(windows))
    placed = "text_key" in columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            words = Words(texts, BY_ALNUM_LOWER)
            hashes, rows, keys = words.hashes(), [], {}
            for size in sizes:
                if len(words) < size:
                    continue
                place = _places(runs(hashes, size), size)
                at = np.flatnonzero(bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                at = at[words.doc[at] == words.doc[at + size - 1]].tolist()
                if not placed:
                    rows += [(size, w) for w in {words.joined(i, size) for i in at}]
                    continue
                for i in at:
                    doc = int(words.doc[i])
                    key = keys.get(doc) or keys.setdefault(doc, hashlib.md5(texts[doc]).hexdigest())
                    rows.append((size, words.joined(i, size), key, i - int(words.first[doc])))
            names = [x.split()[0] for x in columns.split(", ")]
            values = zip(*rows, strict=True) if rows else [()] * len(names)
            types = (pa.int32(), pa.binary(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(values, types[: len(names)], strict=True)], names)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, columns)


def _joined(out: DataFrame, docs: DataFrame, windows: DataFrame, names: list[str]) -> DataFrame:
    """out (docs and names) with the hits of more windows than may be broadcast: joined to the rows by digests of their texts, dealt over FANOUT tasks each."""
    met = _candidates(docs, windows, "size int, words binary, text_key string, start int").distinct()
    hits = met.join(windows, ["size", "words"]).select("text_key", "item_id", F.struct("start", (F.col("start") + F.col("size")).alias("end")).alias("span"))
    grouped = hits.groupBy("text_key").agg(F.array_sort(F.collect_set("span")).alias("every"), F.array_sort(F.collect_set("item_id")).alias("ids"))
    last, init = lambda got: F.element_at(got, -1), lambda got: F.slice(got, 1, F.size(got) - 1)
    longer = lambda got, s: F.struct(last(got)["start"].alias("start"), F.greatest(last(got)["end"], s["end"]).alias("end"))
    grow = lambda got, s: (
        F.when(F.size(got) == 0, F.array(s)).when(s["start"] <= last(got)["end"], F.concat(init(got), F.array(longer(got, s)))).otherwise(F.concat(got, F.array(s)))
    )
    key, slot, found, ids = fresh(out, "text_key", "slot", "found_spans", "found_ids")
    spans = F.aggregate("every", F.expr(f"cast(array() as {SPANS})"), grow)
    each = grouped.select(F.col("text_key").alias(key), spans.alias(found), F.col("ids").alias(ids))
    each = each.withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(FANOUT - 1))))
    wordy = F.col(names[0]) > 0  # the others can't have a hit
    dealt = out.where(wordy).withColumn(key, text_key(F.col("text"))).withColumn(slot, (F.rand(7) * FANOUT).cast("int"))
    some = dealt.join(each, [key, slot], "left").withColumns({names[1]: F.coalesce(found, names[1]), names[2]: F.coalesce(ids, names[2])})
    return some.select(*out.columns).union(out.where(~wordy))


def annotate(docs: DataFrame, benchmark: DataFrame, names: list[str], n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with three more columns, called names: n_words, the united spans of hit words, the item ids."""
    items = _items(benchmark)
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + 64)).first()[0] or 0
    (text,) = fresh(docs, "text_bytes")
    of, many, windows = n, False, None
    if size <= block_bytes:
        held = [(r[0], r[1].encode()) for r in items.collect()]
    else:
        windows = materialize(items.selectExpr("item_id", "cast(text as binary) text").mapInArrow(_windows(n), "item_id string, size int, place long, words binary").distinct())
        both = materialize(windows.join(_candidates(docs, windows, "size int, words binary").distinct(), ["size", "words"], "left_semi"))
        many = (both.agg(F.sum(F.octet_length("words") + F.octet_length("item_id") + 64)).first()[0] or 0) > block_bytes
        held = [] if many else [(bytes(r[0]), r[1]) for r in both.groupBy("words").agg(F.array_sort(F.collect_set("item_id"))).collect()]
        of = 0
    block, held_as = docs.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _window_set(held_as, block, of)
        for part, texts in chunks(batches, text):
            words = Words(texts, BY_ALNUM_LOWER)
            hits = found.hits(words)
            spans = [[{"start": a, "end": b} for a, b in hits[k][0]] if k in hits else [] for k in range(len(texts))]
            ids = [sorted(hits[k][1]) if k in hits else [] for k in range(len(texts))]
            made = [pa.array(words.counts.astype(np.int64)), pa.array(spans, _SPANS), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], *names])

    added = _parse_datatype_string(f"n_words long, spans {SPANS}, item_ids array<string>").fields
    schema = StructType([*docs.schema.fields, *[StructField(name, f.dataType) for name, f in zip(names, added, strict=True)]])
    out = docs.withColumn(text, F.col("text").cast("binary")).mapInArrow(run, schema)
    return _joined(out, docs, windows, names) if many else out


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row of docs: doc_id, n_words, the united spans of hit words and the item ids."""
    base = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return annotate(base, benchmark, ["n_words", "spans", "item_ids"], n, block_bytes).drop("text")


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def is_contaminated(hit: Column, words: Column) -> Column:
    return (hit > 0) & (20 * hit >= words)


def report(found: DataFrame) -> DataFrame:
    """The counts and digests of a scan."""
    found = found.withColumn("n_hit", n_hit(F.col("spans")))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose text is contaminated; all columns stay."""
    words, spans, ids = names = fresh(docs, "n_words", "spans", "item_ids")
    return annotate(docs, benchmark, names, n, block_bytes).where(~is_contaminated(n_hit(F.col(spans)), F.col(words))).drop(*names)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with every span of hit words cut from the texts, from its first word to its last; all else stays."""
    names, columns = fresh(docs, "n_words", "spans", "item_ids"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts, BY_ALNUM_LOWER)
            offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
            out = []
            for k, (text, spans) in enumerate(zip(part.column("text").to_pylist(), part.column(names[1]).to_pylist(), strict=True)):
                for s in reversed(spans):  # offsets before a cut stay true
                    lo = int(words.starts[words.first[k] + s["start"]] - offset[k])
                    hi = int(words.ends[words.first[k] + s["end"] - 1] - offset[k])
                    text = text[:lo] + text[hi:]
                out.append(text)
            at = part.schema.get_field_index("text")
            yield part.set_column(at, "text", pa.array(out, pa.binary())).select(columns)

    binary = annotate(docs, benchmark, names, n, block_bytes).withColumn("text", F.col("text").cast("binary"))
    cut = binary.mapInArrow(run, StructType(binary.schema.fields[: len(docs.columns)]))
    return cut.withColumn("text", F.col("text").cast(docs.schema["text"].dataType))

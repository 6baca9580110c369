"""Best-fit packing with conflicts.

Documents are dealt to shards by a hash of all that packing knows of them (rows that agree in it are counted
and dealt one by one), so that every shard has its part of a hot source, id or cluster.  The number of shards
follows the number of documents: best fit is a sequence, which one task must run; with `shard_docs` as large
as the table it is one shard, and the fit is best over the whole table.  Within a shard the pieces go, longest first, into bins:
bins are ordered by what room is left, and the search starts at the first bin with room enough and goes on
to its successors until one is compatible, which is then the tightest compatible bin; if none is, a bin is
opened.  A bin carries two bitmaps: one of duplicate clusters, of which it takes one document each, and one
of source slots, of which each source has `source_slots`.  A document longer than a bin is cut in pieces of
a whole bin; its rest is packed like any other piece.

Defined results: null and empty texts have no words and are placed with no length (bin of any room); a null
source is a source; a null cluster conflicts with none; repeated rows give a row each (equal texts are one
cluster, so they go to different bins); an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize
from .quality_rules import words_of

CAPACITY, SOURCE_SLOTS, SHARD_DOCS = 4096, 4, 4000
#: Equal rows that one row is unfolded to at once.
EQUAL_ROWS = 100_000
PACKED_SCHEMA = "doc_id long, piece int, n_words long, shard int, bin int, source_slot int"


class Shard:
    """The bins of one shard."""

    def __init__(self, capacity: int, slots: int):
        self.capacity, self.slots = capacity, slots
        self.room: list[tuple[int, int]] = []  # (room left, bin), in order
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.source_no: dict[str | None, int] = {}
        self.cluster_no: dict[int, int] = {}

    def place(self, n: int, source: str | None, cluster: int | None) -> tuple[int, int]:
        first = self.source_no.setdefault(source, len(self.source_no)) * self.slots
        own = ((1 << self.slots) - 1) << first
        bit = 0 if cluster is None else 1 << self.cluster_no.setdefault(cluster, len(self.cluster_no))
        at = bisect_left(self.room, (n, -1))
        while at < len(self.room):
            b = self.room[at][1]
            if not self.clusters[b] & bit and self.sources[b] & own != own:
                break
            at += 1
        if at < len(self.room):
            left, b = self.room.pop(at)
        else:
            left, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        taken = (self.sources[b] & own) >> first
        slot = (~taken & (taken + 1)).bit_length() - 1
        self.sources[b] |= 1 << (first + slot)
        self.clusters[b] |= bit
        insort(self.room, (left - n, b))
        return b, slot


def content_key(words: Column) -> Column:
    """Equal for texts of equal words, case and white space aside."""
    return F.xxhash64(F.lower(F.array_join(words, " ")))


def measured(docs: DataFrame, cluster: str | None = None) -> DataFrame:
    """doc_id, source, n (words) and cluster for every row; without a cluster column texts of equal words are a cluster."""
    own = let(words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), F.when(F.size(ws) > 0, content_key(ws)).alias("key")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), own.alias("m"), *([F.col(cluster).cast("long").alias("c")] if cluster else []))
    return rows.select("doc_id", "source", "m.n", (F.col("c") if cluster else F.col("m.key")).alias("cluster"))


def pack(docs: DataFrame, capacity: int = CAPACITY, source_slots: int = SOURCE_SLOTS, shard_docs: int = SHARD_DOCS, cluster: str | None = None, linked: DataFrame | None = None) -> DataFrame:
    """doc_id, piece, n_words, shard, bin, source_slot: where every piece of every row of docs goes.

    cluster names a long column of duplicate clusters; without one, texts of equal words are a cluster.
    linked (id, root) names clusters that count as one.
    """
    rows = materialize(measured(docs, cluster).groupBy("doc_id", "source", "n", "cluster").agg(F.count("*").alias("rows")))
    if linked is not None:
        rows = rows.join(linked, rows["cluster"] == linked["id"], "left").withColumn("cluster", F.coalesce("root", "cluster")).drop("id", "root")
    shards = max(1, -(-(rows.agg(F.sum("rows")).first()[0] or 0) // shard_docs))
    # equal rows are counted first and then dealt one by one, so neither they nor a hot source or cluster fill a shard
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / EQUAL_ROWS))).alias("block"))
    last = F.least(F.col("rows"), (F.col("block") + 1) * EQUAL_ROWS) - 1
    single = blocks.select("doc_id", "source", "n", "cluster", F.explode(F.sequence(F.col("block") * EQUAL_ROWS, last)).alias("copy"))
    whole = F.floor(F.col("n") / capacity).cast("int")
    left = F.col("n") % capacity
    lengths = F.concat(F.array_repeat(F.lit(capacity).cast("long"), whole), F.when((left > 0) | (F.col("n") == 0), F.array(left)).otherwise(F.expr("cast(array() as array<bigint>)")))
    shard = F.pmod(F.xxhash64("doc_id", "source", "n", "cluster", "copy"), F.lit(shards)).cast("int")
    pieces = single.select("doc_id", "source", "cluster", shard.alias("shard"), F.posexplode(lengths).alias("piece", "n_words"))
    ordered = pieces.repartition("shard").sortWithinPartitions("shard", F.desc("n_words"), "doc_id", "piece", "source", "cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for batch in batches:
            placed = []
            for shard, n, source, own in zip(*(batch.column(k).to_pylist() for k in ("shard", "n_words", "source", "cluster")), strict=True):
                if shard != now:
                    now, bins = shard, Shard(capacity, source_slots)
                placed.append(bins.place(n, source, own))
            b, slot = zip(*placed, strict=True) if placed else ((), ())
            made = [batch.column(c) for c in ("doc_id", "piece", "n_words", "shard")] + [pa.array(b, pa.int32()), pa.array(slot, pa.int32())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "n_words", "shard", "bin", "source_slot"])

    return ordered.mapInArrow(run, PACKED_SCHEMA)

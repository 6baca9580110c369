"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint is the bitwise majority over hashes of its word shingles, in lanes of 64 bits: the
first lane counts the shingles' XXH64, each further lane a mix of it.  Fingerprints are cut in segments.
Every fingerprint enters its segments in a table, looks up the small Hamming ball round each of them, and
the complete distance of what it meets is verified; of two segments at an odd distance only the one of
even parity looks.  Documents of one fingerprint (or one shingle set) are folded first, so copies never
make pairs.  Links become groups by star contraction (components.py).

Two uses.  `near_duplicates` takes one lane and says which fingerprints lie within `max_bits`, all of them:
with two segments one lies within max_bits // 2.  `similar` finds all pairs of texts whose shingle sets have
Jaccard similarity 4/5 or more.  There about 15 of 100 bits differ, so fingerprints alone can't tell: they
join the dense groups first (eight lanes with two segments of 20 bits each, every text to the most met
fingerprint of its segments, verified on the complete sets), and an exact prefix filter finds what is left: read in one order,
two sets of similarity 4/5 share a shingle among their first n // 5 + 1.  Pairs within a group that is joined
already are not looked at, and every pair is verified on its complete sets.  The order doesn't matter for
exactness; the shingles that most texts hold, by counts over all texts, come last, so hot ones are met only by texts
made of little else.

Defined results: null and empty texts have fingerprint zero and the empty set and link like any other (for
`similar` they are copies of each other); texts of fewer words than a shingle are one shingle; repeated rows
give a row each; an empty table gives an empty result; rows with a null doc_id keep their group but never
name it (null if they are alone); texts are hashed whole; other columns are dropped by `near_duplicates`
and `similar`, and kept, whatever their names, by `deduplicate`, which keeps exactly one row of a group:
that of the least doc_id (null last), of equal ids the least digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, materialize, skew_join, small, text_key
from .components import components
from .wordbuf import BY_SPACE_LOWER, Words, chunks, mix, texts_of

_SET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
#: What `similar` takes: words of a shingle, lanes of 64 bits, segments a lane, bits of a segment.
SHINGLE, LANES, PER_LANE, WIDTH = 5, 8, 2, 20
#: Shingles named as common at most (they only order the others), and how many texts must hold them.
MAX_COMMON, OFTEN = 300_000, 3
#: Shingles are counted in 2 ** COUNT_BITS ranges of their hash; a task sorts this many at once before it sends them.
COUNT_BITS, COUNTED_AT_ONCE = 10, 1 << 21
#: Shingle sets that a task remembers while it compares texts, and the bytes of a text from which on it doesn't.
REMEMBERED_SETS, REMEMBERED_BYTES = 1000, 1 << 16


def shingles_of(texts: list[bytes], size: int, seed: int) -> list[np.ndarray]:
    """The XXH64 of every shingle of every text, repeats included."""
    words = Words(texts, BY_SPACE_LOWER)
    data = b" ".join(words.data.split())
    lengths = words.ends - words.starts
    ends = np.cumsum(lengths + 1) - 1
    starts, stops, digest = (ends - lengths).tolist(), ends.tolist(), xxhash.xxh64_digest
    out = []
    for lo, n in zip(words.first.tolist(), words.counts.tolist(), strict=False):
        last = lo + max(n - size, 0)
        spans = zip(starts[lo : last + 1], stops[min(lo + size, lo + n) - 1 : lo + n], strict=True) if n else ()
        out.append(np.frombuffer(b"".join([digest(data[i:j], seed) for i, j in spans]), ">u8").astype(np.uint64))
    return out


def majority(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """The fingerprint of one text: `lanes` longs."""
    if not len(hashes):
        return np.zeros(lanes, np.int64)
    every = np.empty((len(hashes), lanes), ">u8")
    for k in range(lanes):
        every[:, k] = mix(hashes + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if k else hashes
    at = every.view(np.uint8).reshape(len(hashes), 8 * lanes) + np.arange(8 * lanes) * 256
    counts = np.bincount(at.ravel(), minlength=2048 * lanes).reshape(8 * lanes, 256) @ _SET_BITS
    return np.packbits(2 * counts > len(hashes)).view(">u8").astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            fps = np.array([majority(h)[0] for h in shingles_of(texts, size, seed)], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, "doc_id long, fp long")


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in values]).cast("array<long>")


def segments(lane: Column, count: int, width: int) -> list[Column]:
    """The first `count` segments of `width` bits of a lane, lowest bits first."""
    return [F.shiftrightunsigned(lane, s * width).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for s in range(count)]


def _table(rows: DataFrame, pieces: list[Column]) -> DataFrame:
    """Every row at its segments: s (number) and v (value)."""
    return rows.select("*", F.posexplode(F.array(*pieces)).alias("s", "v"))


def _lookups(rows: DataFrame, pieces: list[Column], width: int, radius: int) -> DataFrame:
    """Every row at all it looks up: the segments in the balls of its own, at an odd distance only from even parity."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    even, odd = ([m for m in masks if m.bit_count() % 2 == k] for k in (0, 1))

    def ball(value: Column) -> Column:
        found = F.transform(_longs(even), lambda m: value.bitwiseXOR(m))
        if not odd:
            return found
        more = F.transform(_longs(odd), lambda m: value.bitwiseXOR(m))
        return F.when(F.bit_count(value) % 2 == 0, F.concat(found, more)).otherwise(found)

    looks = rows.select("*", F.posexplode(F.array(*[F.struct(p.alias("own"), ball(p).alias("vs")) for p in pieces])).alias("s", "k"))
    return looks.select(*rows.columns, "s", "k.own", F.explode("k.vs").alias("v"))


def _same_parity(own: str, other: str) -> Column:
    return F.bit_count(F.col(own).bitwiseXOR(F.col(other))) % 2 == 0


def links(fps: DataFrame, max_bits: int = 3, count: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints in column fp that differ in at most max_bits bits."""
    width, radius = 64 // count, max_bits // count
    pieces = segments(F.col("fp"), count, width)
    table = _table(fps.select("fp"), pieces).withColumnRenamed("fp", "t")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("t"))) <= max_bits
    once = ~_same_parity("own", "v") | (F.col("fp") < F.col("t"))
    pairs = _lookups(fps.select("fp"), pieces, width, radius).join(table.hint("merge"), ["s", "v"]).where(near & (F.col("fp") != F.col("t")) & once)
    return pairs.select(F.greatest("fp", "t").alias("a"), F.least("fp", "t").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42, max_bits: int = 3, count: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach) for every row."""
    fps = materialize(fingerprints(docs, size, seed))
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes.select("fp"), max_bits, count))
    rooted = roots.join(classes, roots["id"] == classes["fp"]).select("fp", "root", "first_id")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("least"))
    members = rooted.join(named, "root").select(F.col("fp").alias("linked"), "least")
    labels = classes.join(members, classes["fp"] == F.col("linked"), "left").select("fp", F.coalesce("least", "first_id").alias("component_id"))
    return skew_join(fps, labels, "fp").select("doc_id", "fp", "component_id")


def clustered(docs: DataFrame, name: str, size: int = 3, seed: int = 42, max_bits: int = 3, count: int = 2) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, text and the fingerprint, called name (null without words); and the groups of fingerprints that links join, as (id, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            found = shingles_of(texts, size, seed)
            fps = pa.array([int(majority(h)[0]) if len(h) else None for h in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, fps], ["doc_id", "source", "text", name])

    base = docs.selectExpr("cast(doc_id as long) doc_id", "cast(source as string) source", "cast(text as binary) text")
    fps = fingerprints(docs, size, seed).select("fp").distinct()
    return base.mapInArrow(run, f"doc_id long, source string, text binary, `{name}` long"), components(links(materialize(fps), max_bits, count))


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- texts of similarity 4/5 or more ---


def _sets(texts: list[bytes], size: int, seed: int) -> list[np.ndarray]:
    return [np.unique(h) for h in shingles_of(texts, size, seed)]


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """512 bits: for each value of the hashes' top 9 bits, whether an odd number of shingles has it."""
    odd = np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def common_shingles(docs: DataFrame, size: int, seed: int) -> np.ndarray:
    """The shingles that most texts hold, rarest first: counted over all distinct texts, in OFTEN of them at least, MAX_COMMON at most.

    Every text is counted, copies once.  Tasks sort and count what they hold in numpy and send it by ranges of the
    hash, as arrays, so that a shingle takes about its eight bytes of shuffle.  Where more than MAX_COMMON are held
    OFTEN, the least count that lets no more through decides; shingles of one count stay or go together.
    """

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held), return_counts=True)
        parts, starts = np.unique(h >> np.uint64(64 - COUNT_BITS), return_index=True)
        offsets = pa.array(np.append(starts, len(h)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h.view(np.int64), c.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), *lists], ["part", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, texts in chunks(batches):
            held += (sets := _sets(texts, size, seed))
            n += sum(map(len, sets))
            if n >= COUNTED_AT_ONCE:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    def summed(pieces: pa.Table) -> pa.Table:
        h, at = np.unique(pc.list_flatten(pieces["h"]).to_numpy(), return_inverse=True)
        c = np.bincount(at, pc.list_flatten(pieces["c"]).to_numpy()).astype(np.int64)
        return pa.table({"h": h[c >= OFTEN], "c": c[c >= OFTEN]})

    copied = docs.groupBy(text_key(F.col("text")).alias("copied")).count().where("count > 1").select("copied")
    keyed = docs.select(F.col("text").cast("binary").alias("text"), text_key(F.col("text")).alias("key"))
    marked = keyed.join(small(materialize(copied)), F.col("key") == F.col("copied"), "left")
    texts = marked.where("copied is null").union(marked.where("copied is not null").dropDuplicates(["copied"])).select("text")
    pieces = texts.mapInArrow(run, "part int, h array<long>, c array<int>")
    counts = materialize(pieces.groupBy("part").applyInArrow(summed, "h long, c long"))
    least, named = OFTEN, 0
    for c, n in sorted(map(tuple, counts.groupBy("c").count().collect()), reverse=True):  # as many rows as counts differ
        if (named := named + n) > MAX_COMMON:
            least = c + 1
            break
    found = counts.where(F.col("c") >= least).toPandas()
    forget(counts)
    return found["h"].to_numpy(np.int64)[np.lexsort((found["h"], found["c"]))].view(np.uint64).copy()


def _prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The first n // 5 + 1 shingles: those that aren't common by their hash, then the common ones by rank; and how many are common."""
    n = len(hashes) // 5 + 1
    at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
    known = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
    rare = hashes[~known]
    if len(rare) >= n:
        return rare[:n], 0
    return np.concatenate((rare, hashes[known][np.argsort(rank[at[known]])]))[:n], min(n, len(hashes)) - len(rare)


def described(docs: DataFrame, size: int = SHINGLE, seed: int = 42) -> DataFrame:
    """For every row doc_id, text_key, the 128-bit name of its shingle set (v, w), its size n, fingerprint fp, parity sketch and prefix, and how many of the prefix are common."""
    names = ["doc_id", "text_key", "v", "w", "n", "commons", "fp", "sketch", "prefix"]
    ranked = common_shingles(docs, size, seed)
    order = np.argsort(ranked)
    common = docs.sparkSession.sparkContext.broadcast((ranked[order], order))  # MAX_COMMON of them at most

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            sets = _sets(texts, size, seed)
            named = np.frombuffer(b"".join([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]), np.int64).reshape(-1, 2)
            prefixes = [_prefix(s, *common.value) for s in sets]
            counts = pa.array([len(s) for s in sets], pa.int64()), pa.array([k for _, k in prefixes], pa.int64())
            columns = [part.column("doc_id"), pa.array([hashlib.md5(t).hexdigest() for t in texts]), pa.array(named[:, 0]), pa.array(named[:, 1]), *counts]
            arrays = [majority(s, LANES) for s in sets], [_sketch(s) for s in sets], [p.view(np.int64) for p, _ in prefixes]
            yield pa.RecordBatch.from_arrays([*columns, *map(lists, arrays)], names)

    base = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text")
    return base.mapInArrow(run, "doc_id long, text_key string, v long, w long, n long, commons long, fp array<long>, sketch array<long>, prefix array<long>")


def _distance(a: str, b: str) -> Column:
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x)


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, bits (distance of the complete fingerprints): the pairs (a, b) of set names that may be similar.

    9 |A xor B| <= |A| + |B| is Jaccard similarity 4/5 or more, and of two sketches no more bits differ than of two sets shingles.
    """
    pairs = small(materialize(pairs))
    for end in "ab":
        own = classes.select(F.col("v").alias(end), F.col("n").alias(f"n{end}"), F.col("fp").alias(f"fp{end}"), F.col("sketch").alias(f"sketch{end}"))
        pairs = pairs.join(own, end)
    alike = (5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (9 * _distance("sketcha", "sketchb") <= F.col("na") + F.col("nb"))
    return pairs.where(alike).select("a", "b", _distance("fpa", "fpb").alias("bits"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, seed: int) -> DataFrame:
    """The pairs (a, b) of set names that have Jaccard similarity 4/5 or more, by their complete texts."""
    asked = small(materialize(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()))
    one = small(materialize(classes.join(asked, "v").select("v", F.col("k.doc_id").alias("id"), F.col("k.text_key").alias("key"))))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    same = base["doc_id"].eqNullSafe(one["id"]) & (text_key(base["text"]) == one["key"])
    texts = materialize(base.join(one, same).select("v", "text").dropDuplicates(["v"]))
    joined = skew_join(pairs.select("a", "b"), texts.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b")
    # comparing takes more time than its bytes would tell, so the number of tasks follows the number of pairs
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 5000)
    joined = joined.repartition(tasks, "a").join(texts.select(F.col("v").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def sets(name: int, text: bytes) -> np.ndarray:
            if (found := known.get(name)) is None:
                (found,) = _sets([text], size, seed)
                if len(text) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED_SETS:
                        known.clear()
                    known[name] = found
            return found

        for part, first in chunks(batches, "ta"):
            ok = []
            for a, b, x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), first, texts_of(part.column("tb")), strict=True):
                x, y = sets(a, x), sets(b, y)
                ok.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = materialize(joined.mapInArrow(run, "a long, b long"))
    forget(texts)
    return found


def _hubs(table: DataFrame) -> DataFrame:
    """Pairs (a, b): texts and the most met of those that share a segment with them.  table has v, s, p (segment's number and value)."""
    counts = table.groupBy("s", "p").agg(F.count("*").alias("c")).where("c > 1")
    met = materialize(skew_join(table, counts, ["s", "p"]))
    known = met.groupBy("v").agg(F.sum("c").alias("met"))
    hubs = met.join(known, "v").groupBy("s", "p").agg(F.max(F.struct("met", "v")).alias("hub")).select("s", "p", F.col("hub.v").alias("b"))
    return skew_join(met.select("s", "p", F.col("v").alias("a")), hubs, ["s", "p"]).where("a <> b").select("a", "b").distinct()


def similar(docs: DataFrame, size: int = SHINGLE, seed: int = 42) -> DataFrame:
    """doc_id, text_key and component for every row: two longs, equal for all rows that links of similarity 4/5 or more join."""
    rows = materialize(described(docs, size, seed))
    own = rows.where("n > 0")
    first = [F.first(c).alias(c) for c in ("n", "fp", "sketch")]
    classes = materialize(own.groupBy("v").agg(F.min(F.struct("doc_id", "text_key")).alias("k"), *first))
    pieces = [p for k in range(LANES) for p in segments(F.get("fp", F.lit(k)), PER_LANE, WIDTH)]
    table = _table(classes.select("v", "fp"), pieces).toDF("v", "fp", "s", "p").drop("fp")
    hubs = _near(_hubs(table), classes).groupBy("a").agg(F.min_by("b", "bits").alias("b"))
    dense = _verified(materialize(hubs), docs, classes, size, seed)
    roots = components(dense)
    prefixes = own.groupBy("v").agg(*[F.first(c).alias(c) for c in ("n", "commons", "prefix")])
    labelled = prefixes.join(small(materialize(roots)), F.col("v") == F.col("id"), "left").withColumn("root", F.coalesce("root", "v"))
    index = labelled.select("v", "n", "root", "commons", F.posexplode("prefix").alias("i", "h")).repartition("h")
    a, b = (index.select("h", *[F.col(c).alias(end + c) for c in ("v", "n", "commons", "i", "root")]) for end in "ab")
    # 9 |A and B| >= 4 (|A| + |B|).  From the first common shingle of a similar pair on no more can be common than
    # either set has left.  Common shingles, the last of a prefix, only meet where there is that much room; all others
    # always meet, and are counted: in the prefix that ends first, all that isn't shared is the set's own, of which it
    # has few, and no more is shared uncounted than either prefix has of common shingles.
    need, few = 4 * (F.col("an") + F.col("bn")), F.least("acommons", "bcommons")
    room = 9 * F.least(F.col("an") - F.col("ai"), F.col("bn") - F.col("bi")) >= need
    hot = F.col("ai") > F.floor(F.col("an") / 5) - F.col("acommons")  # of the prefix's n // 5 + 1
    alike = 5 * F.least("an", "bn") >= 4 * F.greatest("an", "bn")
    met = a.join(b.hint("merge"), "h").where((F.col("av") < F.col("bv")) & (F.col("aroot") != F.col("broot")) & alike & (room | ~hot))
    least = [F.min(x).alias(x) for x in ("an", "bn", "acommons", "bcommons", "ai", "bi")]
    met = met.groupBy(F.col("av").alias("a"), F.col("bv").alias("b")).agg(F.count("*").alias("c"), *least)
    spare = lambda n: 9 * (F.floor(F.col(n) / 5) + 1 - F.col("c") - few) <= 5 * F.col(n) - 4 * F.col("bn" if n == "an" else "an")
    met = met.where(room & (spare("an") | spare("bn"))).select("a", "b")
    rest = _verified(materialize(_near(met, classes).select("a", "b")), docs, classes, size, seed)
    roots = components(dense.union(rest))
    joined = rows.select("doc_id", "text_key", "v", "w").join(roots, rows["v"] == roots["id"], "left")
    # texts that link to none are told apart by all 128 bits of the name
    return joined.select("doc_id", "text_key", F.coalesce("root", "v").alias("component"), F.when(F.col("root").isNull(), F.col("w")).alias("component2"))


def deduplicate(docs: DataFrame, size: int = SHINGLE, seed: int = 42) -> DataFrame:
    """Exactly one row of docs for each group of similar texts; all columns stay."""
    keys = materialize(similar(docs, size, seed).groupBy("component", "component2", "doc_id", "text_key").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("w")
    least = keys.groupBy("component", "component2").agg(first).withColumnsRenamed({"component": "c", "component2": "c2"})
    stays = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("text_key") == F.col("w.text_key"))
    i, k, s = fresh(docs, "id", "key", "stays")
    same = (keys["component"] == least["c"]) & keys["component2"].eqNullSafe(least["c2"])
    marks = keys.join(least, same).select(F.col("doc_id").alias(i), F.col("text_key").alias(k), stays.alias(s), "n").where(f"n > 1 or not {s}").drop("n")
    judged = docs.join(small(materialize(marks)), docs["doc_id"].cast("long").eqNullSafe(F.col(i)) & (text_key(docs["text"]) == F.col(k)), "left")
    once = judged.where(F.col(s).isNull()).drop(i, k, s)
    repeated = judged.where(s).dropDuplicates([i, k]).drop(i, k, s)
    return once.union(repeated)

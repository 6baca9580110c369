"""Importance resampling: documents drawn so that their word features resemble those of a target set.

Features are all runs of 1 to 2 words, counted by the crc32 of their bytes in `buckets` buckets.

1. One pass counts the buckets of the corpus, another those of the target; each task adds up an array, and
   what is shuffled is an array a task.  The two arrays, of fixed size, give every bucket's gain.
2. A second pass adds up the gains of a document's features; their floored mean is its weight.  Gumbel noise
   from a digest of the seed and the doc_id makes the weight a score: the highest scores are a draw without
   replacement.
3. Scores are whole numbers, so a histogram of them is small whatever the corpus (`SCORE_SPAN`): its counts,
   summed from the highest score down, tell how many documents rank above each score, and where the draw
   ends.  Only documents of scores that survive are numbered, by doc_id, score by score.

Defined results: null and empty texts have no features and weight 0; a null doc_id has no score and is never
drawn nor counted; repeated rows are drawn as rows of their own, in any order among themselves; an empty
corpus gives an empty result, an empty target gains without a target; texts of any length are read whole;
other columns are dropped by `scores` and kept, whatever their names, by `resample`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fresh, materialize
from .wordbuf import BY_ALNUM_LOWER

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: A gain is at most 1000 ln(2**63 * 2**63), the noise between -3,200 and 22,900: no more different scores than this.
SCORE_SPAN = 250_000
#: Scores that one block of the histogram spans.
BLOCK = 512
#: Bytes of text that are split into words at once.
SLICE = 1 << 20


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a slice of it at a time; a slice ends at a blank."""
    text = text.translate(BY_ALNUM_LOWER)
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + SLICE)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi].split()
        lo = hi


def features(text: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """By slice the number of words, and the buckets of the features that end in it."""
    last = None  # crc of the word before and a blank
    for words in word_slices(text):
        if words:
            ones = list(map(crc32, words))
            spaced = [crc32(b" ", c) for c in ones]
            twos = list(map(crc32, words[1:], spaced)) if last is None else list(map(crc32, words, [last, *spaced]))
            last = spaced[-1]
            yield len(words), np.array(ones + twos, np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_py() or b"", buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """What a feature of each bucket adds: 1000 times the log of its smoothed share in the target over that in the corpus, floored."""
    n, of, to = len(corpus), float(corpus.sum()) + len(corpus), float(target.sum()) + len(target)
    return [math.floor(1000 * math.log((float(target[k]) + 1) * of / ((float(corpus[k]) + 1) * to))) for k in range(n)]


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise times 1000, floored, from the first 32 bits of a digest."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((bits + 0.5) / 4294967296.0))).cast("long")


def _weighed(docs: DataFrame, target: DataFrame, names: list[str], buckets: int, seed: int) -> DataFrame:
    """docs with n_words, n_features, weight and score, called names."""
    (text,) = fresh(docs, "text_bytes")
    worth = docs.sparkSession.sparkContext.broadcast(np.array(gains(bucket_counts(docs, buckets), bucket_counts(target, buckets)), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sums = [], []
            for value in batch.column(text):
                n = total = 0
                for count, found in features(value.as_py() or b"", buckets):
                    n, total = n + count, total + int(worth.value[found].sum())
                words.append(n)
                sums.append(total)
            size = [max(0, 2 * n - 1) for n in words]
            weight = [s // m if m else 0 for s, m in zip(sums, size, strict=True)]
            made = [pa.array(x, pa.int64()) for x in (words, size, weight)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], *names[:3]])

    schema = StructType([*docs.schema.fields, *[StructField(x, LongType()) for x in names[:3]]])
    out = docs.withColumn(text, F.col("text").cast("binary")).mapInArrow(run, schema)
    return out.withColumn(names[3], F.col(names[2]) + noise(F.col("doc_id"), seed))


def _ranked(rows: DataFrame, names: list[str], rank: str, percent: int, least_words: int) -> DataFrame:
    """rows (a table) with their rank in the draw; null where they aren't drawn."""
    words, _, _, score = names
    before, width = fresh(rows, "before", "block")
    able = F.coalesce((F.col(words) >= least_words) & F.col(score).isNotNull(), F.lit(False))
    counts = rows.where(able).groupBy(score).agg(F.count("*").alias("n")).withColumn(width, F.floor(F.col(score) / BLOCK))
    above = W.orderBy(F.desc(width)).rowsBetween(W.unboundedPreceding, -1)  # a row a block: SCORE_SPAN / BLOCK of them at most
    blocks = counts.groupBy(width).agg(F.sum("n").alias("of")).select(width, F.coalesce(F.sum("of").over(above), F.lit(0)).alias("over"), F.sum("of").over(W.partitionBy()).alias("all"))
    inside = W.partitionBy(width).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)
    higher = F.col("over") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    drawn = F.floor(F.col("all") * percent / 100)
    last = fresh(rows, "drawn_rows")[0]
    held = counts.join(blocks, width).select(score, higher.alias(before), drawn.alias(last)).where(F.col(before) < F.col(last))
    some = rows.join(F.broadcast(held), score, "left")  # SCORE_SPAN rows of three numbers at most
    number = F.row_number().over(W.partitionBy(score).orderBy("doc_id")) + F.col(before)
    kept = some.where(able & F.col(before).isNotNull()).withColumn(rank, F.when(number <= F.col(last), number).cast("long"))
    rest = some.where(~able | F.col(before).isNull()).withColumn(rank, F.lit(None).cast("long"))
    return kept.unionByName(rest).select(*rows.columns, rank)


def scores(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) for every row of docs."""
    names = ["n_words", "n_features", "weight", "score"]
    rows = materialize(_weighed(docs.selectExpr("cast(doc_id as long) doc_id", "text"), target, names, buckets, seed).drop("text"))
    return _ranked(rows, names, "rank", percent, least_words).drop("n_words")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs that are drawn; all columns stay."""
    *names, rank = fresh(docs, "n_words", "n_features", "weight", "score", "rank")
    rows = materialize(_weighed(docs, target, names, buckets, seed))
    return _ranked(rows, names, rank, percent, least_words).where(F.col(rank).isNotNull()).select(*docs.columns)

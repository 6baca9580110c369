"""Language identification by mixtures: which languages a text is made of, and in what proportions.

Training counts the byte trigrams of words by language, over all rows that may train; a language's likelihood
of a word is the product of the smoothed shares of its trigrams.  A text is a mixture of languages that words
are drawn from:

1. Expectation-maximisation estimates the proportions: each word is shared out among the languages in
   proportion to their parts times their likelihoods of it, and the parts become the means of these shares.
2. Sets of languages are compared: the likeliest single language, then the two, three ... of the largest
   proportions, each fitted anew.  The set of the best likelihood, less `PENALTY` / 2 times the log of the
   number of words for each language beyond the first, is selected.
3. The prediction is the largest language of the selected set.  Its score is the share of the words that all
   languages together would give it, smoothed by one word, so a score near 1 needs a text of many clear words.

Texts are worked through in batches: a step updates all texts of a batch at once.

Defined results: texts that are null or have no letter are `und` with score 0, as is everything where nothing
was learned; rows whose lang is null don't train, nor those whose text has no word; of more than
MAX_LANGUAGES languages those with most rows are learned (of equals the least); ties go to the least language;
repeated rows give a row each; an empty table gives an empty result; texts of any length are read whole, the
words of long ones by slices, equal words of a slice as one; other columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordbuf import CHUNK_BYTES, Words, chunks

#: Places of trigrams in a language's table, by a hash; a model takes 4 * BUCKETS bytes a language.
BUCKETS = 1 << 15
MAX_LANGUAGES = 128
SMOOTHING, PENALTY = 0.1, 4.0
#: Steps of expectation-maximisation, and the change of a proportion at which they end sooner.
STEPS, SETTLED = 40, 1e-3
#: Languages of a set at most; a text of more is told by its largest ones.
MAX_SET = 4
UNKNOWN = "und"
#: Words are stretches of ASCII letters and of all bytes above ASCII; A-Z is lower-cased.
BY_LETTER_LOWER = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_has_letter = re.compile(r"[^\W\d_]").search


def trigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The places of the trigrams of all words, each with the blank before and after it, and where each word's begin."""
    buf = np.concatenate((np.full(1, 32, np.uint8), words.buf)).astype(np.uint32)  # a blank before the first word; words.buf ends in one
    value = (buf[:-2] << np.uint32(16)) | (buf[1:-1] << np.uint32(8)) | buf[2:]
    place = (value * np.uint32(2654435761)) >> np.uint32(32 - 15)
    # a word at bytes [a, b) is buf[a + 1 : b + 1], and has the trigrams that begin at a ... b - 1
    return place[buf[1:-1] != 32], np.concatenate(([0], np.cumsum(words.ends - words.starts)))[:-1]


def slices(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end at a blank."""
    lo = 0
    while lo < len(text):
        hi = text.find(b" ", lo + CHUNK_BYTES)
        hi = len(text) if hi < 0 else hi
        yield text[lo:hi]
        lo = hi


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts by the index of their first; a long one by slices."""
    if len(texts) == 1:
        yield from ((0, [s]) for s in slices(texts[0].translate(BY_LETTER_LOWER)))
    else:
        yield 0, texts


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and by trigram (rows) and language the log of its share; docs (text, lang) are all counted."""
    known = docs.where("lang is not null and text is not null")
    rows = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    names = sorted(r["lang"] for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS), np.int64)
        at = {name: k for k, name in enumerate(names)}
        for part, texts in chunks(batches):
            by: dict[int, list[bytes]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                if lang in at:
                    by.setdefault(at[lang], []).append(text)
            for k, own in by.items():
                for _, some in batches_of(own):
                    if len(words := Words(some, BY_LETTER_LOWER)):
                        total[k] += np.bincount(trigrams(words)[0], minlength=BUCKETS)
        lang, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(place), pa.array(total[lang, place])], ["lang", "place", "n"])

    counted = known.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang long, place long, n long")
    sums = counted.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    counts = np.zeros((BUCKETS, len(names)))
    counts[sums["place"].to_numpy(np.int64), sums["lang"].to_numpy(np.int64)] = sums["n"].to_numpy(float)
    learned = counts.sum(0) > 0
    counts = counts[:, learned]
    shares = (counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)
    return [n for n, ok in zip(names, learned.tolist(), strict=True) if ok], np.log(shares).astype(np.float32)


class Pool:
    """The different words of some texts: `text` (index, in order), `n` (how often) and `log` (likelihoods by language)."""

    def __init__(self, texts: list[bytes], model: np.ndarray):
        parts = [self._words(some, model) for _, some in batches_of(texts)]
        if len(parts) > 1:  # one long text: equal words of all its slices are one
            key, n, log = (np.concatenate(x) for x in zip(*[(k, n, log) for k, _, n, log in parts], strict=True))
            _, at, of = np.unique(key, return_index=True, return_inverse=True)
            self.n, self.log = np.bincount(of, n).astype(np.float64), log[at]
            self.text = np.zeros(len(at), np.int64)
        elif parts:
            _, self.text, self.n, self.log = parts[0]
        else:
            self.text, self.n, self.log = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, model.shape[1]))

    @staticmethod
    def _words(texts: list[bytes], model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words = Words(texts, BY_LETTER_LOWER)
        if not len(words):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, model.shape[1]))
        places, first = trigrams(words)
        hashes = words.hashes()
        order = np.lexsort((hashes, words.doc))
        doc, key = words.doc[order], hashes[order]
        new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))))
        n = np.diff(np.append(new, len(order))).astype(np.float64)
        at = order[new]
        size = (words.ends - words.starts)[at]
        begin = np.cumsum(size) - size
        grams = places[np.repeat(first[at] - begin, size) + np.arange(int(size.sum()))]
        return key[new], doc[new], n, np.add.reduceat(model[grams].astype(np.float64), begin, axis=0)


def mixtures(pool: Pool, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text the proportions of its allowed languages (texts x languages) and the log likelihood."""
    edge = np.flatnonzero(np.concatenate(([True], pool.text[1:] != pool.text[:-1]))) if len(pool.text) else np.zeros(0, np.int64)
    has = pool.text[edge]
    part = allowed / allowed.sum(1, keepdims=True)
    fit = np.zeros(len(allowed))
    if not len(edge):
        return part, fit
    of = np.repeat(np.arange(len(has)), np.diff(np.append(edge, len(pool.text))))  # each word's text among those that have words
    log = np.where(allowed[has][of], pool.log, -np.inf)
    top = log.max(1)
    like = np.exp(log - top[:, None])
    total = np.add.reduceat(pool.n, edge)
    own = part[has]
    live = np.arange(len(has))  # texts whose proportions still move
    words, where = np.arange(len(of)), of
    for _ in range(STEPS):
        share = like[words] * own[where]
        share *= (pool.n[words] / share.sum(1))[:, None]
        begin = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        after = np.add.reduceat(share, begin, axis=0) / total[live][:, None]
        moving = np.abs(after - own[live]).max(1) > SETTLED
        own[live] = after
        if not moving.any():
            break
        if not moving.all():
            live = live[moving]
            held = np.isin(where, live)
            words, where = words[held], where[held]
    part[has] = own
    fit[has] = np.add.reduceat(pool.n * (np.log((like * own[of]).sum(1)) + top), edge)
    return part, fit


def predict(pool: Pool, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text the language (its column), the score, and the proportions in the selected set."""
    k = pool.log.shape[1]
    total = np.bincount(pool.text, pool.n, minlength=n_texts)
    every, _ = mixtures(pool, np.ones((n_texts, k), bool))
    alone = np.stack([np.bincount(pool.text, pool.n * pool.log[:, j], minlength=n_texts) for j in range(k)], 1)
    first = alone.argmax(1)
    best, fit = np.eye(k)[first], alone.max(1)
    order = np.argsort(-every, axis=1, kind="stable")
    for size in range(2, min(k, MAX_SET) + 1):
        allowed = np.zeros((n_texts, k), bool)
        np.put_along_axis(allowed, order[:, :size], True, 1)
        part, likely = mixtures(pool, allowed)
        likely = likely - PENALTY / 2 * (size - 1) * np.log(np.maximum(total, 2))
        better = likely > fit
        best[better], fit[better] = part[better], likely[better]
    main = best.argmax(1)
    score = (every[np.arange(n_texts), main] * total + 1) / (total + k)
    return main, score, best


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages (`de:0.700 fr:0.300`, the selected set) for every row of docs; held-out rows don't train."""
    names, table = train(docs.where(~held_out(F.col("doc_id"))).select("text", F.col("lang").cast("string").alias("lang")))
    model = docs.sparkSession.sparkContext.broadcast(table)  # 4 * BUCKETS * MAX_LANGUAGES bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            told = [(UNKNOWN, 0.0, "")] * len(texts)
            if names:
                main, score, parts = predict(Pool(texts, model.value), len(texts))
                for k, text in enumerate(texts):
                    if _has_letter(text.decode(errors="replace")):
                        order = sorted(np.flatnonzero(parts[k] >= 0.0005).tolist(), key=lambda j, p=parts[k]: (-p[j], j))
                        told[k] = names[main[k]], float(score[k]), " ".join(f"{names[j]}:{parts[k][j]:.3f}" for j in order)
            columns = [pa.array(c, t) for c, t in zip(zip(*told, strict=True), (pa.string(), pa.float64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "lang_pred", "score", "languages"])

    told = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")

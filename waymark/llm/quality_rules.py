r"""Quality rules by distribution divergence, in DataFrame functions only.

Every document gets a histogram of character classes and one of its language's common words.  Both are
compared with fixed references of the language: a document is rejected where its Jensen-Shannon distance to
one of them is above a threshold.  So a verdict depends on nothing but the document's own text and language,
nothing is shuffled, and a corpus of junk can't approve itself.  Minimum-length guards keep short documents
from being judged by chance: characters count from `min_chars` on, common words from `min_words` on.
Repeated word windows are found by sorting a document's window hashes with their places, so the work grows as
n log n with a text's length.

Defined results: null and empty texts have no words and fail the base rules; a text in a language without a
reference (or none) is judged by the base rules and by the character classes, against whichever reference is
nearest, and not by common words; repeated rows give a row each; an empty table gives an empty result; other
columns are dropped by `judge` and kept, whatever their names, by `keep`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let

# The commonest words of each language with their share of running prose, in per mille (rounded).
COMMON_WORDS = {
    "en": "the 60, of 31, and 27, to 25, a 21, in 20, is 10, that 10, it 10, for 9, was 9, on 7, with 7, as 7, be 6, by 5, are 5, this 5, at 5, from 4, have 4, not 4, or 4, an 3",
    "de": "der 34, die 33, und 25, in 18, den 12, von 11, zu 11, das 10, mit 9, sich 8, des 8, auf 7, für 7, ist 9, im 7, dem 7, nicht 8, ein 7, eine 6, als 5, auch 5, es 6, an 5, werden 4",
    "fr": "de 55, la 31, le 28, et 25, les 23, des 18, en 14, un 13, du 13, une 11, que 10, est 11, pour 9, dans 9, qui 9, par 8, sur 7, au 7, pas 6, plus 5, avec 5, il 7, ce 5, a 10",
    "es": "de 62, la 39, que 31, el 31, en 27, y 27, a 20, los 17, se 13, del 13, las 11, un 11, por 10, con 10, no 9, una 9, su 8, para 7, es 8, al 6, lo 6, como 5, más 4, o 4",
}
# Shares of character classes in prose, in per mille: small letters and letters without case, capital letters, digits, white space, symbols, marks, all else.
CLASS_SHARES = {
    "en": [781, 24, 6, 165, 1, 22, 1],
    "de": [772, 50, 6, 143, 1, 26, 2],
    "fr": [770, 22, 6, 165, 1, 34, 2],
    "es": [780, 22, 6, 165, 1, 25, 1],
}
SYMBOLS = "#*$%&|<>"
END_MARKS = ".,;:!?"
#: Distance of character classes (0 to 1) above which a document is rejected; for common words the part of the
#: distance that a text without any of them has; and the lengths from which on these count.
MAX_CLASS_DISTANCE, MAX_WORD_PART = 0.21, 0.75
MIN_CHARS, MIN_WORDS = 200, 100


def common_words(lang: str) -> dict[str, int]:
    return {w: int(n) for w, n in (x.split() for x in COMMON_WORDS[lang].split(", "))}


def word_shares(lang: str) -> list[float]:
    """Shares of the language's common words and of all other words."""
    known = [n / 1000 for n in common_words(lang).values()]
    return [*known, 1 - sum(known)]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE_CLASS}+", -1), lambda w: w != "")


def repeat_words(words: Column, size: int = 3) -> Column:
    """Words that lie in a window of `size` words found twice or more in the array, the first included."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(places, k + 1) - p, F.lit(size))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + g)

    def by_sort(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        met = let(pairs, lambda ps: F.filter(ps, lambda x, k: (x["h"] == F.get(ps, k - 1)["h"]) | (x["h"] == F.get(ps, k + 1)["h"])))
        return F.sort_array(F.transform(met, lambda x: x["i"]))

    def by_search(hs: Column, doubles: Column) -> Column:
        met = F.transform(hs, lambda h, i: F.when(F.array_contains(doubles, h), i))
        return F.filter(met, lambda i: i.isNotNull())

    def again(hs: Column) -> Column:
        doubles = let(F.sort_array(hs), lambda ss: F.array_distinct(F.filter(ss, lambda h, k: h == F.get(ss, k + 1))))
        # few doubles are searched for, many would make that quadratic: the same places either way
        return let(doubles, lambda ds: F.when(F.size(ds) == 0, F.lit(0)).when(F.size(ds) <= 48, let(by_search(hs, ds), covered)).otherwise(let(by_sort(hs), covered)))

    def hashed(ws: Column) -> Column:
        starts = F.slice(ws, 1, F.greatest(F.size(ws) - (size - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, size)]))

    return let(words, lambda ws: let(hashed(ws), again)).cast("long")


def _classes(text: Column, rest: Column) -> Column:
    """Counts by character class, as in CLASS_SHARES; rest is the text without small letters."""
    left = lambda pattern: F.length(F.regexp_replace(rest, pattern, ""))
    n = F.length(rest)
    upper, digit, space = (n - left(p) for p in (r"\p{Lu}+", r"\p{Nd}+", rf"{SPACE_CLASS}+"))
    symbol, mark, caseless = n - left(r"[#*$%&|<>]+"), n - left(r"[.,;:!?'\"()\-]+"), n - left(r"[\p{Lo}\p{Lm}\p{M}]+")
    small = F.length(text) - n + caseless
    return F.array(*[x.cast("double") for x in (small, upper, digit, space, symbol, mark, n - upper - digit - space - symbol - mark - caseless)])


def _word_counts(words: Column, listed: list[str]) -> Column:
    """How often every listed word occurs, in small letters, capitals or with a capital, one mark behind it aside; and all other words."""
    forms = [form + mark for w in listed for form in sorted({w, w.upper(), w.capitalize()}) for mark in ("", *END_MARKS)]

    def number(hits: Column, word: str) -> Column:
        return F.size(F.filter(hits, lambda h: h == word)).cast("double")

    def counts(hits: Column) -> Column:
        return F.concat(F.array(*[number(hits, word) for word in listed]), F.array((F.size(words) - F.size(hits)).cast("double")))

    bare = F.transform(F.filter(words, lambda w: w.isin(forms)), lambda w: F.translate(F.lower(w), END_MARKS, ""))
    return let(bare, counts)


def distance(counts: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance (root of the divergence in bits) of an array of counts to fixed shares; null without counts."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    term = lambda a, b: let((a + b) / 2, lambda m: (part(a, m) + part(b, m)) / 2)
    own = let(total(counts), lambda n: F.when(n > 0, F.transform(counts, lambda v: v / n)))
    return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(own, F.array(*map(F.lit, shares)), term))))


def empty_distance(lang: str) -> float:
    """Distance to the reference of a text without any common word."""
    other = word_shares(lang)[-1]
    middle = (1 + other) / 2
    return math.sqrt((-math.log2(middle) + other * math.log2(other / middle) + (1 - other)) / 2)


def _by_language(lang: Column, each, otherwise: Column) -> Column:
    out = otherwise
    for name in COMMON_WORDS:
        out = F.when(lang == name, each(name)).otherwise(out)
    return out


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def judgement(text: Column, lang: Column, max_class: float = MAX_CLASS_DISTANCE, max_word_part: float = MAX_WORD_PART, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> Column:
    """A struct of the base counts, base_failed, both distances and kept."""
    shares = {name: [x / sum(row) for x in row] for name, row in CLASS_SHARES.items()}
    none = F.lit(None).cast("double")
    most = _by_language(lang, lambda name: F.lit(max_word_part * empty_distance(name)), none)

    def measured(ws: Column) -> Column:
        words = _by_language(lang, lambda name: distance(_word_counts(ws, list(common_words(name))), word_shares(name)), none)
        return F.struct(F.size(ws).cast("long").alias("n"), repeat_words(ws).alias("repeat"), words.alias("far"))

    def judged(own: Column) -> Column:
        classes = let(own["classes"], lambda c: F.struct(c.alias("c"), _by_language(lang, lambda name: distance(c, shares[name]), F.least(*[distance(c, x) for x in shares.values()])).alias("far")))
        return let(F.struct(own["w"].alias("w"), own["chars"].alias("chars"), own["lines"].alias("lines"), classes.alias("k")), verdict)

    def verdict(x: Column) -> Column:
        chars, symbols, failed = x["chars"] - x["k"]["c"][3].cast("long"), x["k"]["c"][4].cast("long"), base_failed(x["w"]["n"], x["w"]["repeat"])
        out = (chars >= min_chars) & (x["k"]["far"] > max_class) | (x["w"]["n"] >= min_words) & (x["w"]["far"] > most)
        counts = [x["w"]["n"].alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), x["lines"].alias("n_dup_lines"), x["w"]["repeat"].alias("n_repeat_words"), failed.alias("base_failed")]
        return F.struct(*counts, (~failed & ~F.coalesce(out, F.lit(False))).alias("kept"), x["k"]["far"].alias("class_distance"), x["w"]["far"].alias("word_distance"))

    def whole(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        repeated = let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long")
        classes = let(F.regexp_replace(t, r"\p{Ll}+", ""), lambda rest: _classes(t, rest))  # what small letters leave is short
        return let(F.struct(let(words_of(t), measured).alias("w"), F.length(t).cast("long").alias("chars"), repeated.alias("lines"), classes.alias("classes")), judged)

    return let(F.coalesce(text.cast("string"), F.lit("")), whole)


def judge(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, the base counts, base_failed, both distances and kept for every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), judgement(F.col("text"), F.col("lang").cast("string"), **parameters).alias("j"))
    return own.select("doc_id", "j.*")


def keep(docs: DataFrame, **parameters) -> DataFrame:
    """docs without the rejected rows."""
    return docs.where(judgement(docs["text"], docs["lang"].cast("string"), **parameters)["kept"])

"""Importance resampling, language mixtures and periodic runs against plain Python, held-out languages and odd inputs."""

import collections
import hashlib
import math
import random
import zlib

import brute
import numpy as np
import pytest

from waymark.llm import importance, language_mixture, periodic_runs
from waymark.llm.periodic_runs import Run

ODD = [(None, "null id " * 30), (1, None), (2, ""), (3, "same words here"), (3, "same words here"), (4, " \t\n "), (5, "ß é " * 50), (6, "x" * 5000), (7, "a b " * 40_000), (8, "1 2 3 ?!")]
CLASHES = ["'s' source", "7L n_words", "1 score", "2 rank", "3 n_features", "4 weight", "5 text_bytes", "6 before", "7 block", "8 drawn_rows", "9 n_runs"]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", *CLASHES)


def plain_scores(rows, bench, percent=25, least=20, buckets=10_000):
    def features(text):
        w = brute.tokens(text)
        return [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s = collections.Counter(f for _, t in rows for f in features(t))
    t = collections.Counter(f for x in bench for f in features(x))
    of, to = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc, text in rows:
        own = features(text)
        weight = sum(math.floor(1000 * math.log((t[f] + 1) * of / ((s[f] + 1) * to))) for f in own) // len(own) if own else 0
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"7:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, score, None])
    able = sorted((i for i, (doc, text) in enumerate(rows) if doc is not None and len(brute.tokens(text)) >= least), key=lambda i: (-out[i][3], rows[i][0]))
    for n, i in enumerate(able[: percent * len(able) // 100]):
        out[i][4] = n + 1
    return [tuple(x) for x in out]


@pytest.mark.parametrize("percent", [0, 25, 60, 100])
def test_draw_equals_plain_python(spark, percent):
    rng = random.Random(percent)
    vocab = [f"w{i}" for i in range(60)] + ["Élan", "GO", "9"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(200)] + ODD + [(i, "copy of one text " * 10) for i in range(300, 340)]
    bench = [" ".join(rng.choice(vocab[:9]) for _ in range(30)) for _ in range(9)] + [None, ""]
    got = importance.scores(docs(spark, rows), spark.createDataFrame([(x,) for x in bench], "text string"), percent=percent).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_scores(rows, bench, percent)))


def test_draw_of_equal_scores_and_whole_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 7)  # features across the ends of slices
    rows = [(9, f"alpha beta gamma {'delta ' * 30}")] * 11 + [(4, "beta " * 25)] * 5
    target = spark.createDataFrame([("beta beta",)], "text string")
    want = plain_scores(rows, ["beta beta"])
    got = importance.scores(docs(spark, rows), target).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    kept = importance.resample(docs(spark, rows), target)
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if r[4])
    assert importance.scores(docs(spark, rows).limit(0), target).count() == 0
    assert importance.scores(docs(spark, rows), target.limit(0)).count() == len(rows)


TONGUES = {"aa": "tion ing the of and str".split(), "bb": "eux eau ment que les ain".split(), "cc": "ung sch lich der die ein".split()}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_of_held_out_and_mixed_texts(spark):
    rng = random.Random(4)
    rows = [(i, speech(rng, lang := rng.choice(list(TONGUES)), rng.randint(8, 80)), lang) for i in range(400)]
    rows += [(1000 + i, f"{speech(rng, 'aa', 60)} {speech(rng, 'bb', 140)}", None) for i in range(20)]
    rows += [(2000 + i, text, None) for i, (_, text) in enumerate(ODD)] + [(None, speech(rng, "cc", 50), None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).selectExpr("*", "1 score", "2 languages", "3 held_out")
    got = language_mixture.identify(df).collect()
    known = {r[0]: r[2] for r in rows}
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(by[i].lang_pred == known[i] for i in range(400)) and by[None].lang_pred == "cc"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None) and by[None].held_out is False
    for i in range(1000, 1020):
        parts = dict(x.split(":") for x in by[i].languages.split())
        assert by[i].lang_pred == "bb" and list(parts) == ["bb", "aa"] and abs(float(parts["aa"]) - 0.3) < 0.05
    want_unknown = [text is None or not any(c.isalpha() for c in text) for _, text in ODD]
    assert [by[2000 + i].lang_pred == "und" for i in range(len(ODD))] == want_unknown
    assert language_mixture.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language_mixture.identify(df.withColumn("lang", language_mixture.F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixtures_equal_plain_steps_and_long_texts_by_slices(monkeypatch):
    rng = random.Random(6)
    model = np.log(np.random.default_rng(1).dirichlet(np.ones(language_mixture.BUCKETS), 3).T).astype(np.float32)
    texts = [speech(rng, rng.choice(list(TONGUES)), n).encode() for n in (1, 40, 0, 7, 200)]
    parts, fit = language_mixture.mixtures(language_mixture.Pool(texts, model), np.ones((5, 3), bool))
    for text, part, likely in zip(texts, parts, fit, strict=True):
        words = [language_mixture.Pool([w], model).log[0] for w in text.split()]
        p = np.full(3, 1 / 3)
        for _ in range(language_mixture.STEPS if words else 0):
            share = [np.exp(w - w.max()) * p for w in words]
            q = sum(x / x.sum() for x in share) / len(words)
            p, moved = q, np.abs(q - p).max()
            if moved <= language_mixture.SETTLED:
                break
        assert np.allclose(part, p, atol=1e-9)
        assert abs(likely - sum(np.log((np.exp(w - w.max()) * p).sum()) + w.max() for w in words)) < 1e-6
    one = language_mixture.predict(language_mixture.Pool(texts[4:], model), 1)
    monkeypatch.setattr(language_mixture, "CHUNK_BYTES", 50)
    assert all(np.allclose(a, b) for a, b in zip(one, language_mixture.predict(language_mixture.Pool(texts[4:], model), 1), strict=True))


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(6, 4 * q) and not any(w[i + p : i + n] == w[i : i + n - p] for p in range(1, q)):
                out.append(Run(i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r.start, r.period))


def wordy(rng):
    n, k = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5, 20])
    w = [b"%d" % rng.randint(0, k - 1) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        p = 1 + (n - a) // (3 + rng.randint(0, 7))
        w = [*w[:a], *(w[a + i % p] for i in range(n - a))]
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(7):
        a, b = b, b + a  # Fibonacci words are full of squares
    return w + w[-5:] * rng.randint(0, 6) * (rng.random() < 0.3) + b[: rng.randint(0, 55)] * rng.choice([0, 0, 0, 1, 4])


def test_runs_equal_all_periods_tried():
    rng = random.Random(5)
    for _ in range(300):
        texts = [wordy(rng) for _ in range(rng.randint(1, 6))]
        assert periodic_runs.runs_of(texts) == [plain_runs(w) for w in texts]
    for w in ([b"x"] * 5000, [b"%d" % (i % 777) for i in range(5000)], [b"a", b"b"] * 3000):
        assert periodic_runs.runs_of([w, w]) == [[Run(0, len(w), len(set(w)))]] * 2


def test_all_squares_of_a_string():
    """repetitions() finds the runs of two periods too, which the query doesn't ask for."""
    rng = random.Random(9)
    for _ in range(300):
        s = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(1, 40))]
        want = set()
        for q in range(1, len(s) // 2 + 1):
            i = 0
            while i + q < len(s):
                j = i
                while j + q < len(s) and s[j] == s[j + q]:
                    j += 1
                if j - i >= q and not any(s[i + p : j + q] == s[i : j + q - p] for p in range(1, q)):
                    want.add((i, j - i + q, q))
                i = max(j, i + 1)
        got = periodic_runs.repetitions(np.array([*s, 99]))
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


def test_runs_of_documents(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["\n", " ", "\t  "]).join(x.decode() for x in wordy(rng))) for i in range(150)] + ODD
    got = periodic_runs.find_runs(periodic_runs.planted(docs(spark, rows))).collect()

    def expected(doc, text):
        w = [x.encode() for x in brute.words(text)]
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = plain_runs(w) if len(w) < 2000 else [Run(0, len(w), 2)]
        dropped = {i for r in runs for i in range(r.start + r.period, r.start + r.length)}
        top = sorted(runs, key=lambda r: (-r.length / r.period, r.start, r.period))[:1]
        told = (*top[0][:1], top[0].length, top[0].period, 1000 * top[0].length // top[0].period) if top else (None,) * 4
        listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
        return doc, len(runs), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest()

    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(*r)) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 40
    cut = periodic_runs.collapse(docs(spark, [*rows[:20], (500, "x a b a b a b a b y"), (501, "  kept \n as it is ")]))
    text = {r.doc_id: r.text for r in cut.collect()}
    assert text[500] == "x a b y" and text[501] == "  kept \n as it is " and cut.columns == docs(spark, rows).columns
    assert periodic_runs.find_runs(docs(spark, rows).limit(0)).count() == 0

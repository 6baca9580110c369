"""The pipeline against plain Python, its near-duplicate stage on every pair, and odd tables for every stage."""

import random
from collections import Counter

import pytest
import xxhash

import brute
import corpus_pipeline
from waymark.llm import packing, quality_rules, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = tuple(quality_rules.common_words("en"))


def prose(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.35 else "w" + "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def edited(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = "n" + "".join(rng.choice("abcdefghij") for _ in range(5))
    return " ".join(w)


def corpus(seed=5):
    """Clean texts, near copies on both sides of 0.8, shared passages, benchmark passages, rejected texts, odd ids."""
    rng = random.Random(seed)
    shared, bench = [prose(rng, n) for n in (25, 60)], [prose(rng, n) for n in (5, 13, 30)]
    texts = [prose(rng, rng.choice([60, 120, 300])) for _ in range(40)]
    for t in texts[:12]:
        texts += [edited(rng, t, rng.randint(0, 8)) for _ in range(3)]
    texts = [t + " " + rng.choice(shared) if rng.random() < 0.3 else t for t in texts]
    texts = [t + " " + rng.choice(bench) if rng.random() < 0.2 else t for t in texts]
    texts += ["", None, "too short", "| ".join(f"w{i}" for i in range(150)), "x y z " * 60]
    rng.shuffle(texts)
    rows = [(i, t, rng.choice(["en", "en", None, "xx"]), rng.choice(["s", "s", "t", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, prose(rng, 80), "en", "s", 0), (None, prose(rng, 80), "en", "s", 0), (7, prose(rng, 80), "en", "s", 0), rows[3], rows[3]]
    return rows, [(i, t) for i, t in enumerate(bench)]


def by_hand(rows, bench):
    kept = [r for r in rows if brute.quality(r[1], r[2])[-1]]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    label = brute.similar([r[1] for r in kept])
    groups = {}
    for r, x in zip(kept, label, strict=True):
        groups.setdefault(x, []).append(r)
    kept = [min(g, key=order) for g in groups.values()]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))  # a null id comes first here
    cut = brute.without_repeats([(r[0], r[1]) for r in kept])
    kept = [r if not gone else (r[0], text, r[2], r[3], len(text)) for r, (_, gone, text) in zip(kept, cut, strict=True)]
    return [r for r in kept if not (n := len(brute.hits(r[1], bench)[0])) or 20 * n < len(brute.tokens(r[1]))]


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    want = by_hand(rows, bench)
    assert sorted(map(repr, map(tuple, docs.collect()))) == sorted(map(repr, want)) and 20 < len(want) < len(rows) - 25
    fps = [brute.fingerprint(r[1]) for r in want]
    label = brute.unite(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    pieces = []
    for r, x in zip(want, label, strict=True):
        n, piece = len(brute.words(r[1])), 0
        pieces.append((-n, r[0] is not None, r[0] or 0, piece, r[3] is not None, r[3] or "", n, x if n else None, r))
    pieces.sort(key=lambda p: p[:6])
    placed = brute.pack([(p[6], p[5] if p[4] else None, p[7]) for p in pieces], packing.CAPACITY, packing.SOURCE_SLOTS)
    got = sorted((repr(r.doc_id), r.n_words, r.bin, r.source_slot) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((repr(p[8][0]), p[6], b, s) for p, (b, s) in zip(pieces, placed, strict=True))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(40))
    texts = []
    for _ in range(40):
        w = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([3, 6, 30, 120, 400]))]
        texts.append(" ".join(w) + rng.choice(["", " " + shared]))
        texts += [edited(rng, texts[-1], rng.randint(0, 1 + len(w) // 25)) for _ in range(4)]
    label = brute.similar(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == {min(i for i in range(len(texts)) if label[i] == x) for x in set(label)}
    assert len(set(label)) < len(texts) - 60  # many copies lie within the bound


def test_pairs_below_the_bound_stay(spark):
    words = [f"a{i}" for i in range(49)]  # 45 shingles; a change in the middle takes five of each
    one, two = words[:], words[:]
    one[20] = "x"
    two[10] = two[30] = "y"
    rows = [(1, " ".join(words)), (2, " ".join(one)), (3, " ".join(two))]
    assert [len(brute.shingles(rows[0][1]) & brute.shingles(t)) for _, t in rows] == [45, 40, 35]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == [1, 3]


def test_one_row_stays_of_each_group_whatever_the_ids(spark):
    rng = random.Random(2)
    texts = [prose(rng, 150) for _ in range(6)]
    rows = [(None, t) for t in texts[:4]] + [(5, t) for t in texts[3:]] + [(5, texts[5]), (None, texts[0])]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(r.text for r in got) == sorted(texts)
    assert {r.text: r.doc_id for r in got}[texts[3]] == 5


def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch):
    rng = random.Random(9)
    texts = [f"{t} only{i} {k}" for i, t in enumerate(prose(rng, 12) for _ in range(30)) for k in range(3 + i % 3)]
    texts += ["copied " * 5] * 9 + [None, "", None]
    texts += [f"filler{i}" for i in range(12_000 - len(texts))]
    rng.shuffle(texts)
    held = Counter(xxhash.xxh64_intdigest(" ".join(s), 42) for t in set(texts) for s in brute.shingles(t))  # copies count once
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for most in (300_000, 200, 5):
        monkeypatch.setattr(simhash, "MAX_COMMON", most)
        least = min(c for c in range(3, 9) if sum(n >= c for n in held.values()) <= most)
        got = simhash.common_shingles(df, 5, 42).tolist()
        assert sorted(got) == sorted(h for h, n in held.items() if n >= least)
        assert [held[h] for h in got] == sorted(held[h] for h in got)


CLASHES = ("id", "key", "stays", "rest", "marks", "spans", "did", "t", "u", "n_words", "item_ids", "text_bytes", "text_key", "v", "w", "root", "component", "fp", "cluster", "kept", "row")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, "a b c"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(1)
    long = prose(rng, 60_000)
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, long, "en", "s", len(long)), (3, prose(rng, 90), "en", None, 9), (3, prose(rng, 90), None, "s", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    crowded = df.selectExpr("*", *[f"'x' {c}" for c in CLASHES])
    out = stage(spark, crowded, str(tmp_path)).collect()
    want = {"quality rules": 3, "near duplicates": 4, "repeated passages": 6, "contamination": 6, "packing": 5 + -(-60_000 // packing.CAPACITY)}
    assert len(out) == want[name]
    if name != "packing":
        assert out[0].asDict().keys() == set(crowded.columns) and {x for r in out for x in r[5:]} == {"x"}
        assert sorted(map(repr, (tuple(r)[:5] for r in out))) == sorted(map(repr, (tuple(r) for r in stage(spark, df, str(tmp_path)).collect())))
    assert stage(spark, crowded.where("false"), str(tmp_path)).count() == 0

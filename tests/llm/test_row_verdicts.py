"""Quality rules: verdicts against plain Python, by row, with fixed references."""

import random

import brute
from waymark.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string"


def prose(rng, n=150, common=tuple(quality_rules.common_words("en")), part=0.35):
    return " ".join(rng.choice(common) if common and rng.random() < part else "w" + "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_verdicts_equal_plain_python(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([40, 60, 99, 100, 400]), part=rng.choice([0, 0.05, 0.1, 0.15, 0.35])), rng.choice(["en", "en", "de", "xx", None])) for i in range(120)]
    rows += [(200 + i, rng.choice([str.upper, str.title])(prose(rng)) + rng.choice([" 12 ", " ß漢字 ", "!? "]) * 30, "en") for i in range(10)]
    rows += [(300, "The. of, AND! to? " * 3 + prose(rng), "en"), (301, "漢字" * 400, "xx"), (302, "", "en"), (303, None, None), (304, "a\n" * 70, "fr"), (None, prose(rng), "es")]
    got = quality_rules.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(repr(tuple(r)[:8]) for r in got) == sorted(repr((i, *brute.quality(t, lang))) for i, t, lang in rows)
    assert {r.kept for r in got if not r.base_failed} == {True, False}


def test_rejected_row_takes_no_other_of_its_id(spark):
    rng = random.Random(1)
    clean = [(k, prose(rng), "en") for k in [None, None, 7, 7, 8]]
    df = spark.createDataFrame(clean + [(None, "too short", "en"), (7, "short too", "en"), (8, "", None)], SCHEMA).repartition(3)
    assert sorted(map(repr, map(tuple, quality_rules.keep(df).collect()))) == sorted(map(repr, clean))


def test_a_corpus_of_junk_does_not_approve_itself(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, common=()), "en") for i in range(20)] + [(100 + i, prose(rng), "en") for i in range(5)]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i for i, k in kept.items() if k} == {100, 101, 102, 103, 104}

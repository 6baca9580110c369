"""The corpus operators against brute force, an exact round trip or held-out accuracy, with odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import brute

from waymark.llm import chat_format, decontaminate, license_scan, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_count, url_filter

ODD = [(None, "null id"), (1, None), (2, ""), (3, "same words here"), (3, "same words here"), (4, " \t\n "), (5, "ß é " * 50), (6, "x" * 5000)]
DOCS = "doc_id long, text string"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.selectExpr("*", "'en' lang", "'s' source", "7L n_words", "1 a", "2 k") if extra else df


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    parts = [" ".join(rng.choice(["a", "b", "c", f"e{rng.randint(0, 50)}"]) for _ in range(rng.randint(5, 60))) for _ in range(10)]
    fresh = lambda: " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, 30)))
    return [(i, " ".join(rng.choice(parts) if rng.random() < 0.5 else fresh() for _ in range(rng.randint(0, 6))) + rng.choice(["", "", " x" * 60])) for i in range(n)]


@pytest.mark.parametrize("block", [1 << 20, 20_000, 200, 1])
def test_decontamination(spark, block):
    rng = random.Random(1)
    vocab = [f"t{i}" for i in range(40)]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 13, 20])))) for i in range(12)] + [(12, ""), (13, None), (14, bench_twin := "t1 t2 t3 Éa")]
    rows = [(i, " ".join(rng.choice([rng.choice(vocab), (bench[rng.randint(0, 11)][1]).upper()]) for _ in range(30))) for i in range(40)] + [(50, bench_twin.upper().replace("É", "é"))] + [r for r in ODD if r[0]]
    got = decontaminate.report(decontaminate.scan(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block)).collect()
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    split = lambda t: token.findall((t or "").translate(low))
    items = [(str(i), w) for i, t in bench if (w := split(t))]

    def expected(doc_id, text):
        w, hit, ids = split(text), set(), set()
        for item, iw in items:
            n = min(13, len(iw))
            wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    ids.add(item)
        return doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)

    assert sorted(map(tuple, got)) == sorted(expected(*r) for r in rows)
    left = decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in rows if not expected(*r)[-1])


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (None, "null id"), (3, "")], "item_id long, text string")
    rows = ODD + [(9, "So: ALPHA, beta -- gamma! And on. alpha beta gamma")]
    got = decontaminate.report(decontaminate.scan(docs(spark, rows), bench)).collect()
    assert sorted(r.n_hit for r in got) == [0] * len(ODD) + [6] and len(got) == len(rows)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs(spark, rows).withColumn("spans", simhash.F.lit(1)), bench).collect()}
    assert cut[9] == "So: ! And on. " and cut[6] == "x" * 5000 and cut[1] is None
    for empty in (bench, bench.limit(0)):
        assert decontaminate.scan(docs(spark, ODD).limit(0), empty).count() == 0
    assert decontaminate.decontaminate(docs(spark, ODD), bench.limit(0)).count() == len(ODD)


@pytest.mark.parametrize("many", [False, True])
def test_packing_takes_the_tightest_compatible_bin(spark, many):
    """In one shard the same bins as a search of all bins, with ties, repeated rows, null sources and clusters."""
    rng = random.Random(8)
    rows = [(rng.choice([None, i, i]), rng.choice(["a", "a", None]), rng.choice([None, 1, 2, i]), rng.choice([0, 3, 7, 7, 20, 55, 130])) for i in range(150)]
    rows += rows[:20] * (3 if many else 1)
    df = spark.createDataFrame([(i, s, c, "w " * n) for i, s, c, n in rows], "doc_id long, source string, own long, text string").repartition(3)
    out = packing.pack(df, capacity=60, source_slots=3, shard_docs=1000, cluster="own").collect()
    pieces = [(i, piece, n, s, c) for i, s, c, total in rows for piece, n in enumerate([60] * (total // 60) + [total % 60] * (total % 60 > 0 or total == 0))]
    pieces.sort(key=lambda p: (-p[2], p[0] is not None, p[0] or 0, p[1], p[3] is not None, p[3] or "", p[4] is not None, p[4] or 0))
    placed = brute.pack([(n, s, c) for _, _, n, s, c in pieces], 60, 3)
    want = sorted(repr((i, piece, n, 0, b, slot)) for (i, piece, n, _, _), (b, slot) in zip(pieces, placed, strict=True))
    assert sorted(repr(tuple(r)) for r in out) == want


def test_packing_deals_equal_rows_over_shards(spark):
    df = spark.range(2000).selectExpr("cast(null as long) doc_id", "'s' source", "'one two' text")
    out = packing.pack(df, shard_docs=100).groupBy("shard").count().collect()
    assert len(out) == 20 and max(r["count"] for r in out) < 200


def test_packing_respects_room_and_conflicts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50) if i % 3 else [f"u{i}"] * rng.randint(1, 130))) for i in range(300)]
    out = packing.pack(docs(spark, rows), capacity=60, source_slots=2, shard_docs=100).collect()
    bins, own = collections.Counter(), collections.defaultdict(list)
    sizes = collections.Counter()
    for r in out:
        bins[r.shard, r.bin] += r.n_words
        own[r.shard, r.bin].append(r)
        sizes[r.doc_id] += r.n_words
    assert max(bins.values()) <= 60 and all(sizes[i] == len(words(t)) for i, t in rows)
    text = dict(rows)
    for placed in own.values():
        assert len(placed) <= 2 and len({r.source_slot for r in placed}) == len(placed)
        keys = [" ".join(words(text[r.doc_id])) for r in placed if text[r.doc_id]]
        assert len(keys) == len(set(keys))
    assert packing.pack(docs(spark, ODD)).count() == len(ODD) + 0
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 80))) for _ in range(30)]
    rows = []
    for i in range(120):
        w = rng.choice(base).split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (201, None), (202, "A b"), (203, "a B"), (203, "a B")]

    def fp(text):
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in rows]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if label[a] != label[b] and (fps[a] ^ fps[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    got = simhash.near_duplicates(docs(spark, rows)).select("doc_id", simhash.hex_fingerprint(simhash.F.col("fp")).alias("f"), "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, label, strict=True))
    hot = rows + [(1000 + i, rows[0][1]) for i in range(300)]  # a fingerprint that most rows have
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, hot)).collect()}
    assert len(got) == len({i for i, _ in hot}) and all(got[1000 + i] == label[0] for i in range(300))
    assert simhash.near_duplicates(docs(spark, ODD)).count() == len(ODD)
    assert simhash.near_duplicates(docs(spark, ODD).limit(0)).count() == 0


def test_licenses(spark):
    noise = "the software of words " * 20
    rows = [(10 + i, noise + text + " " + noise) for i, (_, text) in enumerate(license_scan.TEMPLATES)] + [(100, noise), (101, "Licensed under nothing at all")]
    got = {r.doc_id: r.licenses for r in license_scan.report(license_scan.scan_licenses(docs(spark, rows + ODD))).collect()}
    assert all(name in got[10 + i].split(",") for i, (name, _) in enumerate(license_scan.TEMPLATES)) and got[100] == got[101] == got[1] == ""


def test_altered_licenses_are_found(spark):
    """Whole texts and notices with words replaced, left out or added, as long as 0.8 of the shingles are there."""
    rng = random.Random(12)
    rows, near = [], {}
    for name, text in license_scan.TEMPLATES:
        w = license_scan.words_in(text)
        for _ in range(12 if len(w) > 60 else 0):
            copy = w[:]
            for _ in range(rng.randint(1, len(w) // 35)):
                i = rng.randrange(len(copy))
                copy[i : i + 1] = rng.choice([[], ["altered"], [copy[i], "added"]])
            own = {" ".join(copy[i : i + 5]) for i in range(len(copy) - 4)}
            known = license_scan.shingles_in(w)
            if 5 * len(own & set(known)) >= 4 * len(known):
                near[len(rows)] = name
                rows.append((len(rows), "some prose before it " * rng.randint(0, 40) + " ".join(copy) + " and behind" * rng.randint(0, 40)))
    got = {r.doc_id: r.licenses.split(",") for r in license_scan.report(license_scan.scan_licenses(docs(spark, rows))).collect()}
    found = sum(name in got[i] for i, name in near.items())
    assert len(near) > 40 and found >= 0.99 * len(near)


def test_urls(spark):
    pages = [(1, None), (2, "abc"), (3, "http://A.NET/x"), (3, "http://A.NET/x"), (4, "http://net"), (5, "https://a.example.net/en/?q#f"), (6, "http://xnet/"), (7, "http://b.org/fr/" + "y" * 3000), (8, "s://example.com/de/#")]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' rule", "'y' row"), url_filter.rule_table(spark)).collect()

    def expected(page, url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (page, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(*p)) for p in pages)


def test_tokens_equal_the_library(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    rows = ODD + [(100 + i, "".join(rng.choice("ab .,  ▁\n<s>é漢²𝔘12{}'/") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    got = token_count.count_tokens(docs(spark, rows), path, limit=10).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 10)) for i, t in rows)


def test_quality_counts(spark):
    rows = corpus(60) + ODD + [(300, "ab | cd\nab | cd\n\n \nab | cd # x " * 5), (301, " ".join(str(k % 120) for k in range(900)))]
    got = quality_rules.judge(docs(spark, rows)).collect()

    def expected(i, t):
        t = t or ""
        w = words(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        return i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)

    assert sorted(repr(tuple(r)[:7]) for r in got) == sorted(repr(expected(*r)) for r in rows)
    assert all(not r.kept for r in got if r.base_failed) and any(r.kept for r in got)


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"fanout": 1, "block": 8}])
def test_substring_dedup(spark, options):
    rng = random.Random(9)
    long = " ".join("ab" * rng.randint(100, 300) for _ in range(30))  # words longer than LONG_WORD
    rows = corpus(200) + [(900, None), (901, ""), (902, long), (903, "x " + long), (904, "p q r " * 40)]
    want = {i: w for (i, _), w in zip(sorted(rows), brute.without_repeats(sorted(rows)), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring_dedup.remove_repeats(docs(spark, rows), **options).collect()}
    assert got == want
    assert substring_dedup.remove_repeats(docs(spark, ODD)).count() == len(ODD)
    assert substring_dedup.remove_repeats(docs(spark, ODD).limit(0)).count() == 0


def test_substring_dedup_of_repeated_rows_and_missing_ids(spark):
    rng = random.Random(10)
    passage = " ".join(f"p{i}" for i in range(25))
    fresh = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(10))
    one, two = f"{fresh()} {passage}", f"{fresh()} {passage}"
    rows = [(None, one), (None, two), (None, one), (5, one), (5, one), (6, two)]
    got = sorted((repr(r.doc_id), r.n_removed) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect())
    # of the two texts without an id one comes first and loses nothing, in both of its rows if it has two
    lost = [n for i, n in got if i == "None"]
    assert sorted(lost) in ([0, 0, 25], [0, 25, 25])
    assert [(i, n) for i, n in got if i != "None"] == [("5", 35), ("5", 35), ("6", 35)]


def test_substring_dedup_removes_no_word_by_its_hash(spark):
    """Thue-Morse words and their complements have one polynomial hash modulo 2**64 under any odd base."""
    for bits in (7, 11):
        word = "".join("ab"[i.bit_count() % 2] for i in range(1 << bits))
        other = word.translate(str.maketrans("ab", "ba"))
        shared = " ".join(f"w{i}" for i in range(19))
        rows = [(1, f"{shared} {word}"), (2, f"{shared} {other}"), (3, f"{shared} {other}")]
        got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
        assert got == {1: 0, 2: 0, 3: 20}


def test_a_misrouted_copy_keeps_its_words():
    """Where hashes route a span to a reference that differs in a word, no window of it goes."""
    letters = list("abcdefghijklmnopqrstuvwxyz")
    other = letters[:12] + ["X"] + letters[13:]
    rows = [(1, k, 0, 0, 0, kind, " ".join(w).encode()) for k, (kind, w) in enumerate([(substring_dedup.REFERENCE, letters), (substring_dedup.COPY, other), (substring_dedup.COPY, letters)])]
    out = [tuple(r.values()) for b in substring_dedup._compared(20)(iter([substring_dedup._batch(rows, substring_dedup._TEXTS)])) for r in b.to_pylist()]
    assert out == [(2, 0, 0, 0, 7)]


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_classifier.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    x = [(r.score, r.quality) for r in out.join(labels, "doc_id").where("held_out").collect()]
    good, bad = [s for s, q in x if q == 1], [s for s, q in x if q == 0]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98
    odd = quality_classifier.classify(docs(spark, ODD), labels.limit(0)).collect()
    assert len(odd) == len(ODD) and all(r.score == 0.5 for r in odd)


def test_classifier_equals_plain_densities(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["the", "of", "Ab", "x1", "%%", "lorem", f"w{rng.randint(0, 50)}"][i % 2 :]) for _ in range(rng.randint(0, 80)))) for i in range(200)]
    labels = [(i, i % 2) for i in range(180)]
    got = {r.doc_id: r for r in quality_classifier.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = quality_classifier.features_of([t.encode() for _, t in rows])
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows]
    own = {c: np.array([x[i] for i, q in labels if q == c and not held[i]]) for c in (0, 1)}
    n = {c: len(v) for c, v in own.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in own.items()}
    pooled = sum(n[c] * cov[c] for c in own) / sum(n.values())
    d, scale = x.shape[1], np.sqrt(np.diag(pooled) + 1e-9)
    log = []
    for c in (0, 1):
        m = (1 - quality_classifier.TO_POOLED) * cov[c] / np.outer(scale, scale) + quality_classifier.TO_POOLED * pooled / np.outer(scale, scale)
        m = (1 - quality_classifier.TO_SPHERE) * m + quality_classifier.TO_SPHERE * max(np.trace(m) / d, 1e-6) * np.eye(d)
        far = (x - own[c].mean(0)) / scale
        log.append(np.log(n[c]) - 0.5 * np.linalg.slogdet(m)[1] - 0.5 * np.einsum("ij,jk,ik->i", far, np.linalg.inv(m), far))
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
    assert all(abs(got[i].score - want[i]) < 1e-6 and got[i].held_out == held[i] and got[i].predicted == (want[i] >= 0.7) for i in got)
    assert quality_classifier.classify(docs(spark, rows).limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_chat_of_missing_ids_and_repeated_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (1, None, "assistant", None), (1, 2, "assistant", "x" * 100_000)]
    out = {r.conv_id: r for r in chat_format.digest_conversations(chat_format.format_turns(spark.createDataFrame(rows, schema))).collect()}
    assert out[None].n_turns == 2 and out[1].loss_chars == 100_000
    assert chat_format.digest_conversations(chat_format.format_turns(spark.createDataFrame([], schema))).count() == 0


def test_empty_tables(spark):
    none = docs(spark, ODD).limit(0)
    tokenizers = pytest.importorskip("public_tokenizers")
    assert license_scan.report(license_scan.scan_licenses(none)).count() == 0
    assert token_count.count_tokens(none, tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), url_filter.rule_table(spark)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(7)
    pieces = ["\\", "#", "<", "### ", "</turn>", " ", "\n", "User: ", "a", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b\\", "=x", None]), None if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for c in range(60) for t in range(4)]
    out = chat_format.digest_conversations(chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 formatted"))).collect()
    for r in out:
        own = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == 4 and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert len(out) == 60


def test_token_counts_of_code_and_of_every_joined_pair():
    """Texts are cut only where no piece has both characters: all pairs that pieces have, underscores, source code, random texts."""
    tokenizers, sentencepiece = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    file = tokenizers.path("piece_bpe_32k.model")
    with open(file, "rb") as f:
        counter = token_count.Counter(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=file)
    rng = random.Random(1)
    pieces, alphabet = list(counter.rank), "ab_ (){}[]*->.,;:#\n\t\"'/=+<>!?%&|\\é ß日本0129▁~`^@$"
    with open(brute.__file__) as f, open(token_count.__file__) as g:
        texts = [f.read(), g.read(), "snake_(x)", "__init__(self)", "x = my_*y", "_{i}", "foo_[0]", " a  b   c\n\n\t x", "▁x ▁ y", "_" * 3000, "-" * 3000]
    texts += [a + b for a, b in counter.joined] + [f"x{a}{b}_" for a, b in counter.joined]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(10_000)]
    texts += ["".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randint(1, 6))) for _ in range(10_000)]
    assert [t for t in texts if counter.count(t) != len(library.encode(t))] == []


@pytest.mark.parametrize("block", [1 << 20, 1500, 1])
def test_decontamination_of_a_large_benchmark_with_clashing_columns(spark, block):
    """Broadcast benchmark; too large, but few of its windows occur; more occur than may be broadcast: one result."""
    bench = [(i, " ".join(f"q{i}x{k}" for k in range(40))) for i in range(20)] + [(100 + i, "short and hot item") for i in range(30)]
    copy = "a short and hot item of many copies, see " + bench[3][1][:90]
    rows = [(i, copy) for i in range(40)] + [(50, "nothing of it")] + [(None, None), (51, None), (52, ""), (53, bench[4][1].upper())] * 2
    clashes = ["1 _found_spans", "2 _found_ids", "3 found_spans", "4 found_ids", "5 slot", "6 text_key", "7 n_words", "8 spans", "9 item_ids", "10 text_bytes"]
    df = spark.createDataFrame(rows, DOCS).repartition(3).selectExpr("*", *clashes)
    b = spark.createDataFrame(bench, "item_id long, text string")
    left = decontaminate.decontaminate(df, b, block_bytes=block)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(["50", *["None", "51", "52"] * 2])
    cut = decontaminate.remove_spans(df, b, block_bytes=block)
    assert cut.columns == df.columns and {r.text for r in cut.collect() if r.doc_id == 53} == {""}
    found = {(r.doc_id, r.n_words): r for r in decontaminate.scan(df, b, block_bytes=block).collect()}
    assert len(found[0, found_words := len(brute.tokens(copy))].item_ids) == 31 and found_words > 20
    assert found[53, 40].item_ids == ["4"] and [tuple(s) for s in found[53, 40].spans] == [(0, 40)]


def test_windows_of_many_equal_items_take_linear_time():
    began = __import__("time").time()
    windows = decontaminate.WindowSet([(str(i), b"one two three four") for i in range(200_000)], 13)
    assert len(windows.items) == 1 and len(windows.items[b"one two three four"]) == 200_000
    assert __import__("time").time() - began < 20


def test_urls_of_very_long_hosts_and_paths(spark):
    host = "x." * 100_000 + "Example.net"
    rows = [(1, f"http://{host}/en/a"), (2, f"http://{host}/fr/" + "y/" * 100_000), (3, "http://" + "a" * 300_000 + ".org/fr/"), (4, "http://.../"), (5, "http://org/fr/")] * 2
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_table(spark)).collect()}
    assert [got[i].rule for i in range(1, 6)] == ["example.net/en/", "net/", "org/fr/", None, "org/fr/"]
    assert got[1].host == host.lower() and got[2].verdict == "block" and got[4].host == "..."
    assert url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_table(spark).limit(0)).where("rule is not null").count() == 0

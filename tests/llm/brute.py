"""Plain, slow versions of the corpus operators."""

import collections
import math
import re

import xxhash

from waymark.llm import quality_rules

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def unite(n, linked):
    """Labels of 0 to n-1: the least number that links reach."""
    label = list(range(n))
    for a in range(n):
        for b in range(a):
            if label[a] != label[b] and linked(a, b):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


def similar(texts):
    sets = [shingles(t) for t in texts]
    return unite(len(texts), lambda a, b: sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])))


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def without_repeats(rows, size=20):
    """(words, words removed, words kept) of rows (id, text), which must be in order."""
    first, out = set(), []
    for _, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            if x in first:
                gone |= set(range(k, k + size))
            first.add(x)
        out.append((len(w), len(gone), " ".join(y for k, y in enumerate(w) if k not in gone)))
    return out


def hits(text, items, n=13):
    """Words hit and items found, of items (id, text)."""
    w, hit, ids = tokens(text), set(), set()
    for item, other in items:
        iw = tokens(other)
        k = min(n, len(iw))
        wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw else set()
        for i in range(len(w) - k + 1) if iw else ():
            if tuple(w[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                ids.add(str(item))
    return hit, ids


def _far(counts, shares):
    if not sum(counts):
        return None
    p, q = [c / sum(counts) for c in counts], [x / sum(shares) for x in shares]
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x > 0)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def quality(text, lang):
    """(base counts, base_failed, kept)"""
    t = text or ""
    w = words(t)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    repeat = len({k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)})
    lines = [x for x in t.split("\n") if words(x)]
    base = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat)
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)

    def kind(ch):
        if ch in " \t\n\x0b\x0c\r":
            return 3
        if ch in "#*$%&|<>":
            return 4
        if ch in ".,;:!?'\"()-":
            return 5
        return 0 if ch.islower() or ch.isalpha() and not ch.isupper() else 1 if ch.isupper() else 2 if ch.isdigit() else 6

    n = collections.Counter(map(kind, t))
    classes = [n[k] for k in range(7)]
    known = quality_rules.COMMON_WORDS
    far = [_far(classes, quality_rules.CLASS_SHARES[x]) for x in ([lang] if lang in known else known)]
    out = bool(t) and base[1] >= 200 and min(far) > quality_rules.MAX_CLASS_DISTANCE
    if lang in known and len(w) >= 100:
        listed = {x.split()[0]: int(x.split()[1]) / 1000 for x in known[lang].split(", ")}
        bare = [(x[:-1] if x[-1] in ".,;:!?" else x) for x in w]
        found = collections.Counter(x.lower() for x in bare if x.lower() in listed and x in (x.lower(), x.upper(), x.capitalize()))
        counts = [*(found[x] for x in listed), len(w) - sum(found.values())]
        shares = [*listed.values(), 1 - sum(listed.values())]
        out = out or _far(counts, shares) > quality_rules.MAX_WORD_PART * _far([0] * len(listed) + [1], shares)
    return *base, failed, not failed and not out


def pack(pieces, capacity, slots):
    """Bins and slots of pieces (n, source, cluster), in the order given: the tightest compatible bin, of equals the first."""
    bins, out = [], []  # room, sources, clusters
    for n, source, cluster in pieces:
        fit = [(room, i) for i, (room, sources, clusters) in enumerate(bins) if room >= n and len(sources[source]) < slots and cluster not in clusters]
        if not fit:
            bins.append((capacity, collections.defaultdict(set), set()))
        room, i = min(fit) if fit else (capacity, len(bins) - 1)
        slot = min(set(range(slots)) - bins[i][1][source])
        bins[i][1][source].add(slot)
        if cluster is not None:
            bins[i][2].add(cluster)
        bins[i] = (room - n, *bins[i][1:])
        out.append((i, slot))
    return out

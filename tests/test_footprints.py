"""Polygon overlap against sampling and known areas, fusion of footprints, clipping to a box."""

import math
import random

from pyspark.sql import functions as F

from waymark.operators import footprints

K = 1 / 110540.0


def box(y, x, h, w):
    return [{"lat": a * K, "lng": b / 111320.0} for a, b in ((y, x), (y, x + w), (y + h, x + w), (y + h, x))]


def near(a, b, tolerance=1e-6):
    return abs(a - b) <= tolerance * max(1, abs(b))


def test_areas_of_boxes_stars_and_unions():
    both, either = footprints.areas([box(0, 0, 10, 10)], [box(5, 5, 10, 10)])
    assert near(both, 25) and near(either, 175)
    assert footprints.areas([box(0, 0, 10, 10)], [box(20, 20, 1, 1)])[0] == 0 and footprints.areas(None, [[]]) == (0.0, 0.0)
    both, either = footprints.areas([box(0, 0, 10, 10), box(0, 5, 10, 10)], [box(0, 0, 10, 15)])  # overlapping rings are one area
    assert near(both, 150) and near(either, 150)
    rng = random.Random(1)
    for _ in range(5):
        ring = lambda: [{"lat": (50 + (r := rng.uniform(10, 50)) * math.sin(t)) * K, "lng": (50 + r * math.cos(t)) / 111320.0} for t in sorted(rng.uniform(0, 2 * math.pi) for _ in range(9))]
        a, b = ring(), ring()

        def inside(ring, y, x):
            odd = False
            for p, q in zip(ring, ring[1:] + ring[:1]):
                py, px, qy, qx = p["lat"] / K, p["lng"] * 111320, q["lat"] / K, q["lng"] * 111320
                if (py > y) != (qy > y) and x < (qx - px) * (y - py) / (qy - py) + px:
                    odd = not odd
            return odd

        both, either = footprints.areas([a], [b])
        hits = [(inside(a, y := rng.uniform(0, 100), x := rng.uniform(0, 100)), inside(b, y, x)) for _ in range(20_000)]
        assert abs(both - 1e4 * sum(p and q for p, q in hits) / 2e4) < 150 and abs(either - 1e4 * sum(p or q for p, q in hits) / 2e4) < 150


def test_fusion_of_sources(spark):
    rows = [
        (1, 1, "osm", 40, [box(0, 0, 10, 10)]),
        (1, 2, "osm", 40, [box(0, 8, 10, 10)]),  # one footprint with the first: 18 m wide
        (1, 3, "survey", 25, [box(0, 0, 10, 17)]),  # agrees
        (1, 4, "photo", 10, [box(0, 15, 10, 30)]),  # dissents
        (1, 5, "other", 15, [box(500, 0, 10, 10)]),  # nowhere near
        (1, 6, "none", None, [box(0, 0, 10, 18)]),
        (2, 7, "a", 10, [box(0, 0, 10, 10)]),
        (2, 8, "b", 10, [box(0, 6, 10, 10)]),  # equal standing, no agreement
        (3, 9, "a", 5, None),
        (4, 10, "a", 5, [box(0, 0, 1, 1)]),
    ]
    df = spark.createDataFrame(rows + rows[:1], f"feature long, id long, source string, weight long, rings {footprints.RINGS}")
    got = {r.feature: r for r in footprints.fused(df).collect()}
    assert got.keys() == {1, 2, 4}
    assert (got[1].anchor, got[1].score, got[1].sources, got[1].conflict, got[1].unclustered) == (1, 65, ["osm", "survey"], False, 1)
    assert [(d.source, d.iou) for d in got[1].dissent] == [("photo", round(30 / 450, 3))]
    assert (got[2].anchor, got[2].score, got[2].sources, got[2].conflict) == (7, 10, ["a"], True)
    assert got[4].score == 5 and footprints.fused(df.limit(0)).count() == 0


def test_clipping_equals_plain_passes(spark):
    rng = random.Random(2)
    rings = [[{"lat": rng.uniform(-2, 3), "lng": rng.uniform(-2, 3)} for _ in range(rng.choice([2, 3, 5, 9]))] for _ in range(60)] + [[], None, [{"lat": 9.0, "lng": 9.0}] * 4]
    rings += [r + r[:1] for r in rings[:20]]

    def plain(ring):
        if ring is None or len(ring) < 3:
            return ring and [(p["lat"], p["lng"]) for p in ring] if ring else ring
        out = [(p["lat"], p["lng"]) for p in ring]
        if out[0] == out[-1]:
            out.pop()
        for axis, v, sign in ((1, 0.0, 1), (1, 1.0, -1), (0, 0.0, 1), (0, 1.0, -1)):
            held, inside = [], lambda p, axis=axis, v=v, sign=sign: sign * (p[axis] - v) >= 0
            for i, p in enumerate(out):
                q = out[i - 1]
                if inside(p) != inside(q):
                    t = (v - q[axis]) / (p[axis] - q[axis])
                    c = [q[0] + (p[0] - q[0]) * t, q[1] + (p[1] - q[1]) * t]
                    c[axis] = v
                    held.append(tuple(c))
                if inside(p):
                    held.append(p)
            out = held
        return [*out, out[0]] if len(out) >= 3 else []

    df = spark.createDataFrame(list(enumerate(rings)), "id long, ring array<struct<lat:double,lng:double>>")
    got = {r.id: r.c for r in df.select("id", footprints.clip(F.col("ring"), 0.0, 0.0, 1.0, 1.0).alias("c")).collect()}
    for i, ring in enumerate(rings):
        want = plain(ring)
        assert (got[i] is None) == (want is None) and len(got[i] or []) == len(want or [])
        assert all(math.dist((p.lat, p.lng), q) < 1e-9 for p, q in zip(got[i] or [], want or []))


def test_segments_equal_plain_pass(spark):
    rng = random.Random(3)
    lines = [[{"x": rng.choice([0.0, rng.uniform(0, 50)]), "y": rng.uniform(0, 50), "z": rng.choice([0.0, 0.0, rng.uniform(-6, 6)])} for _ in range(rng.randint(0, 14))] for _ in range(60)]
    lines += [[{"x": float(i), "y": float(i * i % 7), "z": 0.0} for i in range(9)], [{"x": 1.0, "y": 1.0, "z": 0.0}] * 3, None]

    def plain(line):
        kinds, acc, at = [], 0.0, [0.0]
        for a, b in zip(line, line[1:]):
            at.append(at[-1] + math.hypot(b["x"] - a["x"], b["y"] - a["y"]))
        for i in range(len(line) - 1):
            a, b = line[i], line[i + 1]
            run = at[i + 1] - at[i]
            slope = (b["z"] - a["z"]) / run if run > 1e-9 else 0
            kind = "climb" if slope > 0.08 else "drop" if slope < -0.08 else "flat"
            if i:
                o = line[i - 1]
                d = math.degrees(math.atan2(b["y"] - a["y"], b["x"] - a["x"]) - math.atan2(a["y"] - o["y"], a["x"] - o["x"]))
                d = 180 - (180 - d) % 360  # above -180, up to 180
                if abs(d) > 1e-9:
                    acc = d if acc and (d > 0) != (acc > 0) else acc + d
                if kind == "flat" and abs(acc) > 30:
                    kind, acc = "turn-left" if acc > 0 else "turn-right", 0.0
            if kinds and kinds[-1][0] == kind:
                kinds[-1][2] = at[i + 1]
            else:
                kinds.append([kind, at[i], at[i + 1]])
        return [(k, round(a, 6), round(b, 6)) for k, a, b in kinds]

    df = spark.createDataFrame(list(enumerate(lines)), "id long, line array<struct<x:double,y:double,z:double>>")
    got = {}
    for r in lines_of(df):
        got.setdefault(r.id, []).append((r.kind, round(r.from_m, 6), round(r.to_m, 6)))
    assert got == {i: w for i, line in enumerate(lines) if line and (w := plain(line))}


def lines_of(df):
    from waymark.operators import lines

    return lines.segmented(df, "id", "line").orderBy("id", "nth").collect()

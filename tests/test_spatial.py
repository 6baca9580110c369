"""Boxes, nearest places at any distance, the date line, verdicts on fixes, all against plain Python with odd rows."""

import math
import random

from waymark.operators import graph, ops, spatial
from waymark.operators import venues as U

NAN, INF = float("nan"), float("inf")


def test_points_meet_boxes_of_any_size(spark):
    rng = random.Random(1)
    boxes = []
    for i in range(150):
        y, x, h, w = rng.uniform(-80, 80), rng.uniform(-170, 170), 10 ** rng.uniform(-6, 1.2), 10 ** rng.uniform(-6, 1.5)
        boxes.append((i, y, y + h, x, x + w))
    boxes += [(200, 0.0, 0.0, 0.0, 0.0), (201, None, 1.0, 0.0, 1.0), (202, -90.0, 90.0, -180.0, 180.0), boxes[0]]
    points = [(i, rng.uniform(-80, 80), rng.uniform(-170, 170)) for i in range(150)]
    points += [(300 + b[0], b[1], b[3]) for b in boxes if b[1] is not None] + [(900, None, 1.0), (901, NAN, 0.0), (902, 0.0, 0.0)]
    df = spark.createDataFrame(points, "id long, lat double, lng double").selectExpr("*", "1 level", "2 cell_lat")
    bs = spark.createDataFrame(boxes, "box long, south double, north double, west double, east double")
    got = spatial.in_boxes(df, bs, spatial.F.struct("south", "north", "west", "east"))
    assert set(df.columns) < set(got.columns)
    inside = lambda p, b: None not in (*p, *b) and b[1] <= p[1] <= b[2] and b[3] <= p[2] <= b[4]
    assert sorted((r.id, r.box) for r in got.collect()) == sorted((p[0], b[0]) for p in points for b in boxes if inside(p, b))


def test_nearest_at_any_distance(spark):
    rng = random.Random(2)
    places = [(i, *rng.choice([(rng.uniform(-89, 89), rng.uniform(-180, 180)), (40 + rng.gauss(0, 0.01), -84 + rng.gauss(0, 0.01))])) for i in range(400)]
    places += [(999, *places[3][1:]), (1000, None, 1.0), (1001, NAN, 1.0)]
    points = [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(200)] + [(40 + rng.gauss(0, 0.01), -84 + rng.gauss(0, 0.01)) for _ in range(100)]
    points += [(0.0, 179.9999), (0.0, -180.0), (90.0, 0.0), (-90.0, 10.0), places[3][1:], (None, 0.0), (0.0, NAN), (INF, 0.0)]
    got = spatial.nearest_anywhere(spark.createDataFrame(points, "lat double, lng double"), spark.createDataFrame(places, "place long, r_lat double, r_lng double"))

    def metres(p, q):
        turn = min((q[1] - p[1] + k for k in (-360, 0, 360)), key=abs)
        return math.hypot((q[0] - p[0]) * 110540.0, turn * 111320.0 * math.cos(math.radians(p[0])))

    located = {p for p in points if None not in p and all(map(math.isfinite, p))}
    rows = {(r.lat, r.lng): r for r in got.collect()}
    assert rows.keys() == located
    for p, r in rows.items():
        far = {i: metres(p, q) for i, *q in places if None not in q and math.isfinite(q[0])}
        assert abs(r.metres - min(far.values())) < 1e-3 and far[r.place] <= min(far.values()) + 1e-3
    assert rows[places[3][1:]].place == 3


def test_ten_thousand_venues(spark):
    rng = random.Random(3)
    venues = [(i, y := rng.uniform(-60, 60), x := rng.uniform(-179, 179), y - 0.01, y + 0.01, x - 0.02, x + 0.02) for i in range(10_000)]
    points = [(i, *((v := rng.choice(venues))[1] + rng.uniform(-0.012, 0.012), v[2] + rng.uniform(-0.03, 0.03))) for i in range(60)]
    points += [(100, None, 0.0), (101, 0.0, NAN), (0, *points[0][1:])]
    names = "venue long, c_lat double, c_lng double, south double, north double, west double, east double"
    got = U.venue_of(spark.createDataFrame(points, "id long, lat double, lng double"), spark.createDataFrame(venues, names)).collect()
    assert len(got) == len(points)
    for r in got:
        if r.lat is None or not math.isfinite(r.lng):
            assert r.venue is None and r.inside is None
            continue
        far = lambda v, r=r: math.hypot(v[1] - r.lat, (v[2] - r.lng) * math.cos(math.radians(r.lat))) * 111320.0
        held = [v for v in venues if v[3] < r.lat < v[4] and v[5] < r.lng < v[6]]
        want = min(held or venues, key=lambda v: (round(far(v), 4), v[0]))
        assert (r.venue, r.inside) == (want[0], bool(held)) and abs(r.venue_metres - far(want)) < 1e-3


def test_radius_join_over_the_date_line_keeps_columns(spark):
    left = spark.createDataFrame([(1, 0.0, 179.9999, "x", 5), (2, 51.0, -179.9999, "y", 6)], "id long, lat double, lng double, band string, metres long")
    right = spark.createDataFrame([(7, 0.0, -179.9999, 1), (8, 51.0, 179.9998, 2), (9, 51.0, -179.9998, 3)], "place long, r_lat double, r_lng double, turn int")
    rows = {(r.id, r.place): r for r in ops.within(left, right, 75.0).collect()}
    assert rows.keys() == {(1, 7), (2, 8), (2, 9)} and abs(rows[1, 7].metres - 22.264) < 1e-3
    assert rows[1, 7].band == "x" and rows[1, 7].turn == 1 and rows[2, 8].r_lng == 179.9998
    assert ops.latest(left, ["id"], [ops.F.asc("lat")]).columns == left.columns


def test_verdicts_equal_plain_python(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = []
    for _ in range(1000):
        lat, lng = pick(0.5 + rng.gauss(0, 1e-4), 0.5, 2.0, 1.0, None, NAN, INF), pick(0.5 + rng.gauss(0, 1e-4), 0.5, -INF, None)
        rows.append((pick(None, 1, 2, 3), rng.randint(0, 60), lat, lng, pick(True, False, False, None), pick(None, 5.0, 35.0, 36.0, NAN, INF)))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "device long, seq long, lat double, lng double, manual boolean, acc double").selectExpr("*", "seq verdict").repartition(3)
    got = U.fix_verdicts(df, "device", "seq", {"south": 0.0, "north": 1.0, "west": 0.0, "east": 1.0}).collect()
    bad = lambda v: v is None or not math.isfinite(v)
    place = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)  # noqa: E731  Spark's order
    want, kept = [], {}
    for r in sorted(rows, key=lambda r: (r[1], place(r[2]), place(r[3]))):
        key, _, lat, lng, manual, acc = r
        if manual:
            why = "manual"
        elif bad(lat) or bad(lng):
            why = "invalid"
        elif not (0 < lat < 1 and 0 < lng < 1):
            why = "outside"
        elif not bad(acc) and acc > 35:
            why = "accuracy"
        elif key not in kept:
            why = "first"
        else:
            a, b = map(math.radians, (kept[key][0], lat))
            h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lng - kept[key][1]) / 2) ** 2
            why = "too-close" if 2 * 6371000 * math.asin(math.sqrt(h)) < 8 else "moved"
        if why in ("first", "moved"):
            kept[key] = lat, lng
        want.append((key, r[1], why in ("first", "moved"), why))
    assert sorted(map(repr, ((r.device, r.seq, r.keep, r.reason) for r in got))) == sorted(map(repr, want))
    assert {r.reason for r in got} == {"manual", "invalid", "outside", "accuracy", "first", "too-close", "moved"}


def test_components_leave_out_edges_with_nulls(spark):
    edges = spark.createDataFrame([(1, 2, 3), (1, None, 5), (1, 6, None), (None, 7, 8), (1, 3, 4)], "venue long, a long, b long")
    for small in (0, 1000):
        assert sorted(map(tuple, graph.components(edges, small).collect())) == [(1, 2, 2), (1, 3, 2), (1, 4, 2)]
    rng = random.Random(4)
    many = spark.createDataFrame([(rng.randint(1, 2), rng.randint(0, 200), rng.randint(0, 200)) for _ in range(180)], "venue long, a long, b long")
    assert set(map(tuple, graph.components(many, 0).collect())) == set(map(tuple, graph.components(many).collect()))


def _made_by_joins(df):
    """The most rows that any join of df's plan that ran has put out."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name:
            most = max(most, node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_crowded_places_and_positions_do_not_multiply_pairs(spark):
    rng = random.Random(5)
    spots = [(40 + i * 2e-4, -84 + j * 2e-4) for i in range(3) for j in range(3)] + [(None, 0.0), (NAN, 0.0)]
    places = [(i, *spots[i * 7 % 11]) for i in rng.sample(range(1000), 700)] + [(2000, *spots[0])] * 3 + [(None, *spots[1])]
    points = [(i % 60, *rng.choice([*spots, (40.0001, -84.0)])) for i in range(500)]
    p = spark.createDataFrame(places, "place long, r_lat double, r_lng double")
    f = spark.createDataFrame(points, "key long, lat double, lng double")

    def metres(q, r):
        far = math.hypot((r[1] - q[1]) * 110540.0, (r[2] - q[2]) * 111320.0 * math.cos(math.radians(q[1])))
        return round(far, 4)

    located = [r for r in places if r[1] is not None and math.isfinite(r[1])]
    order = lambda x: (x[0], x[1] is not None, x[1] or 0)
    first = {q: sorted(((m, r[0]) for r in located if (m := metres((0, *q), r)) < 60), key=order)[:3] for q in {q[1:] for q in points} if q[0] is not None and math.isfinite(q[0])}
    shown = lambda rows: sorted(map(str, rows))
    three = spatial.nearest_k(f, p, "key", 60.0, 3)
    assert shown((r.key, r.place, r.metres, r["rank"]) for r in three.collect()) == shown((q[0], place, m, i + 1) for q in points for i, (m, place) in enumerate(first.get(q[1:], [])))
    near = U.nearby(p, f, "key", 50.0, 4)
    want = []
    for key in {q[0] for q in points}:
        every = sorted(((m, r[0]) for q in points if q[0] == key and q[1] is not None and math.isfinite(q[1]) for r in located if (m := metres(q, r)) <= 50), key=order)[:4]
        want += [(key, place, m, i + 1) for i, (m, place) in enumerate(every)]
    assert shown((r.key, r.place, r.metres, r["rank"]) for r in near.collect()) == shown(want) and len(want) == 240
    assert _made_by_joins(three) < 2000 and _made_by_joins(near) < 2500  # 700 places and 500 points within reach would be some 200,000 pairs
    assert U.nearby(p.limit(0), f, "key", 50.0, 4).count() == 0 and spatial.nearest_k(f.limit(0), p, "key", 60.0, 3).count() == 0

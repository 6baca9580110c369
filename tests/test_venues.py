"""Boundaries, latitudes and odd rows of the operators on venues."""

import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import names as N
from waymark.operators import ops, spatial
from waymark.operators import venues as U


def metres(a, b, c, d):
    return math.hypot((c - a) * 110540.0, (d - b) * 111320.0 * math.cos(math.radians(a)))


@pytest.mark.parametrize("latitude", [0.0, 51.0, 60.0, 80.0, -89.0])
def test_radius_join_equals_brute_force_at_any_latitude(spark, latitude):
    rng = random.Random(int(latitude))
    wide = 0.002 / max(math.cos(math.radians(latitude)), 0.01)
    draw = lambda n: [(i, latitude + rng.uniform(-0.002, 0.002), rng.uniform(-wide, wide)) for i in range(n)]
    a, b = draw(120), draw(120)
    left, right = spark.createDataFrame(a, "id long, lat double, lng double"), spark.createDataFrame(b, "place long, r_lat double, r_lng double")
    got = {(r.id, r.place) for r in ops.within(left, right, 75.0).collect()}
    assert got == {(i, j) for i, y, x in a for j, v, u in b if metres(y, x, v, u) < 75.0} and got


def test_radius_is_open_or_closed(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lat double, lng double")
    right = spark.createDataFrame([(1, 50.0 / 110540.0, 0.0), (2, None, 0.0)], "place long, r_lat double, r_lng double")
    assert ops.within(left, right, 50.0).count() == 0 and ops.within(left, right, 50.0, inclusive=True).count() == 1


def test_nearest_line_at_high_latitude(spark):
    rng = random.Random(3)
    points = [(i, 60 + rng.uniform(0, 0.01), rng.uniform(0, 0.02)) for i in range(80)]
    lines = [(i, 60 + rng.uniform(0, 0.01), rng.uniform(0, 0.02)) for i in range(30)]
    parts = spark.createDataFrame([(i, 0, (y, x), (y + 0.0005, x + 0.001)) for i, y, x in lines], "way long, part int, a struct<lat:double,lng:double>, b struct<lat:double,lng:double>")
    df = spark.createDataFrame(points, "id long, lat double, lng double")
    got = {r.id: r.metres for r in spatial.nearest_line(df, parts, "id", 60.0).collect()}
    every = df.join(parts).select("id", spatial.to_segment(F.col("lat"), F.col("lng"), F.col("a"), F.col("b")).alias("m")).where("m <= 60").groupBy("id").agg(F.min("m").alias("m"))
    want = {r.id: r.m for r in every.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and want


def test_box_excludes_its_sides_and_wins_over_nearness(spark):
    venues = spark.createDataFrame([(1, 0.0, 0.0, -1.0, 1.0, -1.0, 1.0), (2, 0.9, 0.9, 0.85, 0.86, 0.8, 1.0)], "venue long, c_lat double, c_lng double, south double, north double, west double, east double")
    points = spark.createDataFrame([(1, 0.9, 0.9), (2, 1.0, 0.9), (3, None, 0.0), (4, 0.855, 0.9)], "id long, lat double, lng double")
    got = {r.id: (r.venue, r.inside) for r in U.venue_of(points, venues).collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (None, None), 4: (2, True)}
    assert U.venue_of(points, venues.limit(0)).where("venue is not null").count() == 0


def test_fix_verdicts_in_order(spark):
    step = 8.0 / 111194.9
    rows = [(1, 1, 0.1, 0.1, False, 35.0), (1, 2, 0.1, 0.1, False, 1.0), (1, 3, 0.1 + 1.01 * step, 0.1, None, None), (1, 4, 0.5, 0.1, False, 35.1), (1, 5, 1.0, 0.1, False, 1.0), (1, 6, None, 0.1, False, 1.0), (1, 7, None, 0.1, True, 99.0), (1, 8, 0.1 + 1.9 * step, 0.1, False, 1.0), (1, 9, float("nan"), 0.1, False, 1.0)]
    df = spark.createDataFrame(rows, "device long, seq long, lat double, lng double, manual boolean, acc double")
    got = {r.seq: (r.keep, r.reason) for r in U.fix_verdicts(df, "device", "seq", {"south": 0.0, "north": 1.0, "west": 0.0, "east": 1.0}).collect()}
    assert got == {1: (True, "first"), 2: (False, "too-close"), 3: (True, "moved"), 4: (False, "accuracy"), 5: (False, "outside"), 6: (False, "invalid"), 7: (False, "manual"), 8: (False, "too-close"), 9: (False, "invalid")}


def test_scores_claw_back_what_a_key_earned(spark):
    day = 86_400_000
    rows = [("p", 1, "first", "a", True, True, 0), ("p", 2, "confirm", "a", True, True, 1), ("p", 3, "live", None, True, True, 2), ("p", 4, "live", None, True, True, day), ("p", 5, "overturned", "a", False, False, day), ("p", 6, "overturned", "a", True, True, day), ("p", 7, "first", "a", True, True, day), ("q", 1, "first", "a", False, True, 0), ("q", 2, "first", "b", True, False, 0), ("q", 3, "repeat", "c", True, True, 0)]
    df = spark.createDataFrame(rows, "profile string, seq long, action string, key string, has_profile boolean, near boolean, ms long")
    got = {r.profile: (r.xp, r.reputation, r.awards, r.overturned) for r in U.scored(df).collect()}
    assert got == {"p": (9, -20, 3, 2), "q": (0, 0, 0, 0)}  # 17 + 2 + 7, less the 17 of key a


def test_rank_thresholds(spark):
    df = spark.createDataFrame([(x,) for x in (None, -5, 0, 49, 50, 249, 250, 3000, 9999)], "xp long")
    got = [(r.rank, r.next_rank, r.to_go, r.fraction) for r in U.rank_progress(df).collect()]
    assert got == [("visitor", "scout", 50, 0.0)] * 3 + [("visitor", "scout", 1, 0.98), ("scout", "ranger", 200, 0.0), ("scout", "ranger", 1, 0.995), ("ranger", "cartographer", 750, 0.0), ("steward", None, None, 1.0), ("steward", None, None, 1.0)]


def test_names_and_codes(spark):
    row = spark.sql("select 'Big Drop - Single Rider Queue' a, 'Linen Line' b, 'o0-ab1i 2c9zzz' c, cast(null as string) d")
    got = row.select(N.queue_to_ride(F.col("a")), N.queue_to_ride(F.col("b")), N.invite_code(F.col("c")), N.invite_code(F.col("d"))).first()
    assert tuple(got) == ("big drop", "linen", "AB2C9Z", "")
    ring = spark.createDataFrame([([(1.000001, 2.0), (1.000002, 2.0), (1.1, 2.0), (1.000001, 2.0)],)], "r array<struct<lat:double,lng:double>>")
    assert [p.lat for p in ring.select(N.rounded_ring(F.col("r"))).first()[0]] == [1.0, 1.1, 1.0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "place long, k string, name string")
    assert tuple(U.key_audit(none, "k").first()) == (0, 0, 0, 0)
    assert tuple(U.evidence_summary(spark.createDataFrame([], "kind string, n_claims long, published boolean, band string")).first()) == (0, 0, 0, 0, 0.0)
    assert U.scored(spark.createDataFrame([], "profile string, seq long, action string, key string, has_profile boolean, near boolean, ms long")).count() == 0

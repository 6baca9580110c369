"""Tag rules against the same rules as plain functions, and the join form against the expression form."""

import random

from pyspark.sql import functions as F

from waymark.operators import tags as T
from waymark.operators import venues as U


def has(t, key, *values):
    v = t.get(key)
    return v is not None and (not values or v in values)


PLAIN = [
    ("coaster", lambda t: (has(t, "attraction", "roller_coaster") or has(t, "roller_coaster")) and t.get("roller_coaster") != "station"),
    ("slide", lambda t: has(t, "attraction", "water_slide") or has(t, "man_made", "water_slide")),
    ("pool", lambda t: has(t, "leisure", "swimming_pool", "water_park") or has(t, "sport", "swimming")),
    ("water", lambda t: has(t, "natural", "water", "bay", "wetland") or has(t, "landuse", "reservoir", "basin") or has(t, "water")),
    ("path", lambda t: has(t, "highway", "footway", "steps") or (has(t, "man_made", "pier") and t.get("floating") != "yes") or has(t, "railway", "platform")),
    ("service", lambda t: has(t, "highway", "service")),
]
WORDS = {
    **{"attraction": ["roller_coaster", "water_slide", "x"], "roller_coaster": ["station", "track"], "man_made": ["water_slide", "pier"], "leisure": ["water_park"]},
    **{"sport": ["swimming"], "natural": ["bay", "x"], "landuse": ["basin"], "water": ["", "pond"], "highway": ["steps", "service", "motorway"], "floating": ["yes", "no"]},
    **{"railway": ["platform"], "name": ["n"], "barrier": ["gate"], "tourism": ["zoo", "camp_site"], "boundary": ["census"], "admin_level": ["8"]},
}


def test_first_rule_wins_as_expression_and_as_table(spark):
    rng = random.Random(1)
    things = [(i, {k: rng.choice([None, *WORDS[k]]) for k in rng.sample(list(WORDS), rng.randint(0, 5))}) for i in range(400)]
    things += [(900, None), (901, {})]
    df = spark.createDataFrame(things, "id long, tags map<string,string>").selectExpr("*", "1 label", "2 k").cache()
    got = {r.id: r.layer for r in df.select("id", T.first_match(F.col("tags"), T.LAYERS).alias("layer")).collect()}
    want = {i: next((label for label, test in PLAIN if test(t or {})), None) for i, t in things}
    assert got == want and set(PLAIN[i][0] for i in range(6)) <= set(want.values())
    for rules in (T.LAYERS, T.CATEGORIES, [("land", T.LANDS)]):
        table = spark.createDataFrame(T.rule_rows(rules), T.RULE_SCHEMA)
        met = {r.id: r.label for r in T.match_rows(df, "id", "tags", table).collect()}
        told = {r.id: r.x for r in df.select("id", T.first_match(F.col("tags"), rules).alias("x")).where("x is not null").collect()}
        assert met == told and met
    outlines = {r.id: r.o for r in df.select("id", T.is_outline(F.col("tags")).alias("o")).collect()}
    civic = lambda t: has(t, "boundary", "census") or has(t, "admin_level")
    assert outlines == {i: (has(t or {}, "tourism", "zoo", "camp_site") or has(t or {}, "leisure", "water_park")) and not civic(t) for i, t in things}


def test_way_attributes_and_camp_details(spark):
    rows = [
        (1, {"highway": "steps", "bridge": "viaduct", "tunnel": "no", "oneway": "1", "access": "private", "layer": "-1.9"}, 1 + 2 + 8 + 32, -1),
        (2, {"bridge": "0", "tunnel": "building_passage", "oneway": "reverse", "layer": "1e9"}, 4 + 16, 7),
        (3, {"layer": " 3 ", "oneway": "no", "access": "customers"}, 0, 3),
        (4, {"layer": "Infinity"}, 0, 0),
        (5, {"layer": "NaN", "bridge": None}, 0, 0),
        (6, {"layer": "-99"}, 0, -8),
        (7, None, 0, 0),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "id long, tags map<string,string>")
    assert [(r.id, r.flags, r.level) for r in T.way_attributes(df, "tags").orderBy("id").collect()] == [(i, f, n) for i, _, f, n in rows]
    camp = [
        ({"electricity": "yes", "power_supply": "maybe", "amperage": "50, 30 amp;30/7", "internet_access": "wlan", "maxlength": "", "length": "12.5 m", "capacity": "6 of 10"}, (True, [30, 50], True, None, 13, 610)),
        ({"power_supply": "0", "electricity": "1", "internet_access": "", "drive_through": "no", "maxlength": "200", "capacity": "0"}, (False, None, None, "back-in", None, None)),
        ({"internet_access": "no", "drive_through": "no", "pull_through": "1", "maxlength": "1.2.3"}, (None, None, False, "pull-through", None, None)),
        (None, (None,) * 6),
    ]
    told = T.camp_details(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(camp)], "id long, tags map<string,string>"), "tags").orderBy("id").collect()
    assert [(r.power, r.amps, r.wifi, r.drive, r.length, r.capacity) for r in told] == [w for _, w in camp]


def test_trace_candidates_of_odd_rows(spark):
    step = 1 / 110540
    rows = [(1, "a", 0.0, 0.0, 5.0), (2, "b", step, 0.0, None), (3, None, 0.0, 0.0, 1.0), (4, "", 0.01, 0.0, 9.0), (5, None, 0.01, 0.0, 8.0), (6, "c", None, 0.0, 1.0), (7, "d", -0.02, -0.02, 1.0)]
    segments = spark.createDataFrame(rows, "seq long, session string, mid_lat double, mid_lng double, metres double")
    vertices = spark.createDataFrame([(-0.02, -0.02), (0.0, 30 * step)], "r_lat double, r_lng double")
    got = [tuple(r) for r in U.trace_candidates(segments, vertices).collect()]
    assert [(r[2], r[4], r[5]) for r in got] == [(2, 4, ""), (2, 1, "a")] and got[1][3] == 30
    assert {r[3] for r in (tuple(x) for x in U.trace_candidates(segments, vertices.limit(0)).collect())} == {None}
    assert U.trace_candidates(segments.limit(0), vertices).count() == 0

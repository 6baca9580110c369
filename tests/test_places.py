"""Every place query against its SQL on the smallest tables, and operators against brute force."""

import random

import duckdb
import pytest

from pyspark.sql import functions as F

from waymark.operators import graph, ops
from waymark.plans import network_queries, place_queries, stream_queries, venue_queries  # noqa: F401
from waymark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rounded(row):
    return tuple(round(v, 4) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = [rounded(r) for r in cur.fetchall()]
    rows = [rounded(r) for r in got.select(*names).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_within_equals_brute_force(spark):
    rng = random.Random(5)
    a = [(i, 39.3 + rng.random() / 100, -84.2 + rng.random() / 100) for i in range(80)]
    left, right = spark.createDataFrame(a, "i int, lat double, lng double"), spark.createDataFrame(a, "j int, r_lat double, r_lng double")
    got = {(r.i, r.j) for r in ops.within(left, right, 90.0).collect()}
    every = left.crossJoin(right).withColumn("m", ops.flat_metres(left["lat"], left["lng"], right["r_lat"], right["r_lng"]))
    assert got == {(r.i, r.j) for r in every.where("m < 90").collect()} and len(got) > 80


def test_thinning_keeps_distance_to_the_last_kept_fix(spark):
    rows = [("a", k, 39.0 + k * 0.00003, -84.0) for k in range(10)]
    kept = sorted(r.seq for r in ops.thinned(spark.createDataFrame(rows, "device string, seq long, lat double, lng double"), "device", "seq", 8.0).collect())
    assert kept == [0, 3, 6, 9]


def test_best_pairs_compare_equal_names_once_and_keep_every_right_row(spark):
    left = spark.createDataFrame([(5, "x", "tin mill"), (2, "x", "tin mill"), (3, "x", None), (4, None, "tin mill"), (6, "y", "tin mill")], "l_id int, category string, l_name string")
    right = spark.createDataFrame([(7, "x", "tin mill"), (8, "x", "tin mill"), (9, "x", "mill tin old"), (1, "x", None), (10, "z", "tin mill")], "r_id int, category string, r_name string")
    got = [(r.l_id, r.r_id) for r in ops.best_pairs(left, right, "category", 0.4, 10).select("l_id", "r_id").collect()]
    assert got == [(2, 7), (2, 8), (2, 9)]
    assert ops.best_pairs(left.limit(0), right, "category", 0.4, 10).count() == 0


def test_meeting_point_of_folded_legs_equals_that_of_all_members(spark):
    legs = [("p", m, c, abs(m % 3 * 4 - c)) for m in range(9) for c in range(8)]
    every = graph.meeting_point(spark.createDataFrame(legs, "party string, member int, candidate int, metres int"))
    folded = [("p", at, c, abs(at * 4 - c), 3) for at in range(3) for c in range(8)]
    once = graph.meeting_point(spark.createDataFrame(folded, "party string, member int, candidate int, metres int, n int"), F.col("n"))
    assert [tuple(r) for r in every.collect()] == [tuple(r) for r in once.collect()]


def test_resampled_grid_of_odd_cells(spark):
    from waymark.operators import raster

    rows = [(1, r, c, float(r * 10 + c)) for r in range(4) for c in range(4)] + [(2, 0, 0, 5.0), (2, 0, 0, 7.0), (3, 0, 0, None), (3, 1, 0, float("nan"))]
    grid = spark.createDataFrame(rows, "venue long, row long, col long, z double")
    got = {(r.venue, r.row, r.col): r.z for r in raster.resampled(grid, 2, 2).collect()}
    assert got[1, 0, 0] == 5.5 and got[1, 1, 1] == 27.5 and got[2, 1, 1] == 6.0 and got[3, 0, 1] == 0.0 and len(got) == 12
    assert raster.resampled(grid.limit(0), 2, 2).count() == 0

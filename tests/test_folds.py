"""Folds on tables and on streams give the same rows; graphs and lines against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import folds, graph, matching, spatial
from waymark.streaming import stateful

SCHEMA = "device long, seq long, ms long, lat double, lng double, target string, heading double, acc double, number long"


def fixes(n=120, seed=4):
    rng, rows, at = random.Random(seed), [], {}
    for k in range(n):
        d = rng.randrange(3)
        lat, lng, ms = at.get(d, (39.0, -84.0, 0))
        lat, lng, ms = lat + rng.gauss(0, 0.00008), lng + rng.gauss(0, 0.00008), ms + rng.choice([900, 4000, 25000, 1_000_000, -500])
        at[d] = lat, lng, ms
        rows.append((d, k, ms, lat, lng, rng.choice(["a", "a", "b", None]), float(rng.randrange(360)), float(rng.randrange(1, 100)), rng.choice([k, k, max(0, k - 5), 0])))
    return rows


STEPS = {
    "thin": (folds.thin(8.0), "boolean"),
    "session": (folds.session_number(900_000), "long"),
    "newer": (folds.newer(), "boolean"),
    "first_seen": (folds.first_seen(), "boolean"),
    "rate_limit": (folds.rate_limit(60_000, 2), "boolean"),
    "send_gate": (folds.send_gate(), "string"),
    "dwell": (folds.dwell(5000, 2), "long"),
    "smooth": (folds.smooth(), "string"),
}


@pytest.mark.parametrize("name", STEPS)
def test_stream_equals_table(spark, tmp_path, name):
    step, kind = STEPS[name]
    rows = fixes()
    want = folds.fold(spark.createDataFrame(rows, SCHEMA), ["device"], ["seq"], step, "said", kind)
    for k in range(3):  # three micro-batches
        spark.createDataFrame(rows[40 * k : 40 * k + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.fold_stream(stream, ["device"], ["seq"], step, "said", kind)
    run = out.writeStream.format("memory").queryName(f"said_{name}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    got = spark.table(f"said_{name}")
    rows_of = lambda df: sorted(map(repr, map(tuple, df.select("device", "seq", "said").collect())))
    assert rows_of(got) == rows_of(want) and want.count() > 3


def test_silent_keys_start_anew(spark, tmp_path):
    batches = [[(1, 0, 100)], [(2, 1, 7200)], [(2, 2, 7300)], [(1, 3, 7400)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "device long, ms long, s long").selectExpr("device", "ms", "timestamp_seconds(s) at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("device long, ms long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.fold_stream(stream, ["device"], ["ms"], folds.session_number(1000), "said", "long", time="at", late="1 second", ttl_ms=60_000)
    numbered = out.writeStream.format("memory").queryName("anew").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    numbered.awaitTermination(100)
    assert sorted((r.device, r.ms, r.said) for r in spark.table("anew").collect()) == [(1, 0, 1), (1, 3, 1), (2, 1, 1), (2, 2, 1)]
    assert numbered.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_folds_of_odd_rows(spark):
    odd = [(None, 1, 5, None, None, None, 0.0, None, 1), (None, 1, 5, None, None, None, 0.0, None, 1), (1, 2, 5, 39.0, float("nan"), "a", 0.0, 3.0, 2)]
    df = spark.createDataFrame(odd, SCHEMA)
    assert folds.fold(df, ["device"], ["seq"], folds.thin(8.0), "k", "boolean").count() == 0
    assert folds.fold(df, ["device"], ["seq"], folds.smooth(), "k", "string").count() == 0
    assert folds.fold(df, ["device"], ["seq"], folds.first_seen(), "k", "boolean").count() == 2
    assert folds.fold(df.limit(0), ["device"], ["seq"], folds.newer(), "k", "boolean").count() == 0


def test_upsert_adds_new_keys_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        stateful.upsert(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string"), path, "id")
    stateful.upsert(spark.createDataFrame([(2, "x"), (3, "y")], "id long, v string"), path, "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


@pytest.fixture(scope="module")
def ways():
    rng = random.Random(9)
    return [(v, rng.randrange(12), rng.randrange(12), float(rng.randrange(1, 50))) for v in (1, 2) for _ in range(16)]


def test_routes_and_components_equal_brute_force(spark, ways, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame(ways, "venue long, a long, b long, metres double")
    asked = [(v, i, j) for v in (1, 2) for i in range(12) for j in range(12)]
    best = {(v, i, j): 0.0 if i == j else math.inf for v, i, j in asked}
    for v, a, b, m in ways:
        best[v, a, b] = min(best[v, a, b], m)
        best[v, b, a] = min(best[v, b, a], m)
    for v, k, i, j in itertools.product((1, 2), range(12), range(12), range(12)):
        best[v, i, j] = min(best[v, i, j], best[v, i, k] + best[v, k, j])
    there = {(v, x) for v, a, b, _ in ways for x in (a, b)}
    want = {q: m for q, m in best.items() if m < math.inf and q[:2] in there}
    got = {(r.venue, r.origin, r.target): r.metres for r in graph.routes(edges, spark.createDataFrame(asked, "venue long, origin long, target long"), task_requests=50).collect()}
    assert got == want
    labels = {(r.venue, r.node): r.component for r in graph.components(edges).collect()}
    assert labels == {(v, i): min(j for w, j in there if w == v and best[v, i, j] < math.inf) for v, i in there}


def test_simplify_keeps_shape(spark):
    line = [(39.0, -84.0 + k * 1e-5 * (1 + 0.0001 * (k % 2))) for k in range(30)] + [(39.001, -83.9997)]
    df = spark.createDataFrame([(1, line), (2, line[:2]), (3, None)], "id long, line array<struct<lat: double, lng: double>>")
    got = {r.id: r.line for r in graph.simplify(df, "line", 1.0).collect()}
    assert [tuple(p) for p in got[1]] == [line[0], line[29], line[30]] and len(got[2]) == 2 and got[3] is None


def test_nearest_line_equals_brute_force(spark):
    rng = random.Random(2)
    at = lambda: (39.0 + rng.random() / 100, -84.0 + rng.random() / 100)
    lines = spark.createDataFrame([(w, [at() for _ in range(3)]) for w in range(20)], "way long, ring array<struct<lat: double, lng: double>>")
    points = spark.createDataFrame([(i, *at()) for i in range(40)], "id long, lat double, lng double")
    parts = spatial.segments(lines, ["way"], "ring")
    got = {r.id: r.metres for r in spatial.nearest_line(points, parts, "id", 60.0).collect()}
    every = points.crossJoin(parts).withColumn("m", spatial.to_segment(F.col("lat"), F.col("lng"), F.col("a"), F.col("b"))).groupBy("id").agg(F.min("m").alias("m"))
    assert got == {r.id: r.m for r in every.where("m <= 60").collect()} and got


def test_patches_and_address_book(spark):
    book = spark.createDataFrame([(1, "Falls", None), (2, "Falls", "x"), (3, "X", None)], "key long, name string, alias string")
    got = matching.address_book(spark.createDataFrame([("falls",), ("x",), ("2",), ("none",)], "term string"), book)
    assert sorted(map(tuple, got.collect())) == [("2", 2), ("falls", 1), ("falls", 2), ("x", 3)]


def test_windows_with_watermarks(spark, tmp_path):
    rows = [(1, "a", 100), (1, "a", 160), (1, "b", 5000), (2, "a", 130), (2, "z", 90_000)]
    spark.createDataFrame(rows, "device long, id string, s long").selectExpr("device", "id", "timestamp_seconds(s) at").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("device long, id string, at timestamp").parquet(str(tmp_path / "in"))
    made = {"sessions": stateful.session_windows(source(), "device", "at"), "counts": stateful.window_counts(source(), ["device"], "at", "1 hour"), "once": stateful.distinct_stream(source(), ["device", "id"], "at")}
    for name, df in made.items():
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted((r.device, r.n) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2), (2, 1)]
    assert sorted((r.device, r.n) for r in spark.table("counts").collect()) == [(1, 1), (1, 2), (2, 1)]
    assert spark.table("once").count() == 4


def test_smoother_equals_full_matrices():
    """The same filter with its 4 x 4 matrices written out."""
    rng = np.random.default_rng(1)
    step, state = folds.smooth(), None
    lat, lng, ms, seen = 51.0, 4.0, 0, []
    filt = None
    for n in range(600):
        lat, lng, ms = lat + rng.normal(0, 1e-5), lng + rng.normal(0, 1e-5), ms + int(rng.choice([50, 1000, 5000]))
        if rng.random() < 0.02:
            lat += 0.05
        row = {"lat": lat + rng.choice([0, 0, 0, 4e-4]), "lng": lng, "ms": ms, "acc": rng.choice([None, 2.0, 9.0, 30.0, 95.0]), "manual": rng.random() < 0.01}
        state, told = step(state, row)
        acc = max(4.0, 25.0 if row["acc"] is None else row["acc"])
        put = lambda f, bad=False: f"{f['out'][0]:.6f},{f['out'][1]:.6f}{'!' if bad else ''}"

        def seed(row=row, acc=acc):
            return {"at": (row["lat"], row["lng"], 111320 * math.cos(math.radians(row["lat"]))), "x": np.zeros(4), "P": np.diag([acc**2, acc**2, 4, 4]), "ts": row["ms"], "bad": 0, "out": (row["lat"], row["lng"])}

        if row["manual"]:
            filt, want = None, f"{row['lat']:.6f},{row['lng']:.6f}"
        elif filt is None:
            filt = seed()
            want = put(filt)
        elif acc > 80 and filt["bad"] < 3:
            filt["bad"] += 1
            want = put(filt, True)
        elif (far := folds._metres(*filt["out"], row["lat"], row["lng"])) > 2500:
            filt = seed()
            want = put(filt)
        else:
            dt = max((row["ms"] - filt["ts"]) / 1000, 0.2)
            move = np.eye(4) + dt * np.eye(4, k=2)
            filt["x"], filt["P"] = move @ filt["x"], move @ filt["P"] @ move.T + np.diag([(0.6 * dt) ** 2] * 2 + [0.8 * dt] * 2)
            if far / dt > 12 and filt["bad"] < 3:
                filt["bad"] += 1
                want = put(filt, True)
            else:
                look = np.eye(2, 4)
                miss = np.array([(row["lng"] - filt["at"][1]) * filt["at"][2], (row["lat"] - filt["at"][0]) * 111320]) - filt["x"][:2]
                cov = look @ filt["P"] @ look.T + np.eye(2) * acc**2
                filt["ts"] = row["ms"]
                if miss @ np.linalg.inv(cov) @ miss > 9 and filt["bad"] < 3:
                    filt["bad"] += 1
                    want = put(filt, True)
                else:
                    gain = filt["P"] @ look.T @ np.linalg.inv(cov)
                    filt["x"], filt["P"], filt["bad"] = filt["x"] + gain @ miss, (np.eye(4) - gain @ look) @ filt["P"], 0
                    filt["out"] = (filt["at"][0] + filt["x"][1] / 111320, filt["at"][1] + filt["x"][0] / filt["at"][2])
                    want = put(filt)
        told_at, want_at = ([float(v) for v in t.rstrip("!").split(",")] for t in (told, want))
        assert told.endswith("!") == want.endswith("!") and np.allclose(told_at, want_at, atol=2e-6), n
        seen.append(told)
    assert 20 < sum(t.endswith("!") for t in seen) < 500


def test_reports_are_set_confirmed_and_taken_back(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), n, n * 60_000 + rng.randint(0, 90_000), rng.choice(["open", "down", "down", None, "x"])) for n in range(300)]
    got = folds.fold(spark.createDataFrame(rows, "ride long, seq long, ms long, status string"), ["ride"], ["seq"], folds.reports(), "does", "string").collect()
    stands, want = {}, []
    for ride, seq, ms, status in rows:
        if status is None and ride in stands:
            del stands[ride]
            want.append((seq, "clear"))
        elif status in ("open", "down") and not (ride in stands and stands[ride][0] == status and ms - stands[ride][1] < 300_000):
            stands[ride] = status, ms
            want.append((seq, "set"))
    assert sorted((r.seq, r.does) for r in got) == want

"""Files in, files out."""

import json

from pyspark.sql import functions as F

from waymark.sources import tables


def test_segments_of_geojson(spark, tmp_path):
    line = lambda pts, **p: {"type": "Feature", "properties": p, "geometry": {"type": "LineString", "coordinates": pts}}
    point = {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line([[1, 2], [3, 4], [5, 6]], venueId="v", metres=7), line([[1, 2]]), point]}))
    rows = tables.read_segments(spark, str(tmp_path)).collect()
    assert [(r.venue_id, r.session_id, r.source, r.metres, r.mid_lng, r.mid_lat) for r in rows] == [("v", None, "guest", 7.0, 3.0, 4.0)]


def test_contributions_as_array_or_envelope(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "kind": "height"}, {"id": "2"}]))
    (tmp_path / "b.json").write_text(json.dumps({"runId": "r", "contributions": [{"id": "3", "lat": 1.5}]}))
    got = tables.read_contributions(spark, str(tmp_path))
    assert sorted((r.id, r.lat) for r in got.collect()) == [("1", None), ("2", None), ("3", 1.5)]


def test_points_by_header_alias(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,Latitude,LON\n"a ""b""",39.5,-84\nbad,x,1\n')
    assert [tuple(r) for r in tables.read_points(spark, str(tmp_path)).collect()] == [(39.5, -84.0, 'a "b"')]


def test_partitions_sidecars_and_features(spark, tmp_path):
    rows = spark.createDataFrame([("v", 1, [(1.0, 2.0), (3.0, 4.0)]), ("w", 2, [(1.0, 2.0)])], "venue string, n int, line array<struct<lat: double, lng: double>>")
    path = str(tmp_path / "t")
    tables.overwrite_partitions(rows.drop("line"), path, "venue")
    tables.overwrite_partitions(rows.drop("line").where("n = 2").withColumn("n", F.lit(9)), path, "venue")
    assert sorted((r.venue, r.n) for r in spark.read.parquet(path).collect()) == [("v", 1), ("w", 9)]
    tables.append_log(rows.drop("line"), path + "_log")
    tables.append_log(rows.drop("line"), path + "_log")
    assert spark.read.parquet(path + "_log").count() == 4
    tables.write_sidecar(rows.drop("line"), path + "_side", "n")
    assert [r.n for r in spark.read.json(path + "_side").collect()] == [2]
    tables.write_features(rows, path + "_geo", "venue", "line", "n")
    shapes = {json.loads(r.value)["geometry"]["type"] for r in spark.read.text(path + "_geo").collect()}
    assert shapes == {"LineString", "Point"}


def test_manifest_and_plan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("1")
    (tmp_path / "a" / "y").write_text("2")
    held = tables.manifest(spark, str(tmp_path / "a"))
    wanted = held.where("path like '%x'").withColumn("sha256", F.lit("other"))
    assert {r.path[-1]: r.action for r in tables.bundle_plan(held, wanted).collect()} == {"x": "fetch", "y": "drop"}
    assert tables.exists(spark, str(tmp_path / "a")) and not tables.exists(spark, str(tmp_path / "b"))


def test_bounds_reach_the_scan(spark, tmp_path):
    spark.sql("select named_struct('xmin', 1.0D, 'xmax', 2.0D, 'ymin', 1.0D, 'ymax', 2.0D) bbox, 1 id").write.parquet(str(tmp_path / "b"))
    found = tables.in_bounds(spark.read.parquet(str(tmp_path / "b")), 0, 0, 3, 3).select("id")
    assert found.count() == 1 and "PushedFilters: [IsNotNull(bbox" in found._jdf.queryExecution().toString()

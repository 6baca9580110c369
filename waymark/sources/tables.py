"""Readers and writers: JSON, GeoJSON and delimited files, JDBC, logs, partitions, sidecars, caches, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ops import W, latest, newest

CONTRIBUTION = "id string, author_id string, venue_id string, place_id string, kind string, status string, payload string, lat double, lng double, created_at timestamp, resolved_at timestamp"
GEOJSON = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
LINE = "array<array<double>>"
#: Header names that mean latitude and longitude.
ALIASES = {"lat": ["lat", "latitude", "y"], "lng": ["lng", "lon", "long", "longitude", "x"]}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_contributions(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that hold an array of contributions, or an envelope with one in `contributions`."""
    rows = spark.read.schema(f"contributions array<struct<{_fields(CONTRIBUTION)}>>, {CONTRIBUTION}").json(path, multiLine=True)
    own = F.struct(*[F.col(c.split()[0]) for c in CONTRIBUTION.split(", ")])
    return rows.select(F.explode(F.coalesce("contributions", F.array(own))).alias("c")).select("c.*").where("id is not null")


def _fields(ddl: str) -> str:
    return ", ".join(":".join(f.split(" ", 1)) for f in ddl.split(", "))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table by JDBC with the time of reading; with a numeric key it is read in parts."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load().withColumn("_ingested_at", F.current_timestamp())


def read_segments(spark: SparkSession, path: str, source: str = "guest") -> DataFrame:
    """Lines of two points or more of GeoJSON collections: venue, session, source, metres, middle point, the line as JSON."""
    feature = spark.read.schema(GEOJSON).json(path, multiLine=True).select(F.explode("features").alias("f"))
    prop = lambda name: F.element_at("f.properties", name)
    lines = feature.where("f.geometry.type = 'LineString'").select(prop("venueId").alias("venue_id"), prop("sessionId").alias("session_id"), F.coalesce(prop("source"), F.lit(source)).alias("source"), prop("metres").cast("double").alias("metres"), F.col("f.geometry.coordinates").alias("line_json"))
    points = F.from_json("line_json", LINE)
    middle = F.get(points, F.floor(F.size(points) / 2).cast("int"))
    return lines.where(F.size(points) >= 2).select("venue_id", "session_id", "source", "metres", F.get(middle, F.lit(0)).alias("mid_lng"), F.get(middle, F.lit(1)).alias("mid_lat"), "line_json")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files with a header; lat and lng by any of their usual names, other columns as text."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    by_lower = {c.lower(): c for c in rows.columns}
    found = {k: next((by_lower[n] for n in names if n in by_lower), None) for k, names in ALIASES.items()}
    if None in found.values():
        raise ValueError(f"no latitude or longitude among {rows.columns}")
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in found.values()]
    return rows.select(*[F.expr(f"try_cast(`{c}` as double)").alias(k) for k, c in found.items()], *rest).where("lat is not null and lng is not null")


def in_bounds(buildings: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows whose struct `bbox` meets the bounds; the comparisons reach the Parquet scan."""
    return buildings.where((F.col("bbox.xmin") <= east) & (F.col("bbox.xmax") >= west) & (F.col("bbox.ymin") <= north) & (F.col("bbox.ymax") >= south))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that df has and leaves all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_sidecar(df: DataFrame, path: str, order: str) -> None:
    """The newest row as one JSON object."""
    df.orderBy(F.desc(order)).limit(1).write.mode("overwrite").json(path)


def feature(line: str, *properties: str) -> Column:
    """A row's GeoJSON feature as text: a line of two points or more, else a point."""
    flat = F.transform(line, lambda p: F.array(p["lng"], p["lat"]))
    shape = lambda kind, x: F.to_json(F.struct(F.lit(kind).alias("type"), x.alias("coordinates")))
    shaped = F.when(F.size(line) >= 2, shape("LineString", flat)).otherwise(shape("Point", F.get(flat, F.lit(0))))
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), shaped, F.lit("}"))


def write_features(df: DataFrame, path: str, layer: str, line: str, *properties: str) -> None:
    """Features line by line, a folder a layer."""
    df.select(layer, feature(line, *properties).alias("value")).write.mode("overwrite").partitionBy(layer).text(path)


def cache_key(prompt: Column, model: Column) -> Column:
    return F.sha2(F.concat(prompt, model), 256)


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (prompt, model) that the cache (key) lacks, once each."""
    return requests.withColumn("key", cache_key(F.col("prompt"), F.col("model"))).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def retained(log: DataFrame, key: str, at_ms: str, now_ms: int, most: int = 500, max_age_ms: int = 90 * 86_400_000, tie: str | None = None) -> DataFrame:
    """The newest rows of each key that are young enough; of equal times those last in `tie`, if it is given, else any."""
    order = [F.desc(at_ms)] if tie is None else [F.desc(at_ms), F.desc(tie)]
    return newest(log.where(now_ms - F.col(at_ms) <= max_age_ms), [key], order, most)


def after_cursor(log: DataFrame, cursors: DataFrame, key: str, number: str) -> DataFrame:
    """Rows numbered above their key's cursor (key, cursor); keys without one start at the beginning."""
    return log.join(cursors, key, "left").where(F.col(number) > F.coalesce("cursor", F.lit(-1))).drop("cursor")


def numbered(log: DataFrame, key: str, at: str, start: str = "id") -> DataFrame:
    return log.withColumn("number", F.row_number().over(W.partitionBy(key).orderBy(at, start)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def bundle_plan(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """What to do with each path of two manifests: fetch, keep or drop."""
    both = held.select("path", F.col("sha256").alias("_held")).join(wanted.select("path", F.col("sha256").alias("_wanted")), "path", "full")
    return both.select("path", F.when(F.col("_wanted").isNull(), "drop").when(F.col("_held").eqNullSafe(F.col("_wanted")), "keep").otherwise("fetch").alias("action"))

"""Rings and areas: containment joins, areas, nearest places, segments.

Defined results: rows without a position, and areas without a ring, meet nothing; repeated rows give their rows
again; ties go to the least place or area; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import LAT_METRES, LNG_METRES, cell, flat_metres
from ..runtime import materialize
from .ops import W, fresh, lng_cell, newest, within

#: Height in degrees of the smallest cells that points and boxes meet in; each level's cells are twice as high.
LEAST_CELL = 0.001
#: Children of a cell in each direction, and sides in degrees, in the search for the nearest at any distance.
SPLIT, SIDES = 8, (45.0, 45.0 / 8, 45.0 / 64, 45.0 / 512, 45.0 / 4096)


def _edges(ring: Column) -> Column:
    """Pairs of neighbouring points of a ring; the last point joins the first."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % n).alias("b")))


def in_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Even-odd test of a point and a ring (array of struct lat, lng)."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["lng"] - a["lng"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lng"]
        return F.coalesce(((a["lat"] > lat) != (b["lat"] > lat)) & (lng < at), F.lit(False))

    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Square metres, by the shoelace formula on a plane scaled at the first point."""
    x = lambda p: p["lng"] * LNG_METRES * F.cos(F.radians(F.get(ring, F.lit(0))["lat"]))
    terms = F.transform(_edges(ring), lambda e: x(e["a"]) * e["b"]["lat"] * LAT_METRES - x(e["b"]) * e["a"]["lat"] * LAT_METRES)
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def ring_bounds(ring: Column) -> Column:
    of = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    return F.struct(of(F.array_min, "lat").alias("south"), of(F.array_max, "lat").alias("north"), of(F.array_min, "lng").alias("west"), of(F.array_max, "lng").alias("east"))


def _cell_of(degrees: Column, level: Column) -> Column:
    return F.floor(degrees / (F.pow(F.lit(2.0), level) * LEAST_CELL)).cast("long")


def in_boxes(points: DataFrame, boxes: DataFrame, box: Column) -> DataFrame:
    """Pairs of points (lat, lng) and the boxes (struct south, north, west, east of `boxes`) that hold them, their sides included.

    A box lies in cells that are at least as high and wide as itself, at most four; a point looks into its cell
    of each size that some box has.  So neither the extent of a box nor the number of boxes multiplies rows.
    """
    level, x, y, bounds = fresh(points, "level", "cell_lat", "cell_lng", "bounds", beside=boxes)
    side = F.greatest(box["north"] - box["south"], box["east"] - box["west"])
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(LEAST_CELL)) / LEAST_CELL))).cast("int")
    spread = lambda lo, hi: F.explode(F.sequence(_cell_of(lo, F.col(level)), _cell_of(hi, F.col(level))))
    whole = boxes.withColumn(bounds, box).withColumn(level, size).where(side >= 0)
    b = F.col(bounds)
    levels = sorted(r[0] for r in whole.select(level).distinct().collect())  # about 20 at most
    laid = whole.withColumn(x, spread(b["south"], b["north"])).withColumn(y, spread(b["west"], b["east"]))
    placed = points.withColumn(level, F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumn(x, _cell_of(F.col("lat"), F.col(level))).withColumn(y, _cell_of(F.col("lng"), F.col(level)))
    met = placed.join(laid, [level, x, y])
    held = (F.col("lat") >= b["south"]) & (F.col("lat") <= b["north"]) & (F.col("lng") >= b["west"]) & (F.col("lng") <= b["east"])
    return met.where(held).drop(level, x, y, bounds)


def containing(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Pairs of points (lat, lng) and the areas (ring) that hold them; rows without a position or a ring meet none."""
    return in_boxes(points, areas, ring_bounds(F.col("ring"))).where(in_ring(F.col("lat"), F.col("lng"), F.col("ring")))


def nearest_anywhere(points: DataFrame, places: DataFrame, lat_metres: float = LAT_METRES) -> DataFrame:
    """lat and lng of every position of points, with the place (place, r_lat, r_lng) nearest to it and the metres, however far; of equals the least place.

    Cells that hold points are split again and again, from 45 degrees down to a hundredth of one.  Of a cell's
    places those go on into its parts that may be nearest to some position in it: whose least distance to the
    cell is no more than the greatest distance of another place.  So positions meet only the last few.
    Distances are flat, longitude scaled at the position, to 0.1 mm; longitudes go round at 180 degrees.  Rows
    without a finite position are left out.
    """
    finite = lambda a, b: ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) <= 90) & (F.abs(b) <= 180)
    of = lambda v: F.floor(v / SIDES[-1]).cast("long")
    spots = points.select("lat", "lng").where(finite("lat", "lng")).distinct()
    spots = materialize(spots.withColumns({"x": of(F.col("lat")), "y": of(F.col("lng"))}))
    rows = places.where(finite("r_lat", "r_lng")).groupBy("r_lat", "r_lng").agg(F.min("place").alias("place"))
    rows = rows.withColumn("east", F.explode(F.array(*[F.col("r_lng") + k for k in (-360.0, 0.0, 360.0)])))
    for depth, side in enumerate(SIDES):
        up = SPLIT ** (len(SIDES) - 1 - depth)
        cells = spots.select(F.floor(F.col("x") / up).alias("x"), F.floor(F.col("y") / up).alias("y")).distinct()
        if depth:
            above = rows.withColumnsRenamed({"x": "px", "y": "py"})
            met = cells.withColumns({"px": F.floor(F.col("x") / SPLIT), "py": F.floor(F.col("y") / SPLIT)}).join(above, ["px", "py"]).drop("px", "py")
        else:  # every place goes to each of the cells that hold points, of 45 at most
            world = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("x"), F.lit(j).cast("long").alias("y")) for i in range(-2, 3) for j in range(-4, 5)]))
            met = rows.withColumn("c", world).select("*", "c.x", "c.y").drop("c").join(F.broadcast(cells), ["x", "y"], "left_semi")
        south, west = F.col("x") * side, F.col("y") * side
        gap = lambda v, lo: F.greatest(F.lit(0.0), lo - v, v - lo - side)
        span = lambda v, lo: F.greatest(F.abs(v - lo), F.abs(v - lo - side))
        low, high = F.least(F.abs(south), F.abs(south + side)), F.greatest(F.abs(south), F.abs(south + side))
        narrow = F.cos(F.radians(F.least(F.lit(90.0), high)))
        wide = F.when((south <= 0) & (south + side >= 0), 1.0).otherwise(F.cos(F.radians(low)))
        far = lambda f, k: F.hypot(f(F.col("r_lat"), south) * lat_metres, f(F.col("east"), west) * LNG_METRES * k)
        bound = F.min(far(span, wide)).over(W.partitionBy("x", "y"))
        rows = met.withColumns({"least": far(gap, narrow), "bound": bound}).where(F.col("least") <= F.col("bound") + 0.001)
        rows = materialize(rows.select("x", "y", "r_lat", "east", "place"))
    metres = F.hypot((F.col("r_lat") - F.col("lat")) * lat_metres, (F.col("east") - F.col("lng")) * LNG_METRES * F.cos(F.radians("lat")))
    best = spots.join(rows, ["x", "y"]).groupBy("lat", "lng").agg(F.min(F.struct(F.round(metres, 4).alias("metres"), "place")).alias("b"))
    return best.select("lat", "lng", "b.place", "b.metres")


def smallest_area(points: DataFrame, areas: DataFrame, key: str, fallback: str) -> DataFrame:
    """Every point with the name of the smallest area that holds it, or the fallback."""
    held = containing(points.select(key, "lat", "lng"), areas.select("area", "area_name", "ring", ring_area(F.col("ring")).alias("size_of_area")))
    best = held.groupBy(key).agg(F.min_by("area_name", F.struct("size_of_area", "area")).alias("area_name"))
    return points.join(best, key, "left").withColumn("area_name", F.coalesce("area_name", F.lit(fallback)))


def segments(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Every line (array of struct lat, lng) as segments (part, a, b)."""
    pairs = F.transform(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), F.get(F.col(line), i + 1).alias("b")))
    return lines.select(*keys, F.posexplode(pairs).alias("part", "s")).select(*keys, "part", "s.a", "s.b")


def to_segment(lat: Column, lng: Column, a: Column, b: Column) -> Column:
    """Metres from a point to a segment, on a plane scaled at the point."""
    k = LNG_METRES * F.cos(F.radians(lat))
    ax, ay, bx, by = (a["lng"] - lng) * k, (a["lat"] - lat) * LAT_METRES, (b["lng"] - lng) * k, (b["lat"] - lat) * LAT_METRES
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    return F.hypot(ax + t * dx, ay + t * dy)


def nearest_line(points: DataFrame, parts: DataFrame, key: str, metres: float) -> DataFrame:
    """key and the metres to the nearest segment (way, part, a, b) within `metres`; segments meet points in cells round their bounds."""
    lat_of = lambda x: cell(x, LAT_METRES, metres * 1.01)
    lng_of = lambda x: lng_cell(x, F.col("_x"), metres)  # noqa: E731  cells of the band's own size
    spread = lambda f, k: F.sequence(f(F.least(F.col("a")[k], F.col("b")[k])) - 1, f(F.greatest(F.col("a")[k], F.col("b")[k])) + 1)
    laid = parts.withColumn("_x", F.explode(spread(lat_of, "lat"))).withColumn("_y", F.explode(spread(lng_of, "lng")))
    placed = points.select(key, "lat", "lng", lat_of(F.col("lat")).alias("_x"))
    met = placed.withColumn("_y", lng_of(F.col("lng"))).join(laid, ["_x", "_y"])
    far = met.withColumn("metres", to_segment(F.col("lat"), F.col("lng"), F.col("a"), F.col("b"))).where(F.col("metres") <= metres)
    return far.groupBy(key).agg(F.min(F.struct("metres", "way", "part")).alias("n")).select(key, "n.way", "n.part", "n.metres")


def nearest(points: DataFrame, places: DataFrame, key: str, metres: float) -> DataFrame:
    """key, place and metres of the nearest place less than `metres` away, to 0.1 mm; of equals the least place.

    Positions are searched once: places at one position give way to the least of them, and points at one
    position share its answer, so neither crowded places nor repeated fixes multiply pairs.
    """
    spots = places.groupBy("r_lat", "r_lng").agg(F.min("place").alias("place"))
    pairs = within(points.select("lat", "lng").distinct(), spots, metres)
    best = pairs.groupBy("lat", "lng").agg(F.min(F.struct(F.round("metres", 4).alias("metres"), "place")).alias("b"))
    return points.join(best, ["lat", "lng"]).select(key, "b.place", "b.metres")


def first_near(points: DataFrame, places: DataFrame, metres: float, k: int, inclusive: bool = False) -> DataFrame:
    """lat and lng of every position of points, with the k nearest places (place, r_lat, r_lng), metres to 0.1 mm and rank from 1; of equals the least place.

    Places at one position are equally far, so only the k least of them can be among the first k of any point.
    """
    spots = newest(places.select("place", "r_lat", "r_lng"), ["r_lat", "r_lng"], [F.asc("place")], k)
    near = within(points.select("lat", "lng").distinct(), spots, metres, inclusive).withColumn("metres", F.round("metres", 4))
    rank = F.row_number().over(W.partitionBy("lat", "lng").orderBy("metres", "place"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("lat", "lng", "place", "metres", "rank")


def nearest_k(points: DataFrame, places: DataFrame, key: str, metres: float, k: int) -> DataFrame:
    """The k nearest places (place, r_lat, r_lng) of each point within `metres`, numbered from 1; points at one position share them."""
    return points.join(first_near(points, places, metres, k), ["lat", "lng"]).select(key, "place", "metres", "rank")


def overlapping(boxes: DataFrame, others: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes (south, north, west, east; of others o_south ...) that overlap, once each, by the cells both cover."""

    def laid(df: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi, m: F.sequence(cell(F.col(p + lo), m, size), cell(F.col(p + hi), m, size))
        return df.withColumn("_x", F.explode(span("south", "north", LAT_METRES))).withColumn("_y", F.explode(span("west", "east", LNG_METRES)))

    first = (F.col("_x") == cell(F.greatest("south", "o_south"), LAT_METRES, size)) & (F.col("_y") == cell(F.greatest("west", "o_west"), LNG_METRES, size))
    meets = (F.col("south") <= F.col("o_north")) & (F.col("o_south") <= F.col("north")) & (F.col("west") <= F.col("o_east")) & (F.col("o_west") <= F.col("east"))
    return laid(boxes, "").join(laid(others, "o_"), ["_x", "_y"]).where(first & meets).drop("_x", "_y")


__all__ = ["containing", "first_near", "flat_metres", "in_boxes", "in_ring", "nearest", "nearest_anywhere", "nearest_k", "nearest_line", "overlapping", "ring_area", "ring_bounds", "segments", "smallest_area", "to_segment"]

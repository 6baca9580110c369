"""Footprints of things as seen by several sources: overlap of polygons, and what the sources agree on.

A footprint is a list of rings (array of array of struct lat, lng); it covers what any of its rings covers, by the
even-odd rule for each ring alone.  Areas are those of a plane scaled at the first footprint's first point.

Defined results: null and empty footprints, and rings of fewer than three points, cover nothing; candidates of a
source without a weight are left out; ties go to the least id; equal candidates count once; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import graph

AGREE = 0.5
RINGS = "array<array<struct<lat: double, lng: double>>>"


def _edges(rings, k: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x0, y0, x1, y1) with x0 < x1 of all rings, and the number of each one's ring."""
    rows, of = [], []
    for n, ring in enumerate(rings if rings is not None else []):
        at = [(p["lng"] * k * 111320.0, p["lat"] * 110540.0) for p in (ring if ring is not None else []) if p["lat"] is not None and p["lng"] is not None]
        if len(at) > 2:
            for (ax, ay), (bx, by) in zip(at, [*at[1:], at[0]], strict=True):
                if ax != bx:
                    rows.append((ax, ay, bx, by) if ax < bx else (bx, by, ax, ay))
                    of.append(n)
    return np.array(rows).reshape(-1, 4), np.array(of, int)


def _covered(mid: float, edges: np.ndarray, of: np.ndarray) -> list[tuple[float, float]]:
    """The stretches of the upright line at mid that some ring covers, united."""
    cut = (edges[:, 0] < mid) & (edges[:, 2] > mid)
    e = edges[cut]
    y = e[:, 1] + (mid - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    spans = []
    for n in np.unique(of[cut]):
        own = np.sort(y[of[cut] == n])
        spans += zip(own[0::2].tolist(), own[1::2].tolist(), strict=False)
    out: list[list[float]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def areas(a, b) -> tuple[float, float]:
    """Square metres of the intersection and of the union: exact, by slabs between all corners and crossings."""
    first = next((p for rings in (a, b) for ring in (rings if rings is not None else []) for p in (ring if ring is not None else []) if p["lat"] is not None), None)
    k = np.cos(np.radians(first["lat"])) if first else 1.0
    (ea, oa), (eb, ob) = _edges(a, k), _edges(b, k)
    e = np.concatenate((ea, eb))
    if not len(e):
        return 0.0, 0.0
    p, r = e[:, None, :2], (e[:, 2:] - e[:, :2])[:, None]
    q, s = e[None, :, :2], (e[:, 2:] - e[:, :2])[None]
    cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((q - p)[..., 0] * s[..., 1] - (q - p)[..., 1] * s[..., 0]) / cross
        u = ((q - p)[..., 0] * r[..., 1] - (q - p)[..., 1] * r[..., 0]) / cross
        hits = (p[..., 0] + t * r[..., 0])[(t > 0) & (t < 1) & (u > 0) & (u < 1)]
    stops = np.unique(np.concatenate((e[:, 0], e[:, 2], hits)))
    both = either = 0.0
    for lo, hi in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
        # within a slab no edges cross, so what is covered grows evenly and its length halfway is the mean
        sa, sb = _covered((lo + hi) / 2, ea, oa), _covered((lo + hi) / 2, eb, ob)
        own = sum(y - x for x, y in sa), sum(y - x for x, y in sb)
        common = sum(max(0.0, min(y, v) - max(x, u)) for x, y in sa for u, v in sb)
        both += (hi - lo) * common
        either += (hi - lo) * (sum(own) - common)
    return both, either


def iou(a: Column, b: Column) -> Column:
    """Area of the intersection over that of the union of two footprints; 0 where neither covers anything."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        found = [areas(x, y) for x, y in zip(left, right, strict=True)]
        return pd.Series([both / either if either > 0 else 0.0 for both, either in found], dtype=float)

    return run(a.cast(RINGS), b.cast(RINGS))


def _bounds(rings: Column) -> Column:
    points = F.flatten(F.filter(rings, lambda r: r.isNotNull()))
    of = lambda f, k: f(F.transform(points, lambda p: p[k]))
    return F.struct(of(F.array_min, "lat").alias("s"), of(F.array_max, "lat").alias("n"), of(F.array_min, "lng").alias("w"), of(F.array_max, "lng").alias("e"))


def fused(candidates: DataFrame, agree: float = AGREE) -> DataFrame:
    """feature, anchor (the id), score, sources, dissent, conflict and unclustered, from candidates (feature, id, source, weight, rings).

    Overlapping candidates of one source are one footprint, as are those that they overlap in turn.  The heaviest
    footprint is the anchor.  Another one agrees where their IoU is `agree` or more, dissents where it is less, and
    is unclustered where it is 0.  The score is what those that agree weigh together, or the anchor's own weight
    where a dissenting one weighs as much (conflict).  ids are unique within a feature; only candidates of one feature
    and source whose bounds overlap are compared.
    """
    rows = candidates.where(F.col("weight").isNotNull() & (F.size("rings") > 0)).select("feature", "id", "source", "weight", "rings")
    rows = materialize(rows.dropDuplicates(["feature", "id"]).withColumn("box", _bounds(F.col("rings"))))
    other = rows.select("feature", "source", F.col("id").alias("b"), F.col("rings").alias("o_rings"), F.col("box").alias("o_box"))
    close = (F.col("box.s") <= F.col("o_box.n")) & (F.col("o_box.s") <= F.col("box.n")) & (F.col("box.w") <= F.col("o_box.e")) & (F.col("o_box.w") <= F.col("box.e"))
    met = rows.withColumnRenamed("id", "a").join(other, ["feature", "source"]).where((F.col("a") < F.col("b")) & close)
    links = met.where(iou(F.col("rings"), F.col("o_rings")) > 0).select(F.col("feature").alias("venue"), "a", "b")
    groups = graph.components(links).toDF("feature", "id", "group_id")
    grouped = rows.join(groups, ["feature", "id"], "left").withColumn("id", F.coalesce("group_id", "id"))
    whole = materialize(grouped.groupBy("feature", "id").agg(F.first("source").alias("source"), F.first("weight").alias("weight"), F.flatten(F.collect_list("rings")).alias("rings")))
    best = whole.groupBy("feature").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("m"))
    anchor = best.select("feature", (-F.col("m.minus")).alias("id")).join(whole, ["feature", "id"])
    anchor = anchor.select("feature", F.col("id").alias("anchor"), F.col("weight").alias("top"), F.col("rings").alias("a_rings"))
    judged = whole.join(anchor, "feature").withColumn("iou", F.when(F.col("id") == F.col("anchor"), 1.0).otherwise(iou(F.col("a_rings"), F.col("rings"))))
    agrees, apart = F.col("iou") >= agree, F.col("iou") == 0
    dissents = ~agrees & ~apart
    out = judged.groupBy("feature", "anchor", "top").agg(
        F.sum(F.when(agrees, F.col("weight")).otherwise(0)).alias("agreed"),
        F.array_sort(F.collect_list(F.when(agrees, F.col("source")))).alias("sources"),
        F.sort_array(F.collect_list(F.when(dissents, F.struct("weight", "source", F.round("iou", 3).alias("iou")))), asc=False).alias("told"),
        F.coalesce(F.bool_or(dissents & (F.col("weight") >= F.col("top"))), F.lit(False)).alias("conflict"),
        F.count_if(apart).alias("unclustered"),
    )
    dissent = F.transform("told", lambda d: F.struct(d["source"].alias("source"), d["iou"].alias("iou")))
    return out.select("feature", "anchor", F.when(F.col("conflict"), F.col("top")).otherwise(F.col("agreed")).alias("score"), "sources", dissent.alias("dissent"), "conflict", "unclustered")


def clip(ring: Column, south: float, west: float, north: float, east: float) -> Column:
    """A ring (array of struct lat, lng; a repeated first point at its end counts once) cut to a box, closed; empty if nothing is left."""

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def side(points: Column, inside, meet) -> Column:
        def step(r: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                q = F.element_at(r, F.when(i == 0, F.size(r)).otherwise(i))
                kept, crossed = F.array(p), F.array(meet(q, p))
                return F.when(inside(p), F.when(inside(q), kept).otherwise(F.concat(crossed, kept))).when(inside(q), crossed).otherwise(F.slice(kept, 1, 0))

            return F.flatten(F.transform(r, one))

        return let(points, step)

    def at_lng(v: float):
        return lambda a, b: F.struct((a["lat"] + (b["lat"] - a["lat"]) * (v - a["lng"]) / (b["lng"] - a["lng"])).alias("lat"), F.lit(v).alias("lng"))

    def at_lat(v: float):
        return lambda a, b: F.struct(F.lit(v).alias("lat"), (a["lng"] + (b["lng"] - a["lng"]) * (v - a["lat"]) / (b["lat"] - a["lat"])).alias("lng"))

    typed = F.transform(ring, lambda p: F.struct(p["lat"].cast("double").alias("lat"), p["lng"].cast("double").alias("lng")))
    n = F.size(typed)
    same = (F.get(typed, F.lit(0))["lat"] == F.get(typed, n - 1)["lat"]) & (F.get(typed, F.lit(0))["lng"] == F.get(typed, n - 1)["lng"])
    out = let(typed, lambda r: F.slice(r, 1, F.when((n > 1) & same, n - 1).otherwise(n)))
    out = side(out, lambda p: p["lng"] >= west, at_lng(west))
    out = side(out, lambda p: p["lng"] <= east, at_lng(east))
    out = side(out, lambda p: p["lat"] >= south, at_lat(south))
    out = side(out, lambda p: p["lat"] <= north, at_lat(north))
    closed = let(out, lambda r: F.when(F.size(r) >= 3, F.concat(r, F.slice(r, 1, 1))).otherwise(F.slice(r, 1, 0)))
    return F.when(n >= 3, closed).otherwise(typed)



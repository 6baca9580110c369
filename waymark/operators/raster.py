"""Height grids (venue, row, col, z): sampling, slopes, hillshade, class histograms, by joins and windows on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ops import W


def bilinear(points: DataFrame, grid: DataFrame) -> DataFrame:
    """points (venue, x, y in cells) with z between the four cells round them; cells without data are left out of the mean."""
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    at = points.select("*", corner.alias("_c")).withColumn("row", F.floor("y").cast("long") + F.col("_c.i")).withColumn("col", F.floor("x").cast("long") + F.col("_c.j"))
    share = (1 - F.abs(F.col("y") - F.col("row"))) * (1 - F.abs(F.col("x") - F.col("col")))
    met = at.join(grid, ["venue", "row", "col"]).withColumn("_w", share)
    return met.groupBy(*points.columns).agg((F.sum(F.col("z") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("z"))


def gradients(grid: DataFrame, metres: float) -> DataFrame:
    """Slopes to east (dx) and north (dy) from the cells beside, or from the cell itself at an edge."""
    across, down = W.partitionBy("venue", "row").orderBy("col"), W.partitionBy("venue", "col").orderBy("row")

    def slope(window, place: str) -> Column:
        z0, z1 = F.coalesce(F.lag("z").over(window), "z"), F.coalesce(F.lead("z").over(window), "z")
        p0, p1 = F.coalesce(F.lag(place).over(window), place), F.coalesce(F.lead(place).over(window), place)
        return F.coalesce((z1 - z0) / F.nullif((p1 - p0) * metres, F.lit(0.0)), F.lit(0.0))

    return grid.withColumn("dx", slope(across, "col")).withColumn("dy", -slope(down, "row"))


def hillshade(grid: DataFrame, metres: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """How bright each cell is, 0 to 1: its normal against the light."""
    a, h = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    light = -F.col("dx") * F.sin(a) * F.cos(h) - F.col("dy") * F.cos(a) * F.cos(h) + F.sin(h)
    shade = light / F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 1)
    return gradients(grid, metres).withColumn("shade", F.greatest(F.lit(0.0), shade))


def dominant_class(cells: DataFrame, key: str) -> DataFrame:
    from .ops import dominant

    return dominant(cells, [key], "class")


def resampled(grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every venue's grid (rows and columns from 0) sampled at the centres of rows x cols cells, north first; where there is no finite height, 0.

    Venues and their extents come from the grid itself; repeated cells count as their mean.
    """
    finite = grid.where(F.col("z").isNotNull() & ~F.isnan("z") & (F.abs("z") < float("inf"))).groupBy("venue", "row", "col").agg(F.avg("z").alias("z"))
    extent = grid.groupBy("venue").agg((F.max("row") + 1).alias("high"), (F.max("col") + 1).alias("wide"))
    cells = extent.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    inside = lambda v, n: F.greatest(F.lit(0.0), F.least(n - 1.0, v))  # noqa: E731  beyond the outermost centres the nearest counts
    x = inside((F.col("col") + 0.5) / cols * F.col("wide") - 0.5, F.col("wide"))
    y = inside((F.col("row") + 0.5) / rows * F.col("high") - 0.5, F.col("high"))
    placed = cells.select("venue", F.col("row").alias("to_row"), F.col("col").alias("to_col"), x.alias("x"), y.alias("y"))
    sampled = bilinear(placed, finite).select("venue", "to_row", "to_col", "z")
    out = placed.select("venue", "to_row", "to_col").join(sampled, ["venue", "to_row", "to_col"], "left")
    return out.select("venue", F.col("to_row").alias("row"), F.col("to_col").alias("col"), F.coalesce("z", F.lit(0.0)).alias("z"))

"""Lines as sequences of climbs, drops, turns and flat stretches.

Defined results: null lines and lines of fewer than two points have no segments; repeated points make edges of no
length, which are flat; repeated rows give their segments again; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRADE, TURN = 0.08, 30.0


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def segmented(df: DataFrame, key: str, line: str, grade: float = GRADE, turn: float = TURN) -> DataFrame:
    """key, nth, kind, from_m, to_m and rise of the segments of every line (array of struct x, y, z in metres).

    An edge climbs or drops by its grade; a flat one is a turn where the headings' change, added up as long as it
    keeps its sign (edges straight on leave it), passes `turn` degrees, which sets it to nothing again.  Equal
    neighbours are one segment.  Column functions only: one fold over a line's edges.
    """
    p = F.col(line)
    edges = F.transform(
        F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))),
        lambda a, i: _let(
            F.get(p, i + 1),
            lambda b: F.struct(
                F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("run"), (b["z"] - a["z"]).alias("rise"), F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])).alias("heading")
            ),
        ),
    )
    kind_of = lambda e: F.when(e["run"] > 1e-9, F.when(e["rise"] / e["run"] > grade, "climb").when(e["rise"] / e["run"] < -grade, "drop")).otherwise(F.lit(None))

    def step(s: Column, e: Column) -> Column:
        raw = F.pmod(e["heading"] - s["heading"] + 180.0, F.lit(360.0)) - 180.0
        change = F.when(s["heading"].isNull(), 0.0).otherwise(F.when(raw == -180.0, 180.0).otherwise(raw))
        flips = (s["acc"] != 0) & (F.signum(change) != F.signum(s["acc"]))
        acc = F.when(change == 0, s["acc"]).when(flips, change).otherwise(s["acc"] + change)

        def told(acc: Column) -> Column:
            steep, turned = kind_of(e), F.abs(acc) > turn
            kind = F.coalesce(steep, F.when(turned, F.when(acc > 0, "turn-left").otherwise("turn-right")).otherwise("flat"))
            end = s["at"] + e["run"]
            edge = F.struct(kind.alias("kind"), s["at"].alias("from_m"), end.alias("to_m"), e["rise"].alias("rise"))
            return F.struct(F.when(steep.isNull() & turned, 0.0).otherwise(acc).alias("acc"), e["heading"].alias("heading"), end.alias("at"), F.concat(s["done"], F.array(edge)).alias("done"))

        return _let(acc, told)

    done = "array<struct<kind:string,from_m:double,to_m:double,rise:double>>"
    start = F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast("double").alias("heading"), F.lit(0.0).alias("at"), F.expr(f"cast(array() as {done})").alias("done"))
    numbered = df.where(F.size(p) > 1).select(F.monotonically_increasing_id().alias("row"), key, line)
    walked = numbered.select("row", key, F.posexplode(F.aggregate(edges, start, step, lambda s: s["done"])).alias("i", "e"))
    w = W.partitionBy("row").orderBy("i")
    kind = F.col("e.kind")
    parts = walked.withColumn("new", F.when(kind.eqNullSafe(F.lag(kind).over(w)), 0).otherwise(1)).withColumn("nth", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = parts.groupBy("row", key, "nth", kind.alias("kind")).agg(F.min("e.from_m").alias("from_m"), F.max("e.to_m").alias("to_m"), F.sum("e.rise").alias("rise"))
    return out.drop("row")

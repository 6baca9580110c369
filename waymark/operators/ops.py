"""Operators from DataFrame to DataFrame: filters, folds, windows, spatial joins, evidence, rules, checks.

Defined results: null keys form one key; nulls come first in an ascending order; repeated rows count each, and of
rows that an order holds equal any is first, unless the order ends in a key; rows without a position are near
nothing; an empty table gives an empty result.  Functions that filter rows or add columns keep all other columns,
those that group keep none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import LAT_METRES, LNG_METRES, cell, flat_metres, half_up, haversine, similarity
from .folds import fold, thin

EPHEMERAL = ["experience", "status", "queue_band", "ride_status"]


def fresh(df: DataFrame, *names: str, beside: DataFrame | None = None) -> list[str]:
    """The names, each with so many underscores in front that no column of df (or of beside) has it."""
    taken = {c.lower() for c in [*df.columns, *(beside.columns if beside is not None else [])]}
    return [next(n for k in range(len(taken) + 1) if (n := "_" * k + name).lower() not in taken) for name in names]


def durable_accepted(contributions: DataFrame) -> DataFrame:
    return contributions.where((F.col("status") == "accepted") & (F.length("kind") > 0) & ~F.col("kind").isin(EPHEMERAL))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return newest(df, keys, order, 1)


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order; a null key is a key, and of equals any stays unless the order ends in a key."""
    (rank,) = fresh(df, "rank_in_key")
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n).drop(rank)


def sessions(fixes: DataFrame, key: str, ms: str, seq: str, gap_ms: int) -> DataFrame:
    """Adds session: a new one where there is no fix before, time runs backwards, or the gap is gap_ms or more."""
    w = W.partitionBy(key).orderBy(seq)
    dt = F.col(ms) - F.lag(ms).over(w)
    new = F.when(dt.isNull() | (dt < 0) | (dt >= gap_ms), 1).otherwise(0)
    (begins,) = fresh(fixes, "begins")
    return fixes.withColumn(begins, new).withColumn("session", F.sum(begins).over(w.rowsBetween(W.unboundedPreceding, 0))).drop(begins)


def cell_clusters(fixes: DataFrame, size: float) -> DataFrame:
    """Rows, distinct sessions and the first sample of each grid cell."""
    placed = fixes.withColumn("cell_lat", cell(F.col("lat"), LAT_METRES, size)).withColumn("cell_lng", cell(F.col("lng"), LNG_METRES, size))
    return placed.groupBy("cell_lat", "cell_lng").agg(F.count("*").alias("n_fixes"), F.countDistinct("device", "session").alias("n_sessions"), F.min("seq").alias("sample_seq"))


def islands(df: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """Adds island: a number that grows where value changes within keys in order of seq."""
    w = W.partitionBy(*keys).orderBy(seq)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(seq).over(w).isNotNull(), 0).otherwise(1)
    (begins,) = fresh(df, "begins")
    return df.withColumn(begins, changed).withColumn("island", F.sum(begins).over(w.rowsBetween(W.unboundedPreceding, 0))).drop(begins)


def dwells(df: DataFrame, keys: list[str], seq: str, ms: str, target: str, min_ms: int, min_samples: int) -> DataFrame:
    """Stays at one target that last min_ms with min_samples fixes: the first of each target and key."""
    stays = islands(df, keys, seq, target).groupBy(*keys, "island", target).agg(F.min(ms).alias("from_ms"), F.max(ms).alias("to_ms"), F.count("*").alias("samples"))
    long = stays.where((F.col("to_ms") - F.col("from_ms") >= min_ms) & (F.col("samples") >= min_samples))
    return latest(long, [*keys, target], [F.asc("island")]).drop("island")


def monotone(df: DataFrame, key: str, arrival: str, ms: str) -> DataFrame:
    """Rows whose time is later than that of every row of the key that came before."""
    before = F.max(ms).over(W.partitionBy(key).orderBy(arrival).rowsBetween(W.unboundedPreceding, -1))
    (last,) = fresh(df, "last_before")
    return df.withColumn(last, before).where(F.col(last).isNull() | (F.col(ms) > F.col(last))).drop(last)


def rate_limited(df: DataFrame, key: str, ms: str, seq: str, window_ms: int, limit: int) -> DataFrame:
    """Rows allowed in their tumbling window: the first `limit` of the key."""
    bucket = F.floor(F.col(ms) / window_ms).cast("long")
    return newest(df.withColumn("bucket", bucket), [key, "bucket"], [F.asc(seq)], limit)


def walk_lengths(df: DataFrame, key: str, seq: str) -> DataFrame:
    w = W.partitionBy(key).orderBy(seq)
    step = haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    return df.withColumn("_m", step).groupBy(key).agg(half_up(F.coalesce(F.sum("_m"), F.lit(0.0)), 2).alias("metres"), F.count("*").alias("n_fixes"))


def lng_size(band: Column, metres: float) -> Column:
    """Side of a longitude cell, in metres at the equator, that is `metres` or more anywhere in a band of latitude.

    A band is `metres` * 1.01 high; its side follows the latitude farthest from the equator, up to 89.99 degrees.
    """
    farthest = F.greatest(F.abs(band), F.abs(band + 1)) * (metres * 1.01 / LAT_METRES)
    return F.lit(metres * 1.01) / F.cos(F.radians(F.least(farthest, F.lit(89.99))))


def lng_cell(lng: Column, band: Column, metres: float) -> Column:
    return F.floor(lng * LNG_METRES / lng_size(band, metres)).cast("long")


def within(left: DataFrame, right: DataFrame, metres: float, inclusive: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of left (lat, lng) and right (r_lat, r_lng) with equal keys less than `metres` apart (or just so far), by a join of grid cells.

    A right row is put into its own band of latitude and the two beside it, and there into its cell of that
    band's grid and the two beside it; each pair meets once.  Longitudes within reach of 180 degrees are entered
    on the other side too.  Rows without a position meet none; the distance comes in the column `metres`, which
    replaces one of that name; other columns of both sides stay.
    """
    x, y, turn = fresh(left, "band", "cell", "turn", beside=right)
    lat_of = lambda v: cell(v, LAT_METRES, metres * 1.01)
    a = left.withColumn(x, lat_of(F.col("lat"))).withColumn(y, lng_cell(F.col("lng"), F.col(x), metres))
    beside = lambda v: F.explode(F.array(*[v + k for k in (-1, 0, 1)]))
    b = right.withColumn(x, beside(lat_of(F.col("r_lat"))))
    reach = lng_size(F.col(x), metres) / LNG_METRES
    turns = F.when(F.abs("r_lng") + reach > 180, F.array(F.lit(0.0), -360 * F.signum("r_lng"))).otherwise(F.array(F.lit(0.0)))
    b = b.withColumn(turn, F.explode(turns)).withColumn(y, beside(lng_cell(F.col("r_lng") + F.col(turn), F.col(x), metres)))
    east = F.col("r_lng") + F.col(turn)
    joined = a.join(b, [*keys, x, y]).where(F.when(F.col(turn) == 0, F.abs(east - F.col("lng")) <= 180).otherwise(F.abs(east - F.col("lng")) < 180))
    far = joined.withColumn("metres", flat_metres(F.col("lat"), F.col("lng"), F.col("r_lat"), east)).drop(x, y, turn)
    return far.where(F.col("metres") <= metres if inclusive else F.col("metres") < metres)


def independent(df: DataFrame, subject: list[str], witness: str, quorum: int) -> DataFrame:
    """Subjects that at least `quorum` different witnesses name."""
    return df.groupBy(*subject).agg(F.countDistinct(witness).alias("witnesses"), F.count("*").alias("n")).where(F.col("witnesses") >= quorum)


def fused(claims: DataFrame, radius: float = 20.0) -> DataFrame:
    """One vote a source, the heaviest located one is the anchor; votes near it (or without place) agree, others dissent."""
    votes = latest(claims.select("feature_id", "source", "seq", "lat", "lng", "weight"), ["feature_id", "source"], [F.asc("seq")])
    anchor = latest(votes.where("lat is not null"), ["feature_id"], [F.desc("weight"), F.asc("seq")]).select("feature_id", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"), F.col("weight").alias("a_weight"), F.col("source").alias("anchor"))
    near = flat_metres(F.col("a_lat"), F.col("a_lng"), F.col("lat"), F.col("lng")) <= radius
    judged = votes.join(anchor, "feature_id").withColumn("agrees", F.col("lat").isNull() | near)
    out = judged.groupBy("feature_id", "anchor", "a_weight").agg(F.sum(F.when(F.col("agrees"), F.col("weight")).otherwise(0)).alias("agreed"), F.count_if(~F.col("agrees")).alias("dissenting"), F.bool_or(~F.col("agrees") & (F.col("weight") >= F.col("a_weight"))).alias("conflict"))
    return out.select("feature_id", "anchor", "dissenting", "conflict", F.when(F.col("conflict"), F.col("a_weight")).otherwise(F.col("agreed")).alias("score"))


def verdict(height: Column, with_adult: Column, lowest: Column, alone: Column, highest: Column) -> Column:
    return (
        F.when(height.isNull(), "eligible")
        .when(lowest.isNull() & alone.isNull() & highest.isNull(), "unknown")
        .when(height > highest, "no")
        .when(height < lowest, "no")
        .when(height < alone, F.when(with_adult, "companion").otherwise("no"))
        .otherwise("eligible")
    )


def best_pairs(left: DataFrame, right: DataFrame, block: str, floor: float, limit: int) -> DataFrame:
    """Pairs of names (l_name, r_name) that share the blocking column, by similarity; each right name once.

    Equal names of a block are compared once, so what a block costs goes by its different names, not its rows.
    Rows with a null name or block pair with none; of equal scores the least l_id wins, then the least r_id.
    """
    lefts = left.groupBy(block, "l_name").agg(F.min("l_id").alias("l_id"))
    rights = right.select(block, "r_name").distinct()
    scored = lefts.join(rights, block).withColumn("score", half_up(similarity(F.col("l_name"), F.col("r_name")), 6)).where(F.col("score") >= floor)
    best = scored.groupBy(block, "r_name").agg(F.min(F.struct((-F.col("score")).alias("s"), "l_id", "l_name")).alias("b"))
    once = right.join(best, [block, "r_name"]).withColumns({"score": -F.col("b.s"), "l_id": F.col("b.l_id"), "l_name": F.col("b.l_name")}).drop("b")
    return once.orderBy(F.desc("score"), "l_id", "r_id").limit(limit)


def unique_names(df: DataFrame, name: str, key: str) -> DataFrame:
    """Names that identify one row, with its key."""
    (n,) = fresh(df, "n_rows")
    return df.groupBy(name).agg(F.count("*").alias(n), F.min(key).alias(key)).where(F.col(n) == 1).drop(n)


def dominant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; of equals the least."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return latest(counts, keys, [F.desc("n"), F.asc(value)])


def thinned(fixes: DataFrame, key: str, seq: str, metres: float) -> DataFrame:
    """Fixes at least `metres` from the last one kept, in order of seq within a key."""
    return fold(fixes, [key], [seq], thin(metres), "_kept", "boolean").drop("_kept")

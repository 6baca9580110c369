"""Terms and overlays: prioritised lookups, patches, two-sided differences, merges of replicas, quorums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ops import latest


def address_book(terms: DataFrame, book: DataFrame) -> DataFrame:
    """term to key: by key, else by lower-cased name (all that have it), else by alias; book has key, name, alias."""
    ways = [F.struct(F.lit(0).alias("way"), F.lower(F.col("key").cast("string")).alias("at")), F.struct(F.lit(1).alias("way"), F.lower("name").alias("at")), F.struct(F.lit(2).alias("way"), F.lower("alias").alias("at"))]
    names = book.select("key", F.explode(F.array(*ways)).alias("w")).select("key", "w.way", "w.at").where("at is not null").distinct()
    found = terms.join(names, F.lower("term") == F.col("at")).select("term", "key", "way")
    best = found.groupBy("term").agg(F.min("way").alias("least"))
    return found.join(best.withColumnRenamed("term", "_t"), F.col("term") == F.col("_t")).where("way = least").select("term", "key").distinct()


def patched(places: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Places with the fields that a patch (key, patch map<string,string>, dropped) has; dropped places go."""
    p = patches.select(F.col(key).alias("_k"), "patch", "dropped")
    both = places.join(p, F.col(key) == F.col("_k"), "left").where("not coalesce(dropped, false)")
    types = dict(places.dtypes)
    over = lambda c: F.when(F.map_contains_key("patch", F.lit(c)), F.get(F.array(F.element_at("patch", F.lit(c))), F.lit(0)).cast(types[c])).otherwise(F.col(c)).alias(c)
    return both.select(*[over(c) if c in columns else F.col(c) for c in places.columns])


def two_sided(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of both with the side that has them: both, left or right."""
    a, b = left.select(*keys, F.lit(1).alias("_l")).distinct(), right.select(*keys, F.lit(1).alias("_r")).distinct()
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, keys, "full").select(*keys, side.alias("side"))


def merged_marks(*replicas: DataFrame) -> DataFrame:
    """Marks (id, used, party) of all replicas: the newest use, and the parties of all."""
    every = replicas[0]
    for r in replicas[1:]:
        every = every.unionByName(r)
    return every.groupBy("id").agg(F.max("used").alias("used"), F.array_sort(F.collect_set("party")).alias("parties"))


def visible_marks(marks: DataFrame, party: Column, now_ms: int, quorum: int = 2, gone_days: int = 28) -> DataFrame:
    """Marks of the viewer's own party, and those that `quorum` parties saw and that have not faded."""
    fresh = now_ms - F.col("used") < gone_days * 86_400_000
    return marks.where(F.array_contains("parties", party) | (F.size("parties") >= quorum) & fresh)


def once(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    return latest(events, keys, [F.asc(order)])


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet, one a key: an insert that repeats nothing."""
    return rows.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def change_runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows where value differs from the row before."""
    from .ops import W, fresh

    (last,) = fresh(df, "value_before")
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn(last, before).where(~F.col(value).eqNullSafe(F.col(last))).drop(last)

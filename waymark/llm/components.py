"""Connected components of a graph given by its edges, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (id long, root long): for every vertex that has a neighbour, the least id it reaches.

    Alternating large and small stars: every round hangs neighbours onto the least of them, until nothing
    changes; the rounds grow with the logarithm of the largest component.  Each round is written to the
    shared folder and the round before is deleted, so lineage stays short and nothing goes to the driver
    but a count and a sum of hashes.

    Defined results: edges with a null, loops and repeated edges count for nothing; vertices without a
    neighbour have no row; an empty table gives an empty result.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before, last = materialize(edges), None, None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen[0] == 0 or tuple(seen) == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = tuple(seen)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(lowest, F.col("a") == F.col("k"))
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b"))).distinct()
        last, now = now, materialize(after)
        forget(last)

"""What several of these operators need: reading tables, cutting lineage in the shared folder, joins on hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.runtime import shared_folder

#: Java's form of the white space that separates words in the contracts: `[\x20\x09-\x0D]`.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: A key with more than this part of a join's rows is hot, so there are at most as many hot keys.
HOT_PART, HOT_ROWS = 2000, 50
#: Rows of a few numbers up to which a table is broadcast: about 20 MB.
SMALL_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: later steps don't compute it again and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row although body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_key(text: Column) -> Column:
    """128-bit digest of a text; null is empty."""
    return F.md5(F.coalesce(text.cast("binary"), F.lit(b"")))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores in front that no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame) -> DataFrame:
    """df, a table of a few short columns, to be broadcast if it has at most SMALL_ROWS rows; else Spark chooses the join."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def skew_join(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """Inner join on the columns `key`, which right has once each; rows of a hot key of left are dealt over many tasks.

    left is read three times, so it should be a table.  The hot keys, at most HOT_PART by the way they are
    chosen, are broadcast; each key's row of right is repeated as often as its rows of left need.
    """
    keys = [key] if isinstance(key, str) else key
    part = max(left.count() // HOT_PART, HOT_ROWS)
    hot = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > part)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / part).cast("int").alias("_salts")))
    salted = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.floor(F.rand(7) * F.col("_salts")).cast("int"))).drop("_salts")
    dealt = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(dealt, [*keys, "_salt"]).drop("_salt")

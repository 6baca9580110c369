"""Makes this package importable in Spark's Python workers, and names the folder that all of them share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_NAME = "waymark_package.zip"


def ship(spark: SparkSession) -> None:
    """Hands the package to Spark's file server, once a context; workers find it whatever folder they start in."""
    context = spark.sparkContext
    if any(str(f).endswith(_NAME) for f in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="waymark-code-")) / _NAME
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", made := f"file://{tempfile.mkdtemp(prefix='waymark-')}")
    return made


def materialize(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: later steps don't compute it again, and its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote for these tables."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

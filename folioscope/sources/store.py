"""Where tables that outlive a plan go: the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, and only under a
    ``local`` master, a temporary folder that is set as such."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def pattern(path: str) -> str:
    """One that matches ``path`` alone: file streams take a single file by a pattern only."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which goes when the application ends: what is
    read twice is worked out once, and a lost executor costs a read."""
    path = new_folder(df.sparkSession, name)
    atexit.register(_forget, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, order: list[str], amount: str, name: str, rows_a_part: int = 100_000) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over the rows before, in ``order`` (nulls first).

    Two levels: rows are dealt by ranges of the order, sums run within a range, and
    the sums before each range come from one number a range.
    """
    parts = max(1, df.count() // rows_a_part)
    held = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, totals = 0, []
    for part, n in sorted(tuple(r) for r in held.groupBy("_part").agg(F.sum(amount)).collect()):
        totals.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(totals, "_part int, _start long")
    earlier = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = held.join(F.broadcast(starts), "_part")  # a row a range
    return met.withColumn(name, F.col("_start") + F.coalesce(F.sum(amount).over(earlier), F.lit(0))).drop("_part", "_start")

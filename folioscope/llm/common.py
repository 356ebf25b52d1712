"""Shared helpers: durable intermediate tables, distributed ranks, code shipping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROOT = str(Path(__file__).resolve().parents[2])

#: Words of every word-based operator: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows to an Arrow batch: rows here hold whole texts, pages or vectors.
BATCH_ROWS = 2_000


def trimmed(run):
    """A ``mapInArrow`` function that gives memory back when its task ends.

    Python workers live on and serve later stages; what malloc, Arrow's pool
    and cyclic garbage hold on to would add up over the stages of a pipeline.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def _give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Also keeps Arrow batches of whole texts small, unless the session says
    otherwise than Spark's default.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark's own file systems only."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset (tests on one machine) a temporary folder is set; on a
    cluster no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def release(*done: DataFrame) -> None:
    """Free the disk of materialised tables that nothing reads any more.

    Also lets the driver notice that the shuffles behind them are unreachable:
    Spark deletes shuffle files only once the driver has collected its garbage.
    """
    for df in done:
        if path := getattr(df, "_written_at", None):
            _delete(df.sparkSession, path)
    _give_back()
    done[0].sparkSession._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Used where a result of Python work is read twice, and between iterations;
    a lost executor then costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def running_offsets(df: DataFrame, group: str, order: list[Column], amount: Column, name: str, rows_per_bucket: int = 500, buckets_per_range: int = 1_000) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over earlier rows of the same group.

    The order is by ``order[0]``, which must be a long spread evenly over its
    whole range (a hash), then by the rest.  A group of any size is split into
    buckets of that hash of about ``rows_per_bucket`` rows, and those into ranges
    of ``buckets_per_range`` buckets.  Sums per bucket and per range are made
    first (partial aggregation); prefix sums run over the ranges of a group, the
    buckets of a range and the rows of a bucket, so no window sorts a whole hot
    group.  Null groups count as one group.
    """
    spread = order[0]
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    keyed = df.withColumn("_h", spread).withColumn("_a", amount)
    sized = counts.select(F.col(group).alias("_g"), F.greatest(F.lit(1), F.ceil(F.col("_rows") / rows_per_bucket)).cast("long").alias("_nb"))
    keyed = keyed.join(sized, keyed[group].eqNullSafe(sized["_g"]), "left").drop("_g")
    # Position of the hash in its range, as a fraction; long -> [0, 1).
    keyed = keyed.withColumn("_b", F.least(F.col("_nb") - 1, F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * F.col("_nb"))).cast("long"))
    sums = keyed.groupBy(group, "_b").agg(F.sum("_a").alias("_s")).withColumn("_r", F.floor(F.col("_b") / buckets_per_range))
    earlier = lambda *by: Window.partitionBy(group, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.groupBy(F.col(group), "_r").agg(F.sum("_s").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(earlier("_r")), F.lit(0)))
    ranges = ranges.select(F.col(group).alias("_g"), F.col("_r").alias("_rr"), "_before")
    sums = sums.withColumn("_start", F.coalesce(F.sum("_s").over(earlier("_r", "_b")), F.lit(0)))
    starts = sums.join(ranges, sums[group].eqNullSafe(ranges["_g"]) & (sums["_r"] == ranges["_rr"])).drop("_g")
    starts = starts.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), (F.col("_start") + F.col("_before")).alias("_start"))
    out = keyed.join(starts, keyed[group].eqNullSafe(starts["_g"]) & (keyed["_b"] == starts["_bb"]), "left")
    inside = Window.partitionBy(group, "_b").orderBy("_h", *order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn(name, F.col("_start") + F.coalesce(F.sum("_a").over(inside), F.lit(0))).drop("_h", "_a", "_nb", "_b", "_g", "_bb", "_start", "_rows")


def in_order(df: DataFrame, by: Column, name: str, rows_per_part: int = 100_000) -> DataFrame:
    """``df`` as a written table dealt by ranges of ``by``: ``_part`` numbers them in order."""
    parts = max(1, df.count() // rows_per_part)
    return materialize(df.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()), name)


def prefix_sums(df: DataFrame, by: Column, amount: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over earlier rows of a table made by :func:`in_order`.

    The driver sees one number for each part of the table.
    """
    spark, at = df.sparkSession, 0
    starts = []
    for part, n in sorted(df.groupBy("_part").agg(F.sum(amount).alias("n")).collect()):
        starts.append((part, at))
        at += n
    held = spark.createDataFrame(starts, "_q int, _from long")
    earlier = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(held, df["_part"] == held["_q"])
    return out.withColumn(name, F.col("_from") + F.coalesce(F.sum(amount).over(earlier), F.lit(0))).drop("_q", "_from")

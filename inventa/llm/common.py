"""Session helpers that all operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _libc = ctypes.CDLL("libc.so.6") if hasattr(ctypes.CDLL("libc.so.6"), "malloc_trim") else None
except OSError:  # another C library
    _libc = None

#: Rows and bytes that one Arrow batch may hold: long texts must not pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of the session (by rows and by bytes) and make sure that there is a checkpoint folder."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # the setting is newer than some releases; the bound by rows is enough for correctness
        pass
    shared_folder(spark)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for a Spark application: their workers may start in any folder."""
    context = spark.sparkContext
    if getattr(context, "_inventa_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(context._temp_dir, "inventa.zip")  # the driver serves it from there
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent).as_posix())
    context.addPyFile(archive)
    context._inventa_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process
    (tests) gets one of its own; on a cluster that is an error, since no executor could read a folder of the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"inventa-{spark.sparkContext.applicationId}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tidy() -> None:
    """Give freed memory back to the system: a worker that is kept for the next task must not hold the last one's peak."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def keep(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: lineage ends here, and losing an executor loses nothing."""
    path = work_path(prepare(df.sparkSession), name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of `df` has, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key is hot if it has more than this share of all rows that have a partner; so there are no more hot keys than its inverse.
HOT = 1 / 1000


def meet(rows: DataFrame, few: DataFrame, on: list[str], times: str) -> DataFrame:
    """Left join of `rows` with `few`, which has one row a key and in `times` how many rows have that key (dropped).
    Hot keys are broadcast, 1 / HOT at most; their rows take no part in the shuffled join, which they would all
    enter in one place, but are spread over it. Both sides are read twice and should be tables."""
    found, spread, value = fresh(rows, "__found", "__spread", "__value")
    total = few.agg(F.coalesce(F.sum(times), F.lit(0))).head()[0]
    values = F.struct(*[c for c in few.columns if c not in (*on, times)])
    hot = few.where(F.col(times) > HOT * total).select(*on, values.alias(found))
    cold = few.where(F.col(times) <= HOT * total).select(*on, F.lit(0).alias(spread), values.alias(value))
    place = F.when(F.col(found).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(1 << 20)).cast("int"))
    out = rows.join(F.broadcast(hot), on, "left").withColumn(spread, place).join(cold, [*on, spread], "left")
    return out.withColumn(value, F.coalesce(found, value)).select(*[out[c] for c in rows.columns], f"{value}.*")


def parallel(df: DataFrame) -> DataFrame:
    """`df`, a scan, with a task for each core at least: a small table may be one split, and a map over it one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

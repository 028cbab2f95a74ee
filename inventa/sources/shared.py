"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir. Where it is unset, a session in one process (tests) gets a folder of its own; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + os.path.join(tempfile.gettempdir(), f"inventa-{context.applicationId}"))


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for a Spark application: their workers may start in any folder."""
    context = spark.sparkContext
    if getattr(context, "_inventa_items_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(context._temp_dir, "inventa_items.zip")  # the driver serves it from there
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent).as_posix())
    context.addPyFile(archive)
    context._inventa_items_shipped = True

"""Sessions: sensible defaults, and the package's own code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; on a cluster the submit tool's master and settings hold."""
    builder = SparkSession.builder.appName("quarrylex")
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())


#: Bytes of a batch sent to a Python worker, unless the session sets its own: texts are of any length, rows are no measure.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where the session names one.

    Only where it is unset (single-machine sessions, such as tests) a temporary folder is made and set for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quarrylex-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, unless PYTHONPATH already has it; done once for a context."""
    name, usual, small = BATCH
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, small)
    top = Path(__file__).resolve().parent
    context = spark.sparkContext
    if str(top.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_quarrylex", False):
        return spark
    archive = Path(tempfile.mkdtemp()) / "quarrylex.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(archive))  # sent through the driver's file server
    context._quarrylex = True
    return spark

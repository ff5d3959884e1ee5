"""Session settings and the places a job may keep intermediate tables."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "quarrystone", master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session with the settings this package expects; ``settings`` are further ones, with underscores for the dots."""
    b = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        b = b.config(key.replace("_", "."), value)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder shared by all executors. It is read from spark.checkpoint.dir; where that is unset, a
    local session (one JVM, as in tests) gets a temporary folder and a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder shared by the executors")
        folder = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = folder.get() if folder.isDefined() else tempfile.mkdtemp(prefix="quarrystone-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_flipped = threading.Lock()
CONSTRAINTS = "spark.sql.constraintPropagation.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors.

    What the optimizer knew of the plan's values is not carried over: a loop that joins or unites a checkpointed table
    with itself would meet those facts under the wrong columns, and lose rows.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    with _flipped:  # one thread at a time, so that none takes another's setting for the session's
        before = spark.conf.get(CONSTRAINTS, "true")
        spark.conf.set(CONSTRAINTS, "false")
        try:
            return df.checkpoint(True)
        finally:
            spark.conf.set(CONSTRAINTS, before)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """More partitions for a CPU-bound step over an input that was scanned in too few (one small file). It is for scans, whose
    partitions are known without running anything."""
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable by the Python workers, once an application; nothing to do where PYTHONPATH has it.
    The driver serves the archive to the executors."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="quarrystone-")) / "quarrystone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "quarrystone").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)

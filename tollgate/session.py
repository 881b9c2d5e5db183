"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g", **conf) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tollgate")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that a local folder is shared by all."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; without it there is an error. Only on
    a single machine a temporary folder is taken instead, and removed at the end.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not on_one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tollgate-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python functions work from any folder. Once per application."""
    context = spark.sparkContext
    name = f"tollgate-{context.applicationId}.zip"
    if any(path.endswith(name) for path in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tollgate-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / name
    with zipfile.ZipFile(path, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent).as_posix())
    context.addPyFile(str(path))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/tollgate/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fits(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> bool:
    """Whether ``df`` was measured to be small, in rows and in bytes."""
    row_bytes = F.octet_length(F.to_json(F.struct(*df.columns)))
    found = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(row_bytes).alias("size")).first()
    return found["n"] <= max_rows and (found["size"] or 0) <= max_bytes


def small_side(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Mark ``df`` for broadcast only if it was measured to be small (:func:`fits`).

    Larger tables come back unmarked, so the join shuffles and adaptive
    execution splits its skewed partitions.
    """
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


def small_table(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """:func:`small_side` for a table that is itself the result of a job: computed once, then counted."""
    return small_side(cut_lineage(df), max_rows)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan has fewer splits than cores; untouched otherwise.

    Helps expressions that are heavy per row on a small or badly split table. A
    large table has more splits than cores and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

"""Session settings, shipping the package to workers, and cutting lineage."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole documents go to Python tasks: bound a batch by its bytes, not only its rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # More than the default 128 (policy, suite) groups stay in hash aggregation.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # A task keeps a file open for each (policy, suite) folder instead of sorting its whole rows.
    "spark.sql.maxConcurrentOutputFileWriters": "32",
}

# Recording a Python call site for every expression costs seconds on wide plans; this can
# only be chosen when a session is created.
STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# A broadcast side above this many rows is joined by shuffle instead.
BROADCAST_ROWS = 100_000


def build_session(app: str = "scoreloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STATIC, **conf}.items():
        builder = builder.config(key, value)
    return attach(builder.getOrCreate())


def attach(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on and ship this package to the workers."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_scoreloom_shipped", False):
        return spark
    package = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="scoreloom-")) / "scoreloom.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._scoreloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in spark.checkpoint.dir."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="scoreloom-checkpoint-")
        context.setCheckpointDir(named)
        folder = context.getCheckpointDir()
    return folder


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Use every core for heavy per-row work on a table of few files.

    A table with at least as many files as there are cores is read as it is, so
    nothing is shuffled at scale; only a small table is redistributed.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if len(scan.inputFiles()) >= cores:
        return scan
    return scan.repartition(max(cores, scan.rdd.getNumPartitions()), *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name on the shared storage."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a (small, aggregated) frame to the shared folder so it is computed exactly once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(settled: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a settled frame for broadcast only after counting it."""
    return F.broadcast(settled) if settled.count() <= max_rows else settled

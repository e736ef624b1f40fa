"""Session helpers: a tuned local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str | int = "*", partitions: int = 8, app: str = "riskmill") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "8m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # a record of the calling line for every column expression costs more than most plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a plain local session may fall back to a temporary folder: on a cluster that folder would
    exist on one machine, so a missing setting is an error there. The fallback is kept here and
    removed when the process ends; the session's settings are not touched.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        configured = _local_folder()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


@functools.cache
def _local_folder() -> str:
    folder = tempfile.TemporaryDirectory(prefix="riskmill-", ignore_cleanup_errors=True)
    atexit.register(folder.cleanup)
    return folder.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; every call gets its own."""
    return f"{shared_dir(spark).rstrip('/')}/riskmill/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table once what was made from it is written; other paths are refused."""
    if not path.startswith(f"{shared_dir(spark).rstrip('/')}/riskmill/"):
        raise ValueError(f"not a scratch path: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Frames made inside drop the files of their shuffles when an action on them ends, not when the driver collects garbage.

    Spark's own setting, put back at the end; a task that still asks for such a file has its stage run again.
    """
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def reliable_checkpoint(df, eager: bool = True):
    """Cut lineage with a checkpoint that survives the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def task_width(spark: SparkSession) -> int:
    """Partitions for stages that are heavy in arithmetic but light in bytes.

    Adaptive execution merges partitions by bytes, which would leave such a stage to a few tasks; a
    fixed number is kept as it is.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of one task in stages that keep several sorts in memory at once.
TASK_ROWS = 1 << 18


def dealt(df, *keys: str):
    """Rows dealt by ``keys`` into tasks of about ``TASK_ROWS`` rows, so a task's memory does not grow with the table.

    The rows are counted first, so this is for tables as they are read. Later joins, windows and groupings
    by the same keys stay in these tasks; a number given here is not merged by bytes. Small tables are left as they are.
    """
    rows = df.count()
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *keys)

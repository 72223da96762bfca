"""Spark session and shared-folder helpers.

Everything else in the package takes a ``SparkSession`` and returns lazy
DataFrames; only this module decides session-wide settings.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

# Settings every job in the package relies on. They are applied to a session
# we create; an existing cluster session keeps its own values except for the
# ones listed in REQUIRED_SQL_CONF, which change results when absent.
REQUIRED_SQL_CONF = {
    # dates and timestamps are compared with DuckDB, which is zone-less
    "spark.sql.session.timeZone": "UTC",
}

# HotSpot never compiles a method of more than 8000 bytes of bytecode, Spark's default lets a
# stage's generated one grow to 65535: the wide feature projections then ran interpreted. Beyond this
# limit Spark runs the stage operator by operator, in methods small enough to be compiled.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "kickoff") -> SparkSession:
    """Return the active session or build a local one tuned for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active)
        return active
    master = master or os.environ.get("KICKOFF_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("KICKOFF_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KICKOFF_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    for key, value in REQUIRED_SQL_CONF.items():
        spark.conf.set(key, value)
    if spark.conf.get(HUGE_METHOD[0]) == "65535":  # Spark's default: nobody chose another one
        spark.conf.set(*HUGE_METHOD)
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names it; we only create one when the setting is unset and the master is
    local, which is the case in tests and the local bench.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="kickoff-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_scope = threading.local()
_written: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder, removed with its
    ``scratch_scope``, else when the process ends."""
    path = f"{checkpoint_dir(spark)}/scratch/{name}-{uuid.uuid4().hex[:12]}"
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    if not _written:
        atexit.register(_remove_written)
    _written[path] = spark
    return path


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None or spark.sparkContext._jsc is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove_written() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        for path in list(_written):
            _remove(path)


@contextlib.contextmanager
def scratch_scope():
    """Paths made inside (by this thread) are removed at its end: for work whose result is
    written elsewhere by then, such as one micro-batch."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        for path in _scope.paths:
            _remove(path)
        _scope.paths = outer


def materialize(df, name: str):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor recomputes from the files, not from the
    whole upstream plan) at the cost of one columnar write; used where a long
    plan would otherwise be re-planned into a slower shape, and where physical row
    numbers must be the same for two readers.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)

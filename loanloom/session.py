"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings a configured session."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("loanloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOANLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    A machine-local folder is used only for local masters (tests); a cluster without the setting is refused, because
    a local folder would lose the table together with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="loanloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark's setting that deletes the shuffle files of a job at its end; without it they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING = {"lock": threading.Lock(), "running": 0, "before": None}


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """The setting, for as long as any thread writes a table; then it is again what it was."""
    with _WRITING["lock"]:
        if not _WRITING["running"]:
            _WRITING["before"] = spark.conf.get(_CLEANUP)
            spark.conf.set(_CLEANUP, "true")
        _WRITING["running"] += 1
    try:
        yield
    finally:
        with _WRITING["lock"]:
            _WRITING["running"] -= 1
            if not _WRITING["running"]:
                spark.conf.set(_CLEANUP, _WRITING["before"])


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage before a DataFrame feeds several branches: each branch then scans only the columns it needs, and
    a lost executor costs one file split instead of the whole upstream plan.  What was shuffled on the way is deleted.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete what ``write_scratch`` wrote, once every reader of it has ended.  Other DataFrames are left alone."""
    for written in tables:
        path = written.__dict__.get("scratch_path")
        if path is None:
            continue
        jvm = written.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(written.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


_STAGED: dict[tuple[str, str], str] = {}


def staged_once(spark: SparkSession, key: str, build) -> DataFrame:
    """The table ``key`` of this application: built and written by the first caller, scanned by later ones.

    A staged table that has vanished is rebuilt.
    """
    slot = (spark.sparkContext.applicationId, key)
    if slot in _STAGED:
        try:
            return spark.read.parquet(_STAGED[slot])
        except AnalysisException:
            del _STAGED[slot]
    path = f"{scratch_dir(spark)}/staged-{uuid.uuid4().hex}"
    build().write.parquet(path)
    _STAGED[slot] = path
    return spark.read.parquet(path)

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import partial
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_LOCAL_SCRATCH: dict[str, str] = {}
# paths that the job under way has staged; None outside a job
_JOB_PATHS: ContextVar[list[str] | None] = ContextVar("job_paths", default=None)

# Runtime settings the jobs rely on. Skewed join partitions are split even where the
# split costs the aggregate after the join one more shuffle.
# A broadcast side goes through the driver whole. Before a run Spark knows only the bytes of the
# files, and encoded columns unfold to tens of times that, so only tiny files are broadcast on
# that ground; every other side has to show its unfolded size in a shuffle first.
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "64KB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "2MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Put the runtime settings into a session that was built elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here relies on.

    Nothing forces a broadcast: a side whose files are tiny, or whose real size in
    its shuffle is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``, is
    broadcast; beyond it Spark uses a sort-merge join with skew splitting.
    """
    builder = (
        SparkSession.builder.appName("zealmark")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # no stack walk per column expression while plans are built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def scratch_dir(spark: SparkSession) -> str:
    """Folder all executors share, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder: on a
    cluster a machine-local folder would not survive a lost executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="zealmark-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Several passes over an expensive plan (ranges, quantiles, draws) then read
    only the columns they need, and a lost executor costs one re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (paths := _JOB_PATHS.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(calls: Sequence[Callable[[], T]]) -> list[T]:
    """Results of calls that do not depend on each other, as jobs that run at once; an error of one is raised when all have ended."""
    with ThreadPoolExecutor(max_workers=max(len(calls), 1)) as pool:
        done = [pool.submit(copy_context().run, call) for call in calls]
    return [job.result() for job in done]


def stage_all(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``stage`` for frames that do not depend on each other, as jobs that run side by side."""
    return dict(zip(frames, side_by_side([partial(stage, df, name) for name, df in frames.items()])))


def discard(spark: SparkSession, name: str) -> None:
    """Delete a folder under the scratch folder, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def job_scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what the job inside has staged, once its own tables are written; other jobs of the process keep theirs."""
    paths: list[str] = []
    token = _JOB_PATHS.set(paths)
    try:
        yield
    finally:
        _JOB_PATHS.reset(token)
        for name in paths:
            discard(spark, name)

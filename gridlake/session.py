"""Session construction and the shared scratch area used to cut lineage in iterative jobs.

Iterative operators (components, breadth-first search, range-ordered running totals) write each
round as a parquet table in the folder the cluster names in ``spark.checkpoint.dir``. A written
table survives the loss of any executor, carries real size statistics for the next plan and keeps
partition contents fixed, which a recomputed lineage would not.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(app: str = "gridlake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library's plans assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # call-site capture costs a round trip per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    ``spark.checkpoint.dir`` as set on the session wins. Only a local master (tests, laptops) gets
    a temporary folder of its own; on a cluster a missing setting is an error, because a
    machine-local path would not be visible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_SCRATCH:
        path = tempfile.mkdtemp(prefix="spark-gridlake-")
        _LOCAL_SCRATCH[app] = path
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return _LOCAL_SCRATCH[app]


def app_scratch(spark: SparkSession) -> str:
    """This application's own folder inside the scratch area."""
    return f"{scratch_dir(spark)}/gridlake-{spark.sparkContext.applicationId}"


def _located(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _located(spark, path)
    return system.exists(target)


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, target = _located(spark, path)
    return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []


def delete_path(spark: SparkSession, path: str) -> None:
    system, target = _located(spark, path)
    system.delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote to the scratch area; call it when results are saved."""
    delete_path(spark, app_scratch(spark))


@contextmanager
def _shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """Joins written inside broadcast only what asks for it.

    A query has hundreds of rounds: broadcasts of up to Spark's ten megabytes each, compressed, add up to gigabytes
    that pass through the driver.
    """
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for name in names:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the scratch area and return a scan over the written table."""
    spark = df.sparkSession
    path = f"{app_scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    with _shuffled_joins(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._gridlake_path = path  # type: ignore[attr-defined]
    return table


def discard(df: DataFrame | None) -> None:
    """Drop a table written by :func:`materialise` that no later plan reads."""
    path = getattr(df, "_gridlake_path", None)
    if path is None:
        return
    delete_path(df.sparkSession, path)

"""Session settings and the two ways an operator may cut a plan: a stored copy and a checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
#: Tables of a row per source and the like are kept in the plan itself up to so many rows and bytes; larger ones are stored.
FEW_ROWS, FEW_BYTES = 4096, 4 * 1024 * 1024
#: What a task reads at most where rows are so narrow that the usual sizes hold too many of them.
TASK_BYTES = 8 * 1024 * 1024


def build_session(app_name: str = "timberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for. ``conf`` keys use ``__`` for dots."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.parquet.filterPushdown": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is chosen only where the session names none and runs
    locally, as in tests: a cluster has to name a folder every executor sees.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not configured:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="timberline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


_scopes: list[list[str]] = []


@contextmanager
def own_copies(spark: SparkSession):
    """Copies stored inside the ``with`` block are deleted at its end: write or collect the result before."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            discard(spark, path)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nothing is created yet."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    if _scopes:
        _scopes[-1].append(path)
    return path


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a plan would otherwise run twice and the second run could differ
    (row ids, range bounds) or would be as expensive as the first.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(spark: SparkSession, size: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


@contextmanager
def small_tasks(spark: SparkSession, size: int = TASK_BYTES):
    """What is stored inside the ``with`` block runs in tasks that read at most about ``size``, of files and of shuffled rows.

    Narrow rows of numbers are packed to a few bytes each, so that a task of the usual 64 or 128 MiB holds many millions in its sorts and hash tables.
    """
    was = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for name, value in was.items():
            spark.conf.set(name, str(min(size, _bytes(spark, value))))
        yield
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


def _in_plan(df: DataFrame) -> DataFrame | None:
    """``df`` as rows that the plan holds, if it has few; one job, and nothing is written."""
    table = df.limit(FEW_ROWS + 1).toArrow()
    if table.num_rows > FEW_ROWS or table.nbytes > FEW_BYTES:
        return None
    return df.sparkSession.createDataFrame(table, df.schema)


def held(df: DataFrame, label: str = "held") -> DataFrame:
    """A table that is expected to be small, computed once: in the plan if it has few rows, else :func:`stored`.

    For tables of a row per source or per profile. Beyond ``FEW_ROWS`` it is computed twice, so it is not for what grows with the lines.
    """
    few = _in_plan(df)
    return stored(df, label) if few is None else few


def small_side(df: DataFrame, row_bytes: int, size: Column | None = None, limit_bytes: int = BROADCAST_LIMIT_BYTES, few: bool = False) -> DataFrame:
    """``df`` stored and, if its measured size is under the limit, marked for broadcast.

    The size is ``row_bytes`` per row plus, where rows hold text, the sum of ``size``. Beyond the limit the
    join stays a shuffle join, where adaptive execution splits skewed partitions. A side that is expected to have ``few`` rows is put into the plan
    itself and not stored, as in :func:`held`.
    """
    rows = _in_plan(df) if few and limit_bytes >= FEW_BYTES else None
    if rows is not None:
        return F.broadcast(rows)
    kept = stored(df, "small")
    rows, extra = kept.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if size is None else size), F.lit(0))).first()
    return F.broadcast(kept) if rows * row_bytes + extra <= limit_bytes else kept


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored copy that nothing will read again, in whatever store it lies; a missing one is fine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)

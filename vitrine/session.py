"""Session, checkpoint folder and size-checked broadcast helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024


def build_session(app: str = "vitrine", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # column expressions need not record the Python line that built them
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a machine-local folder
    would be lost with its machine, so the missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="vitrine-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the reliable checkpoint folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def materialized(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table of its own in the shared folder and read it back.

    Like ``checkpointed`` this cuts the lineage and survives lost executors; being Parquet, what
    reads it gets column pruning, pushed filters and exact sizes for its join choices.
    """
    path = f"{shared_dir(df.sparkSession)}/vitrine/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate; exact for plain file scans, an upper guess above joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(
    df: DataFrame, bound: DataFrame | None = None, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Broadcast ``df`` only when its size is proven small, else leave the join to AQE.

    ``bound`` names a scan that has at least as many rows as ``df`` (``df`` = that scan plus joins
    on unique keys), for which the estimate is exact where the join's own estimate is not.
    """
    small = size_in_bytes(bound if bound is not None else df) <= max_bytes
    return F.broadcast(df) if small else df


def any_of(columns: list[Column]) -> Column:
    result = columns[0]
    for column in columns[1:]:
        result = result | column
    return result


def all_of(columns: list[Column]) -> Column:
    result = columns[0]
    for column in columns[1:]:
        result = result & column
    return result

"""Keyed upserts, append-only event sinks and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_upsert(
    target: DataFrame, batch: DataFrame, keys: list[str], preserve: tuple[str, ...] = ()
) -> DataFrame:
    """The target after an insert-or-update by ``keys``.

    ``batch`` has unique keys (see ``skew.latest``) and may hold a subset of the columns; absent
    ones keep the stored value. Columns in ``preserve`` are only taken from it for new rows. Parquet
    has no MERGE, so the result is a new snapshot for ``write_snapshot``.
    """
    incoming = [c for c in target.columns if c in batch.columns and c not in keys]
    stored = target.withColumn("_stored", F.lit(True))
    changes = batch.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in incoming], F.lit(True).alias("_changed")
    )
    joined = stored.join(changes, keys, "full_outer")

    def value(name: str) -> Column:
        if name not in incoming:
            return F.col(name)
        takes = F.col("_changed") & (
            F.col("_stored").isNull() if name in preserve else F.lit(True)
        )
        return F.when(takes, F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    return joined.select(*[value(c) for c in target.columns])


def seed_shops(
    shops: DataFrame, listings: DataFrame, definitions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Make the shop dimension match the definitions (by slug) and hide orphaned listings.

    Shops no longer defined become inactive, and so do the listings of inactive shops.
    """
    defined = definitions.withColumn("active", F.lit(1))
    # only slugs matter for the id: it is preserved for stored shops
    seeded = sink_upsert(shops.withColumn("active", F.lit(0)), defined, ["slug"], preserve=("id",))
    inactive = seeded.filter(F.col("active") == 0).select(
        F.col("id").alias("source_shop_id"), F.lit(True).alias("_orphan")
    )
    hidden = (
        listings.join(inactive, "source_shop_id", "left")
        .withColumn("is_active", F.when(F.col("_orphan"), 0).otherwise(F.col("is_active")))
        .select(*listings.columns)
    )
    return seeded, hidden


def append_events(events: DataFrame, path: str, moment: str = "observed_at") -> None:
    """Append to an event log partitioned by month.

    The rebalance hint brings a month's rows together and lets adaptive execution split a month
    that is too large for one task and merge small ones.
    """
    dated = events.withColumn("event_month", F.date_format(moment, "yyyy-MM"))
    dated.hint("rebalance", "event_month").write.mode("append").partitionBy("event_month").parquet(
        path
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("event_month")


def _versions(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    done = [
        name
        for name in names
        if name.startswith("version=")
        and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS"))
    ]
    return sorted(int(name.split("=")[1]) for name in done)


def write_snapshot(df: DataFrame, root: str, version: int) -> None:
    """Write version ``version``; it becomes current when its success marker appears.

    Writing the same version again replaces it, so a replayed batch has no further effect.
    """
    df.write.mode("overwrite").parquet(f"{root}/version={version}")


def read_snapshot(
    spark: SparkSession, root: str, before: int | None = None
) -> DataFrame | None:
    """The newest complete version (older than ``before`` when given), None when there is none.

    A batch reads the version before its own, so replaying it starts from the same state.
    """
    versions = [v for v in _versions(spark, root) if before is None or v < before]
    return spark.read.parquet(f"{root}/version={versions[-1]}") if versions else None


def read_versions(
    spark: SparkSession, root: str, before: int | None = None
) -> DataFrame | None:
    """All complete versions (older than ``before`` when given) together, None when there is none."""
    versions = [v for v in _versions(spark, root) if before is None or v < before]
    return spark.read.parquet(*[f"{root}/version={v}" for v in versions]) if versions else None

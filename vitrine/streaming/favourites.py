"""Favourite toggles as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.streaming.sinks import append_new


def store_toggles(root: str) -> Callable[[DataFrame, int], None]:
    """Batch function for a stream of toggles, output mode ``append``: each toggle is stored once by its
    ``event_id``. There is no watermark, so late toggles count whenever they come and repeats never do."""
    return append_new(root, "event_id")


def current_favourites(toggles: DataFrame, item: str) -> DataFrame:
    """The favourites in the stored toggles: per owner and item toggled an odd number of times."""
    counts = toggles.groupBy("owner_key", item).agg(
        F.count(F.lit(1)).alias("toggles"), F.max("ts").alias("created_at")
    )
    return counts.filter(F.col("toggles") % 2 == 1).drop("toggles")

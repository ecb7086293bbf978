"""Page views as a stream: daily counts per page type, path and language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.traffic import ROLLUP_KEYS, tracked_views

LATENESS = "1 day"


def stream_pageviews(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Counts of ``events(event_id, ts, path, lang)``, for output mode ``update`` and an upsert on
    the rollup keys.

    A view that is sent again counts once, and one later than ``lateness`` is dropped; both states
    are given up behind the watermark. The event time must carry a zone.
    """
    counted = (
        tracked_views(events.withWatermark("ts", lateness))
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", "1 day").alias("w"), "page_type", "path_key", "lang")
        .agg(F.count(F.lit(1)).alias("views"), F.max("ts").alias("updated_at"))
    )
    return counted.select(
        F.to_date("w.start").alias("view_date"), *ROLLUP_KEYS[1:], "views", "updated_at"
    )

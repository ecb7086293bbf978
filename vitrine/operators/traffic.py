"""Page-view counts and traffic reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed_values as V
from vitrine.functions.paths import normalize_lang, path_key, path_tracked, path_type

ROLLUP_KEYS = ["view_date", "page_type", "path_key", "lang"]


def tracked_views(events: DataFrame) -> DataFrame:
    """Raw page views (``ts, path, lang``) that count, with their report columns."""
    return events.filter(path_tracked(F.col("path"))).select(
        *[c for c in events.columns if c not in ("path", "lang")],
        path_type(F.col("path")).alias("page_type"),
        path_key(F.col("path")).alias("path_key"),
        normalize_lang(F.col("lang")).alias("lang"),
    )


def pageview_rollup(events: DataFrame) -> DataFrame:
    """Views per (day, page type, path, language) and the time of the last one."""
    return (
        tracked_views(events)
        .withColumn("view_date", F.to_date("ts"))
        .groupBy(*ROLLUP_KEYS)
        .agg(F.count(F.lit(1)).alias("views"), F.max("ts").alias("updated_at"))
    )


def merge_rollups(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Counters after adding another rollup's counts."""
    return (
        stored.unionByName(added)
        .groupBy(*ROLLUP_KEYS)
        .agg(F.sum("views").alias("views"), F.max("updated_at").alias("updated_at"))
    )


def since_date(raw: Column, as_of: Column, days: int = V.TRAFFIC_DAYS) -> Column:
    """The date given as ``yyyy-MM-dd``, else the first of the last ``days`` days."""
    valid = F.when(raw.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), raw).try_cast("date")
    return F.coalesce(valid, F.date_sub(as_of.cast("date"), days - 1))


def analytics_daily(views: DataFrame, since: Column | date, limit: int = V.DAILY_LIMIT) -> DataFrame:
    return (
        views.filter(F.col("view_date") >= since)
        .groupBy("view_date")
        .agg(F.sum("views").alias("views"), F.count(F.lit(1)).alias("path_count"))
        .orderBy(F.col("view_date").desc())
        .limit(limit)
    )


def analytics_page_types(
    views: DataFrame, since: Column | date, limit: int = V.PAGE_TYPE_LIMIT
) -> DataFrame:
    """Views and distinct (path, language) pairs per page type.

    There are only a few page types, so pairs are made distinct by their own key first and a type
    then only adds up one row per pair and task.
    """
    per_path = (
        views.filter(F.col("view_date") >= since)
        .groupBy("page_type", "path_key", "lang")
        .agg(F.sum("views").alias("views"))
    )
    return (
        per_path.groupBy("page_type")
        .agg(F.sum("views").alias("views"), F.count(F.lit(1)).alias("path_count"))
        .orderBy(F.col("views").desc(), "page_type")
        .limit(limit)
    )


def analytics_top_paths(
    views: DataFrame, since: Column | date, limit: int = V.TOP_PATH_LIMIT
) -> DataFrame:
    return (
        views.filter(F.col("view_date") >= since)
        .groupBy("page_type", "path_key", "lang")
        .agg(F.sum("views").alias("views"))
        .orderBy(F.col("views").desc(), "page_type", "path_key", "lang")
        .limit(limit)
    )

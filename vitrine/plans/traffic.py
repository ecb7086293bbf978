"""Registered traffic queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import paths as P
from vitrine.operators import traffic as W
from vitrine.plans.registry import query
from vitrine.sources import adapters as A

AS_OF = "2024-01-28 09:00:00"
SINCE_SQL = "DATE '2024-01-15'"


def views(spark: SparkSession, folder: str) -> DataFrame:
    return W.pageview_rollup(A.page_view_events(spark, folder))


def since():
    return W.since_date(F.lit("no date"), A.moment(AS_OF))


@query("pageview_rollup", "SELECT * FROM views")
def pageview_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return views(spark, folder)


@query(
    "pageview_merge",
    """SELECT view_date, page_type, path_key, lang, CAST(2 * views AS BIGINT) AS views, updated_at
FROM views""",
)
def pageview_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Counters after the same day's views were added twice."""
    return W.merge_rollups(views(spark, folder), views(spark, folder))


@query(
    "path_columns",
    """SELECT event_id,
  CASE WHEN path LIKE '/listing/%' THEN 'listing' WHEN path LIKE '/shops/%' THEN 'shop'
    WHEN path = '/favourites' THEN 'favourites' ELSE 'other' END AS path_type,
  CASE WHEN path LIKE '/%' THEN split_part(path, '?', 1) ELSE '/' || path END AS path_key,
  CAST(path <> '/healthz' AS INTEGER) AS path_tracked,
  CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'en' END AS lang
FROM page_views""",
)
def path_columns(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("path")
    return A.page_view_events(spark, folder).select(
        "event_id", P.path_type(path).alias("path_type"), P.path_key(path).alias("path_key"),
        P.path_tracked(path).cast("int").alias("path_tracked"),
        P.normalize_lang(F.col("lang")).alias("lang"),
    )


@query(
    "page_path_columns",
    """SELECT page_id, CASE WHEN split_part(path, '?', 1) = '/' THEN 'home' ELSE 'other' END
    AS path_type, split_part(path, '?', 1) AS path_key
FROM (SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://[^/]*(/[^#]*)', 1), ''), '/')
  AS path FROM pages)""",
)
def page_path_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Path columns of the crawled pages' own addresses."""
    path = F.regexp_extract("url", r"^https?://[^/]*(/[^#]*)", 1)
    return A.pages(spark, folder).select(
        "page_id", P.path_type(path).alias("path_type"), P.path_key(path).alias("path_key")
    )


@query(
    "analytics_daily",
    f"""SELECT view_date, CAST(sum(views) AS BIGINT) AS views, count(*) AS path_count
FROM views WHERE view_date >= {SINCE_SQL} GROUP BY 1 ORDER BY 1 DESC LIMIT 30""",
)
def analytics_daily(spark: SparkSession, folder: str) -> DataFrame:
    return W.analytics_daily(views(spark, folder), since())


@query(
    "analytics_page_types",
    f"""SELECT page_type, CAST(sum(views) AS BIGINT) AS views,
  count(DISTINCT path_key || '|' || lang) AS path_count
FROM views WHERE view_date >= {SINCE_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def analytics_page_types(spark: SparkSession, folder: str) -> DataFrame:
    return W.analytics_page_types(views(spark, folder), since())


@query(
    "analytics_top_paths",
    f"""SELECT page_type, path_key, lang, CAST(sum(views) AS BIGINT) AS views
FROM views WHERE view_date >= {SINCE_SQL} GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 20""",
)
def analytics_top_paths(spark: SparkSession, folder: str) -> DataFrame:
    return W.analytics_top_paths(views(spark, folder), since())


@query(
    "analytics_since",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE)
  ELSE CAST(ts AS DATE) - 13 END AS since_date FROM events""",
)
def analytics_since(spark: SparkSession, folder: str) -> DataFrame:
    """A given date where it parses, else the first of the fourteen days up to the event."""
    raw = (
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_id") % 3 == 1, F.lit("2024-13-45"))
        .otherwise(F.lit(""))
    )
    return A.read(spark, folder, "events").select(
        "event_id", W.since_date(raw, F.col("ts")).alias("since_date")
    )

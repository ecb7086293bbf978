"""Registered refresh-monitoring queries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import monitor as M
from vitrine.plans.registry import query
from vitrine.sources import adapters as A

AS_OF = A.JOBS_DAY
SINCE = "2001-01-01 00:00:00"
PARTS = {
    "stale_jobs": f"""SELECT id, shop_id, source_slug, chunk_index, started_at,
  CASE WHEN stale THEN TIMESTAMP '{AS_OF}' ELSE finished_at END AS finished_at,
  CASE WHEN stale THEN 'stale' ELSE status END AS status, listings_found, hidden_count,
  CASE WHEN stale AND error_message = ''
    THEN 'Marked stale by refresh monitor at 2001-06-01T12:00:00' ELSE error_message END
    AS error_message
FROM (SELECT *, status = 'running' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 90 MINUTE AS stale
  FROM jobs)""",
    "today_jobs": "SELECT * FROM stale_jobs WHERE started_at >= TIMESTAMP '2001-06-01 00:00:00'",
    "observed": """SELECT e.*, coalesce(j.n, 0) AS observed_jobs, coalesce(j.indexed, 0) AS indexed
FROM expected e LEFT JOIN (SELECT source_slug, count(*) AS n, count(chunk_index) AS indexed
  FROM today_jobs GROUP BY 1) j ON j.source_slug = e.source_slug""",
    "missing": """SELECT o.source_slug, 'missing_refresh_jobs' AS reason, expected_jobs, observed_jobs,
  coalesce((SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i)
    FROM unnest(range(CASE WHEN o.indexed > 0 THEN o.chunk_count ELSE 0 END)) t(i)
    WHERE NOT EXISTS (SELECT 1 FROM today_jobs j
      WHERE j.source_slug = o.source_slug AND j.chunk_index = i)), '') AS missing_chunk_indexes
FROM observed o WHERE observed_jobs < expected_jobs""",
    "complete": """SELECT j.* FROM today_jobs j JOIN observed o ON o.source_slug = j.source_slug
WHERE observed_jobs >= expected_jobs""",
    "failed": "SELECT * FROM complete WHERE status <> 'success'",
    "not_success": """SELECT f.source_slug, 'refresh_jobs_not_success' AS reason, count(*) AS count,
  (SELECT string_agg(status || ':' || n, ',' ORDER BY status) FROM (
    SELECT status, count(*) AS n FROM failed g WHERE g.source_slug = f.source_slug GROUP BY 1))
    AS statuses,
  arg_max(started_at, (started_at, id)) AS latest_started_at,
  (SELECT finished_at FROM failed g WHERE g.source_slug = f.source_slug
    ORDER BY started_at DESC, id DESC LIMIT 1) AS latest_finished_at,
  arg_max(error_message, (started_at, id)) AS latest_error_message,
  coalesce((SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FROM (
    SELECT DISTINCT chunk_index AS c FROM failed g
    WHERE g.source_slug = f.source_slug AND chunk_index IS NOT NULL)), '') AS affected_chunk_indexes
FROM failed f GROUP BY f.source_slug""",
    "spikes": """SELECT source_slug, 'suspicious_hidden_count' AS reason, started_at, finished_at, status,
  listings_found, hidden_count,
  CASE WHEN listings_found > 0 THEN CAST(hidden_count AS DOUBLE) / listings_found END AS hidden_ratio
FROM complete WHERE hidden_count >= 50
  AND (listings_found <= 0 OR CAST(hidden_count AS DOUBLE) / listings_found >= 0.25)""",
    "unknown": """SELECT source_slug, 'unknown_refresh_source' AS reason, count(*) AS observed_jobs
FROM today_jobs WHERE source_slug NOT IN (SELECT source_slug FROM expected) GROUP BY 1""",
    "running": """SELECT source_slug, 'refresh_job_still_running' AS reason, started_at, chunk_index
FROM today_jobs WHERE status = 'running'""",
}


def today(spark: SparkSession, folder: str) -> DataFrame:
    marked = M.jobs_mark_stale(A.refresh_jobs(spark, folder), A.moment(AS_OF))
    return M.jobs_today(marked, A.moment(AS_OF))


@query(
    "jobs_mark_stale",
    "SELECT id, status, started_at, finished_at, error_message FROM stale_jobs",
    PARTS,
)
def jobs_mark_stale(spark: SparkSession, folder: str) -> DataFrame:
    return M.jobs_mark_stale(A.refresh_jobs(spark, folder), A.moment(AS_OF)).select(
        "id", "status", "started_at", "finished_at", "error_message"
    )


@query("jobs_missing", "SELECT * FROM missing", PARTS)
def jobs_missing(spark: SparkSession, folder: str) -> DataFrame:
    return M.jobs_missing(today(spark, folder), A.expected_jobs(spark, folder))


@query("jobs_not_success", "SELECT * FROM not_success", PARTS)
def jobs_not_success(spark: SparkSession, folder: str) -> DataFrame:
    return M.jobs_not_success(today(spark, folder), A.expected_jobs(spark, folder))


@query("jobs_hidden_spike", "SELECT * FROM spikes", PARTS)
def jobs_hidden_spike(spark: SparkSession, folder: str) -> DataFrame:
    return M.jobs_hidden_spike(today(spark, folder), A.expected_jobs(spark, folder))


@query("jobs_unknown_source", "SELECT * FROM unknown", PARTS)
def jobs_unknown_source(spark: SparkSession, folder: str) -> DataFrame:
    return M.jobs_unknown_source(today(spark, folder), A.expected_jobs(spark, folder))


@query("jobs_still_running", "SELECT * FROM running", PARTS)
def jobs_still_running(spark: SparkSession, folder: str) -> DataFrame:
    return M.jobs_still_running(today(spark, folder))


@query(
    "jobs_report",
    """SELECT * FROM missing UNION ALL BY NAME SELECT * FROM not_success
UNION ALL BY NAME SELECT * FROM spikes UNION ALL BY NAME SELECT * FROM unknown
UNION ALL BY NAME SELECT * FROM running""",
    PARTS,
)
def jobs_report(spark: SparkSession, folder: str) -> DataFrame:
    return M.jobs_report(
        A.refresh_jobs(spark, folder), A.expected_jobs(spark, folder), A.moment(AS_OF)
    )


@query(
    "audit_status_by_day",
    f"""SELECT CAST(started_at AS DATE) AS refresh_date, status, count(*) AS count
FROM jobs WHERE started_at >= TIMESTAMP '{SINCE}' GROUP BY 1, 2""",
)
def audit_status_by_day(spark: SparkSession, folder: str) -> DataFrame:
    return M.audit_status_by_day(A.refresh_jobs(spark, folder), A.moment(SINCE))


@query(
    "audit_running",
    """SELECT id, source_slug, chunk_index, started_at, finished_at, listings_found, hidden_count,
  substr(error_message, 1, 160) AS error_message
FROM jobs WHERE status = 'running' ORDER BY started_at DESC, id DESC LIMIT 50""",
)
def audit_running(spark: SparkSession, folder: str) -> DataFrame:
    return M.audit_running(A.refresh_jobs(spark, folder))


@query(
    "audit_non_success",
    f"""SELECT id, source_slug, chunk_index, status, started_at, finished_at, listings_found,
  hidden_count, substr(error_message, 1, 160) AS error_message
FROM jobs WHERE started_at >= TIMESTAMP '{SINCE}' AND status <> 'success'
ORDER BY started_at DESC, id DESC LIMIT 100""",
)
def audit_non_success(spark: SparkSession, folder: str) -> DataFrame:
    return M.audit_non_success(A.refresh_jobs(spark, folder), A.moment(SINCE))


@query(
    "audit_coverage_today",
    """SELECT source_slug, status, count(*) AS count, min(started_at) AS first_started,
  max(finished_at) AS last_finished
FROM jobs WHERE started_at >= TIMESTAMP '2001-06-01 00:00:00' GROUP BY 1, 2""",
)
def audit_coverage_today(spark: SparkSession, folder: str) -> DataFrame:
    return M.audit_coverage_today(
        A.refresh_jobs(spark, folder), F.lit(AS_OF).cast("timestamp_ntz")
    )

"""Health rules over the refresh-job ledger, and its audit reports.

``expected(source_slug, expected_jobs, chunk_count)`` says what a day must bring per source;
``chunk_count`` is 0 for sources without fixed chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed_values as V
from vitrine.functions.text import text_or_empty


def jobs_mark_stale(jobs: DataFrame, as_of: Column, minutes: int = V.STALE_MINUTES) -> DataFrame:
    """Jobs running for too long become ``stale``; an error text already there is kept."""
    stale = (F.col("status") == "running") & (
        F.col("started_at") < as_of - F.expr(f"INTERVAL {minutes} MINUTES")
    )
    stamp = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")
    message = F.concat(F.lit("Marked stale by refresh monitor at "), stamp)
    return jobs.withColumns(
        {
            "status": F.when(stale, "stale").otherwise(F.col("status")),
            "finished_at": F.when(stale, as_of).otherwise(F.col("finished_at")),
            "error_message": F.when(
                stale & (text_or_empty(F.col("error_message")) == ""), message
            ).otherwise(F.col("error_message")),
        }
    )


def jobs_today(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.filter(F.col("started_at") >= F.date_trunc("DAY", as_of))


def _observed(jobs: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected source: number of jobs, and which of the expected chunks were seen.

    Jobs are counted per (source, chunk) first; the chunk set of a source then has at most one
    entry per expected chunk.
    """
    per_chunk = jobs.groupBy("source_slug", "chunk_index").agg(F.count(F.lit(1)).alias("n"))
    known = (F.col("chunk_index") >= 0) & (F.col("chunk_index") < F.col("chunk_count"))
    seen = (
        per_chunk.join(expected, "source_slug")
        .groupBy("source_slug")
        .agg(
            F.sum("n").alias("observed_jobs"),
            F.count("chunk_index").alias("_indexed"),
            F.collect_set(F.when(known, F.col("chunk_index"))).alias("_seen"),
        )
    )
    return expected.join(seen, "source_slug", "left").withColumn(
        "observed_jobs", F.coalesce("observed_jobs", F.lit(0))
    )


def jobs_missing(jobs: DataFrame, expected: DataFrame) -> DataFrame:
    """Sources with fewer jobs than expected; chunk indexes only if some job has one."""
    all_chunks = F.when(
        (F.col("chunk_count") > 0) & (F.col("_indexed") > 0),
        F.sequence(F.lit(0), F.col("chunk_count") - 1),
    ).otherwise(F.array().cast("array<int>"))
    seen = F.coalesce("_seen", F.array().cast("array<int>"))
    return (
        _observed(jobs, expected)
        .filter(F.col("observed_jobs") < F.col("expected_jobs"))
        .select(
            "source_slug", F.lit("missing_refresh_jobs").alias("reason"), "expected_jobs",
            "observed_jobs",
            F.array_join(F.array_except(all_chunks, seen).cast("array<string>"), ",").alias(
                "missing_chunk_indexes"
            ),
        )
    )


def _complete(jobs: DataFrame, expected: DataFrame) -> DataFrame:
    """Jobs of the expected sources that are not reported as missing jobs."""
    enough = (
        _observed(jobs, expected)
        .filter(F.col("observed_jobs") >= F.col("expected_jobs"))
        .select("source_slug")
    )
    return jobs.join(enough, "source_slug", "left_semi")


def jobs_not_success(jobs: DataFrame, expected: DataFrame) -> DataFrame:
    """Per source: failed jobs, their statuses, the latest one's details, the chunks affected.

    Statuses are ``status:count`` in status order; chunk indexes are distinct and sorted.
    """
    failed = _complete(jobs, expected).filter(F.col("status") != "success")
    details = ["started_at", "finished_at", "error_message"]
    per_part = failed.groupBy("source_slug", "status", "chunk_index").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(F.struct(*details), F.struct("started_at", "id")).alias("last"),
        F.max(F.struct("started_at", "id")).alias("at"),
    )
    statuses = (
        per_part.groupBy("source_slug", "status")
        .agg(F.sum("n").alias("n"))
        .groupBy("source_slug")
        .agg(
            F.array_join(
                F.array_sort(F.collect_list(F.concat_ws(":", "status", F.col("n")))), ","
            ).alias("statuses")
        )
    )
    summary = per_part.groupBy("source_slug").agg(
        F.sum("n").alias("count"),
        F.max_by("last", "at").alias("last"),
        F.array_sort(F.collect_set("chunk_index")).alias("chunks"),
    )
    return summary.join(statuses, "source_slug").select(
        "source_slug", F.lit("refresh_jobs_not_success").alias("reason"), "count", "statuses",
        F.col("last.started_at").alias("latest_started_at"),
        F.col("last.finished_at").alias("latest_finished_at"),
        text_or_empty(F.col("last.error_message")).alias("latest_error_message"),
        F.array_join(F.col("chunks").cast("array<string>"), ",").alias("affected_chunk_indexes"),
    )


def jobs_hidden_spike(
    jobs: DataFrame,
    expected: DataFrame,
    min_count: int = V.HIDDEN_SPIKE_COUNT,
    min_ratio: float = V.HIDDEN_SPIKE_RATIO,
) -> DataFrame:
    """Jobs that hid many listings, absolutely and relative to what they found."""
    found = F.coalesce("listings_found", F.lit(0))
    hidden = F.coalesce("hidden_count", F.lit(0))
    ratio = F.when(found > 0, hidden.cast("double") / found)
    return (
        _complete(jobs, expected)
        .filter((hidden >= min_count) & (ratio.isNull() | (ratio >= min_ratio)))
        .select(
            "source_slug", F.lit("suspicious_hidden_count").alias("reason"), "started_at",
            "finished_at", "status", found.alias("listings_found"), hidden.alias("hidden_count"),
            ratio.alias("hidden_ratio"),
        )
    )


def jobs_unknown_source(jobs: DataFrame, expected: DataFrame) -> DataFrame:
    return (
        jobs.groupBy("source_slug")
        .agg(F.count(F.lit(1)).alias("observed_jobs"))
        .join(expected.select("source_slug"), "source_slug", "left_anti")
        .select("source_slug", F.lit("unknown_refresh_source").alias("reason"), "observed_jobs")
    )


def jobs_still_running(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") == "running").select(
        "source_slug", F.lit("refresh_job_still_running").alias("reason"), "started_at",
        "chunk_index",
    )


def jobs_report(jobs: DataFrame, expected: DataFrame, as_of: Column) -> DataFrame:
    """All warnings of the day in one table, after stale jobs were marked."""
    today = jobs_today(jobs_mark_stale(jobs, as_of), as_of)
    warnings = jobs_missing(today, expected)
    for more in (
        jobs_not_success(today, expected),
        jobs_hidden_spike(today, expected),
        jobs_unknown_source(today, expected),
        jobs_still_running(today),
    ):
        warnings = warnings.unionByName(more, allowMissingColumns=True)
    return warnings


def audit_status_by_day(jobs: DataFrame, since: Column) -> DataFrame:
    return (
        jobs.filter(F.col("started_at") >= since)
        .groupBy(F.to_date("started_at").alias("refresh_date"), "status")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("refresh_date").desc(), "status")
    )


def _audit(jobs: DataFrame, limit: int, columns: list[str]) -> DataFrame:
    return (
        jobs.orderBy(F.col("started_at").desc(), F.col("id").desc())
        .limit(limit)
        .select(
            *columns,
            F.substring("error_message", 1, V.AUDIT_ERROR_CHARS).alias("error_message"),
        )
    )


def audit_running(jobs: DataFrame, limit: int = V.AUDIT_RUNNING_LIMIT) -> DataFrame:
    columns = ["id", "source_slug", "chunk_index", "started_at", "finished_at",
               "listings_found", "hidden_count"]
    return _audit(jobs.filter(F.col("status") == "running"), limit, columns)


def audit_non_success(
    jobs: DataFrame, since: Column, limit: int = V.AUDIT_NON_SUCCESS_LIMIT
) -> DataFrame:
    columns = ["id", "source_slug", "chunk_index", "status", "started_at", "finished_at",
               "listings_found", "hidden_count"]
    wanted = jobs.filter((F.col("started_at") >= since) & (F.col("status") != "success"))
    return _audit(wanted, limit, columns)


def audit_coverage_today(jobs: DataFrame, as_of: Column) -> DataFrame:
    return (
        jobs_today(jobs, as_of)
        .groupBy("source_slug", "status")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("started_at").alias("first_started"),
            F.max("finished_at").alias("last_finished"),
        )
        .orderBy("source_slug", "status")
    )

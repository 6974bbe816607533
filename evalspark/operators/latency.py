"""Execution logs: durations, outcomes and what to run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.aggregates import count_where
from evalspark.operators.ranking import percentiles_linear, percentiles_nearest
from evalspark.operators.validate import DataError, require_empty

PROFILE = {"P50_ms": 0.5, "P90_ms": 0.9, "P95_ms": 0.95, "P99_ms": 0.99, "max_ms": 1.0}
BANDS_MS = [3000, 5000, 10000, 30000]  # fixed values: limits reported on
POLICY_MS = [3000, 5000, 10000]
ESCALATION_CAP = 100


def percentiles(log: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Interpolated percentiles of the successful runs: ``name, value``."""
    done = log.filter("success and duration_ms is not null")
    return percentiles_linear(done, group or [], "duration_ms", PROFILE).withColumn(
        "value", F.round("value", 2)
    )


def band_counts(log: DataFrame) -> DataFrame:
    """``limit_ms, n_at_or_below, n_above`` over the successful runs."""
    done = log.filter("success and duration_ms is not null")
    counts = done.agg(
        F.count("*").alias("n"),
        *[count_where(F.col("duration_ms") <= b).alias(str(b)) for b in BANDS_MS],
    )
    return counts.unpivot(["n"], [str(b) for b in BANDS_MS], "limit_ms", "n_at_or_below").select(
        F.col("limit_ms").cast("bigint").alias("limit_ms"),
        "n_at_or_below",
        (F.col("n") - F.col("n_at_or_below")).alias("n_above"),
    )


def slowest(log: DataFrame, by: str = "db_id", top: int = 20) -> DataFrame:
    """The groups with the highest mean duration."""
    return (
        log.filter("duration_ms is not null")
        .groupBy(by)
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("duration_ms"), 2).alias("mean_ms"),
            F.round(F.max("duration_ms"), 2).alias("max_ms"),
        )
        .orderBy(F.desc("mean_ms"), by)
        .limit(top)
    )


def timeout_policy(log: DataFrame, limits_ms: list[int] = POLICY_MS) -> DataFrame:
    """Per limit, the runs that would not have met it."""
    slow = [
        count_where(
            (F.coalesce("duration_ms", F.lit(0.0)) > limit) | F.coalesce("timed_out", F.lit(False))
        ).alias(str(limit))
        for limit in limits_ms
    ]
    counts = log.agg(F.count("*").alias("total"), *slow)
    return counts.unpivot(["total"], [str(x) for x in limits_ms], "limit_ms", "exceeding").select(
        F.col("limit_ms").cast("bigint").alias("limit_ms"),
        "exceeding",
        "total",
        F.round(F.col("exceeding") / F.greatest("total", F.lit(1)), 4).alias("ratio"),
    )


def staged_outcomes() -> dict[str, Column]:
    """What a run of a two-stage audit came to, after ten and after thirty seconds."""
    fast = F.col("success") & (F.col("duration_ms") <= 10000)
    return {
        "stage_a_10s_outcome": F.when(fast, "success").otherwise("timeout"),
        "stage_b_30s_outcome": F.when(fast, "success_under_10s")
        .when(F.col("success"), "success_10_to_30s")
        .otherwise("timeout_30s"),
    }


def outcome_rollup(log: DataFrame) -> DataFrame:
    """One row of counts by duration band and error type."""
    ok, kind, ms = F.col("success"), F.col("error_type"), F.col("duration_ms")
    named = ["timeout", "sqlite_error", "unsafe", "unsafe_sql", "internal_error"]
    return log.agg(
        F.count("*").alias("source_rows"),
        count_where(ok & (ms <= 3000)).alias("success_under_3s"),
        count_where(ok & (ms > 3000) & (ms <= 10000)).alias("success_3_to_10s"),
        count_where(ok & (ms > 10000) & (ms <= 30000)).alias("success_10_to_30s"),
        count_where(ok).alias("success"),
        count_where(~ok & (kind == "timeout")).alias("timeout"),
        count_where(~ok & (kind == "sqlite_error")).alias("sqlite_error"),
        count_where(~ok & kind.isin("unsafe", "unsafe_sql")).alias("unsafe"),
        count_where(~ok & (kind == "internal_error")).alias("internal_error"),
        count_where(~ok & ~F.coalesce(kind.isin(named), F.lit(False))).alias("other"),
    )


def remap_ids(log: DataFrame, by_migration: DataFrame, by_content: DataFrame) -> DataFrame:
    """Old ids replaced by stable ones: the migration's, else the content's, else kept.

    Both maps have ``old_id`` and ``stable_id``, one row per old id.
    """
    first = by_migration.filter("old_id is not null").select(
        F.col("old_id").alias("example_id"), F.col("stable_id").alias("_a")
    )
    second = by_content.select(
        F.col("old_id").alias("example_id"), F.col("stable_id").alias("_b")
    )
    return (
        log.join(first, "example_id", "left")
        .join(second, "example_id", "left")
        .withColumn("stable_id", F.coalesce("_a", "_b", "example_id"))
        .drop("_a", "_b")
    )


def rerun_of_database(source: DataFrame, db_id: str) -> DataFrame:
    return source.filter(F.col("db_id") == db_id)


def rerun_of_failures(source: DataFrame, failures: DataFrame, error_type: str) -> DataFrame:
    """Source rows of logged failures; a failure without source row raises."""
    ids = failures.filter(F.col("error_type") == error_type).select("example_id").distinct()
    lost = ids.join(source.select("example_id"), "example_id", "left_anti")
    require_empty(lost, "example_id", "failure without source row")
    return source.join(ids, "example_id", "left_semi")


def escalation_set(residual: DataFrame, source: DataFrame, cap: int | None = None) -> DataFrame:
    """Residual timeouts with their SQL; with a ``cap``, refuses when there are more."""
    if cap is not None and residual.limit(cap + 1).count() > cap:
        raise DataError(f"more than {cap} residual timeouts; look into them first")
    matched = source.select("example_id", "gold_sql", F.lit(True).alias("_found"))
    return (
        residual.join(matched, "example_id", "left")
        .withColumn("matched", F.coalesce("_found", F.lit(False)))
        .drop("_found")
    )


REQUEST_FRACTIONS = {"p50": 0.5, "p95": 0.95}


def request_percentiles(requests: DataFrame) -> DataFrame:
    """``metric, name, value`` at the nearest rank of first-token and total latency."""
    long = requests.unpivot([], ["ttft_ms", "total_latency_ms"], "metric", "ms")
    return percentiles_nearest(long, ["metric"], "ms", REQUEST_FRACTIONS).withColumn(
        "value", F.round("value", 2)
    )


def request_throughput(requests: DataFrame) -> DataFrame:
    """One row over a request log with ``started_at, ended_at, output_tokens``."""
    wall = F.unix_micros(F.max("ended_at")) - F.unix_micros(F.min("started_at"))
    counted = requests.agg(
        F.count("*").alias("requests"),
        (wall / 1e6).alias("_wall"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("_tokens"),
    )

    def per_second(name: str) -> Column:
        return F.when(F.col("_wall") > 0, F.round(F.col(name) / F.col("_wall"), 2)).otherwise(0.0)

    return counted.select(
        "requests",
        F.round("_wall", 2).alias("wall_seconds"),
        per_second("_tokens").alias("tokens_per_sec"),
        per_second("requests").alias("requests_per_sec"),
    )

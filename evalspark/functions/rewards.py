"""Reward components as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reward scale.
FORMAT_VALID, FORMAT_FENCE, FORMAT_MALFORMED = 0.05, 0.0, -0.4
PARSE_VALID, PARSE_INVALID = 0.05, -0.4
SAFETY_SAFE, SAFETY_UNSAFE, SAFETY_UNCHECKED = 0.05, -1.0, 0.0
EXECUTION_SUCCESS, EXECUTION_FAILURE = 0.1, 0.0
CORRECT_STRICT, CORRECT_PARTIAL, CORRECT_NONE = 1.0, 0.25, 0.0
TOTAL_FLOOR = -1.0


def format_reward(protocol: Column, format_ok: Column) -> Column:
    return (
        F.when((protocol == "tags") & format_ok, FORMAT_VALID)
        .when(protocol == "fence", FORMAT_FENCE)
        .otherwise(FORMAT_MALFORMED)
    )


def parse_reward(safe: Column) -> Column:
    return F.when(safe, PARSE_VALID).otherwise(PARSE_INVALID)


def safety_reward(safe: Column) -> Column:
    """``safe`` is null when nothing could be checked."""
    return F.when(safe, SAFETY_SAFE).when(~safe, SAFETY_UNSAFE).otherwise(SAFETY_UNCHECKED)


def execution_reward(success: Column) -> Column:
    return F.when(success, EXECUTION_SUCCESS).otherwise(EXECUTION_FAILURE)


def correctness_reward(strict: Column, partial: Column) -> Column:
    return F.when(strict, CORRECT_STRICT).when(partial, CORRECT_PARTIAL).otherwise(CORRECT_NONE)


def total_reward(safe: Column, *components: Column) -> Column:
    """Sum with a floor; unsafe SQL gets the floor whatever else it earned."""
    total = components[0]
    for component in components[1:]:
        total = total + component
    floored = F.greatest(F.lit(TOTAL_FLOOR), total)
    return F.round(F.when(~safe, F.lit(TOTAL_FLOOR)).otherwise(floored), 6)


def error_bucket(
    sql: Column,
    safety_error: Column,
    safe: Column,
    executed: Column,
    timed_out: Column,
    success: Column,
    failure_bucket: Column,
    equivalent: Column,
) -> Column:
    """Why an example counts as wrong; the first reason that holds."""
    no = F.lit(False)
    return (
        F.when(sql.isNull(), "format_error")
        .when(safety_error == "syntax_error", "syntax_error")
        .when(~safe, "unsafe_sql")
        .when(~F.coalesce(executed, no), "format_error")
        .when(F.coalesce(timed_out, no), "timeout")
        .when(~F.coalesce(success, no), failure_bucket)
        .when(~F.coalesce(equivalent, no), "wrong_result")
        .otherwise("none")
    )

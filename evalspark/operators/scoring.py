"""From completions and verdicts to evaluation records and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions import rewards
from evalspark.functions.completions import (
    fallback_sql,
    parse_completion,
    sql_block_count,
    stop_reason,
)
from evalspark.functions.screening import message_bucket, screen
from evalspark.functions.text import normalize_sql_exact_match


def parsed(completions: DataFrame, text: str, require_plan: bool = False) -> DataFrame:
    """Add ``parse`` and ``safety``, the latter null when there is no SQL."""
    found = completions.withColumn("parse", parse_completion(F.col(text), require_plan))
    return found.withColumn("safety", screen(F.col("parse.sql")))


def scorable(completions: DataFrame, text: str, require_plan: bool = False) -> DataFrame:
    """As ``parsed``, plus the SQL to run: the block, or else the fallback extraction."""
    found = completions.withColumn("parse", parse_completion(F.col(text), require_plan))
    missing = F.col("parse.sql").isNull()
    return (
        found.withColumn("fallback_sql", F.when(missing, fallback_sql(F.col(text))))
        .withColumn("run_sql", F.coalesce("parse.sql", "fallback_sql"))
        .withColumn("safety", screen(F.col("run_sql")))
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def evaluation_records(completions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Evaluation records of parsed completions joined to their verdicts.

    ``completions`` come from ``parsed`` and carry ``example_id, candidate_index, split,
    db_id, gold_sql, latency_ms``. ``verdicts`` carry the run's ``success, timed_out,
    error_type, error_message`` beside the verdict columns; unsafe SQL has none.
    """
    joined = completions.join(verdicts, ["example_id", "candidate_index"], "left")
    sql, safety = F.col("parse.sql"), F.col("safety")
    ran = F.col("success").isNotNull() & _flag("safety.safe")
    bucket = rewards.error_bucket(
        sql,
        safety["error_type"],
        safety["safe"],
        ran,
        F.col("timed_out"),
        F.col("success"),
        message_bucket(F.col("error_message")),
        F.col("equivalent"),
    )
    same_text = normalize_sql_exact_match(sql) == normalize_sql_exact_match(F.col("gold_sql"))
    readable = ~safety["error_type"].isin("syntax_error", "format_error")
    return joined.select(
        "example_id",
        "candidate_index",
        "split",
        "db_id",
        sql.alias("sql"),
        F.col("parse.format_ok").alias("format_ok"),
        F.coalesce(readable, F.lit(False)).alias("sql_parse_ok"),
        sql.isNotNull().alias("parse_ok"),
        _flag("safety.safe").alias("safe"),
        (ran & _flag("success")).alias("execution_success"),
        (ran & _flag("equivalent")).alias("execution_equivalent"),
        (ran & _flag("partial_credit")).alias("verification_partial"),
        F.when(ran, F.coalesce("kind", F.lit("none"))).otherwise("none").alias("verification_kind"),
        bucket.alias("error_bucket"),
        F.round("latency_ms", 2).alias("latency_ms"),
        F.coalesce(same_text, F.lit(False)).alias("exact_match"),
        F.coalesce(safety["error_type"], F.lit("none")).alias("safety_error_type"),
        F.when(ran, F.col("error_type")).otherwise("none").alias("execution_error_type"),
        F.when(ran, F.col("candidate_row_count")).otherwise(0).alias("row_count"),
        F.when(ran, F.col("gold_row_count")).otherwise(0).alias("gold_row_count"),
    )


def score(completions: DataFrame, outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Reward components and total of ``scorable`` completions.

    ``outcomes`` has the keys and ``success, strict_equivalent, partial_credit`` of runs;
    SQL that is unsafe or missing earns nothing for running, whatever it says there.
    """
    joined = completions.join(outcomes, keys, "left")
    safe = F.col("safety.safe")
    ran = F.coalesce(safe, F.lit(False))
    parts = {
        "format_reward": rewards.format_reward(F.col("parse.protocol"), F.col("parse.format_ok")),
        "parse_reward": rewards.parse_reward(safe),
        "safety_reward": rewards.safety_reward(safe),
        "execution_reward": rewards.execution_reward(ran & _flag("success")),
        "correctness_reward": rewards.correctness_reward(
            ran & _flag("strict_equivalent"), ran & _flag("partial_credit")
        ),
    }
    return joined.withColumns(parts).withColumn(
        "total_reward", rewards.total_reward(safe, *[F.col(name) for name in parts])
    )


# Columns of a sample that its source may or may not have.
_OPTIONAL = {
    "timestamp": "string",
    "optimizer_step": "bigint",
    "completion_tokens": "bigint",
    "example_id": "string",
    "db_id": "string",
}
_OPTIONAL_OUTCOME = {
    "error_type": "string",
    "candidate_row_count": "bigint",
    "gold_row_count": "bigint",
}


def reward_samples(scored: DataFrame, run_id: str, text: str) -> DataFrame:
    """Flat log rows of scored completions; what is unknown or was not reached is null."""
    ran = F.coalesce("safety.safe", F.lit(False))

    def given(name: str, data_type: str) -> Column:
        value = F.col(name) if name in scored.columns else F.lit(None)
        return value.cast(data_type)

    return scored.select(
        F.lit(run_id).alias("run_id"),
        "generation_group_id",
        "completion_index",
        *[given(name, kind).alias(name) for name, kind in _OPTIONAL.items()],
        stop_reason(F.col(text)).alias("stop_reason"),
        sql_block_count(F.col(text)).alias("sql_block_count"),
        F.col("total_reward").alias("reward"),
        "format_reward",
        "parse_reward",
        "safety_reward",
        "execution_reward",
        "correctness_reward",
        (F.col("parse.sql").isNotNull() & F.col("parse.parse_error").isNull()).alias("parse_ok"),
        F.col("safety.safe").alias("safe"),
        F.when(ran, F.col("success")).alias("execution_success"),
        F.when(ran, F.col("strict_equivalent")).alias("strict_equivalent"),
        F.when(ran, F.col("partial_credit")).alias("partial_credit"),
        *[F.when(ran, given(name, kind)).alias(name) for name, kind in _OPTIONAL_OUTCOME.items()],
    )

"""Rates and counts over evaluation records and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.aggregates import count_where, rate
from evalspark.functions.completions import sql_block_count
from evalspark.functions.prompts import failure_reason
from evalspark.operators.signal import STD_FLOOR


def _ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(0.0)


def _rolled(records: DataFrame, column: str, size: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates overall (``ALL``) and per value of ``column``, in one pass.

    Without records there is still the overall row, with the aggregates of no rows; it is
    made from none and gives way to the real one, whose count (``size``) is larger.
    """
    rolled = records.rollup(column).agg(F.grouping_id().cast("int").alias("_all"), *aggregates)
    nothing = records.limit(0).agg(F.lit(None).cast("string").alias(column), F.lit(1).alias("_all"), *aggregates)
    names = [c for c in rolled.columns if c not in (column, "_all", size)]
    return (
        rolled.unionByName(nothing)
        .groupBy("_all", column)
        .agg(F.max_by(F.struct(size, *names), size).alias("_of"))
        .select(
            F.when(F.col("_all") == 1, "ALL").otherwise(F.col(column)).alias(column), "_of.*"
        )
    )


def evaluation_metrics(records: DataFrame) -> DataFrame:
    """All rates overall (``split`` is ``ALL``) and per split, in one pass.

    SQL that parses but is unsafe counts as valid SQL here.
    """
    aggregates = [
        F.count("*").alias("num_examples"),
        rate("execution_equivalent").alias("execution_accuracy"),
        rate("format_ok").alias("format_valid_rate"),
        rate("sql_parse_ok").alias("sql_parse_valid_rate"),
        rate("sql_parse_ok").alias("valid_sql_rate"),
        rate("execution_success").alias("execution_success_rate"),
        rate("error_bucket = 'unsafe_sql'").alias("unsafe_sql_rate"),
        rate("exact_match").alias("exact_match_secondary"),
        rate("verification_partial").alias("partial_equivalence_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
    ]
    return _rolled(records, "split", "num_examples", aggregates)


def bucket_counts(records: DataFrame, column: str = "error_bucket") -> DataFrame:
    return records.groupBy(column).agg(F.count("*").alias("n"))


def prediction_accuracy(examples: DataFrame, judged: DataFrame) -> DataFrame:
    """Accuracy over the predictions there are; ``missing`` counts those there are not.

    ``judged`` has ``example_id`` and ``strict_equivalent`` per prediction.
    """
    joined = examples.select("example_id").join(
        judged.select("example_id", "strict_equivalent", F.lit(True).alias("given")),
        "example_id",
        "left",
    )
    return joined.agg(
        count_where("given").alias("num_examples"),
        count_where("given and strict_equivalent").alias("correct"),
        count_where("given is null").alias("missing"),
    ).withColumn(
        "execution_accuracy",
        F.when(F.col("num_examples") > 0, F.col("correct") / F.col("num_examples")).otherwise(0.0),
    )


def prediction_errors(examples: DataFrame, judged: DataFrame) -> DataFrame:
    """``example_id, error``: what is wrong with each prediction that is not correct.

    ``judged`` has ``strict_equivalent`` and ``kind``; an example without a row there has
    no prediction.
    """
    missing = examples.select("example_id").join(
        judged.select("example_id"), "example_id", "left_anti"
    )
    wrong = judged.filter(~F.col("strict_equivalent")).join(
        examples.select("example_id"), "example_id", "left_semi"
    )
    return missing.select("example_id", F.lit("missing_prediction").alias("error")).unionAll(
        wrong.select("example_id", "kind")
    )


def mode_rates(records: DataFrame) -> DataFrame:
    """Rates overall (``mode`` is ``ALL``) and per generation mode, to four places."""

    def rounded(condition: str | Column, name: str) -> Column:
        return F.round(rate(condition), 4).alias(name)

    aggregates = [
        F.count("*").alias("records"),
        rounded("format_valid", "format_valid_rate"),
        rounded("sql_parse_valid", "parse_valid_rate"),
        rounded("safe", "safe_rate"),
        rounded("execution_success", "execution_success_rate"),
        rounded("strict_equivalent", "strict_execution_accuracy"),
        rounded("stop_reason = 'sql_close'", "stop_at_sql_close_rate"),
        rounded("stop_reason = 'max_new_tokens'", "truncation_rate"),
        rounded(sql_block_count(F.col("raw_completion")) > 1, "multiple_sql_block_rate"),
        F.round(F.avg(F.coalesce("completion_token_count", F.lit(0))), 2).alias(
            "mean_completion_tokens"
        ),
    ]
    return _rolled(records, "mode", "records", aggregates)


def teacher_metrics(candidates: DataFrame, requested: DataFrame) -> DataFrame:
    """One row over the candidates of the requested ids."""
    ids = requested.select("example_id").distinct()
    mine = candidates.join(ids, "example_id", "left_semi")
    per_example = mine.groupBy("example_id").agg(
        F.count("*").alias("n"),
        count_where("parse_valid and candidate_sql <> ''").alias("parsed"),
        count_where("safe").alias("safe"),
        count_where("execution_success").alias("ran"),
        count_where("execution_equivalent").alias("verified"),
    )
    counts = ids.join(per_example, "example_id", "left").agg(
        F.count("*").alias("requested_count"),
        F.count("n").alias("teacher_examples"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{c}") for c in ("n", "parsed", "safe", "ran", "verified")],
        count_where("verified > 0").alias("verified_example_count"),
    )
    n = F.col("_n")
    return counts.select(
        "requested_count",
        "teacher_examples",
        n.alias("generated_candidates"),
        _ratio(n, F.col("teacher_examples")).alias("mean_candidates_per_example"),
        _ratio(F.col("_parsed"), n).alias("parse_valid_rate"),
        _ratio(F.col("_safe"), n).alias("safe_sql_rate"),
        _ratio(F.col("_ran"), n).alias("execution_success_rate"),
        _ratio(F.col("_verified"), n).alias("strict_verified_rate"),
        "verified_example_count",
        _ratio(F.col("verified_example_count"), F.col("requested_count")).alias(
            "verified_example_coverage"
        ),
    )


def candidate_failure() -> Column:
    return failure_reason(
        *[
            F.col(c)
            for c in (
                "parse_valid", "candidate_sql", "safe", "execution_success", "execution_equivalent",
            )
        ]
    )


def failure_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(candidate_failure().alias("reason")).agg(F.count("*").alias("n"))


def duplicate_retries(candidates: DataFrame) -> DataFrame:
    """One row: retries that repeat the SQL of their example's first attempt.

    Retries are counted per SQL before the join, so an example with very many of them
    meets its first attempt as a few rows.
    """
    first = (
        candidates.filter("attempt_index = 0")
        .groupBy("example_id")
        .agg(F.max_by("candidate_sql", F.struct("created_at", "candidate_index")).alias("first_sql"))
        .filter("first_sql <> ''")
    )
    retries = (
        candidates.filter("attempt_index > 0 and candidate_sql is not null")
        .groupBy("example_id", "candidate_sql")
        .agg(F.count("*").alias("n"))
    )
    same = retries.join(first, "example_id").filter("candidate_sql = first_sql")
    return same.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_retry_count"))


def attempt_metrics(candidates: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: the first attempts, the retries, and what the retries added."""
    first, retry = F.col("attempt_index") == 0, F.col("attempt_index") > 0
    verified = F.coalesce("execution_equivalent", F.lit(False))
    counts = candidates.agg(
        F.count("*").alias("_n"),
        count_where(first).alias("attempt1_generated"),
        count_where(retry).alias("retry_generated"),
        count_where(first & F.col("parse_valid")).alias("_parsed1"),
        count_where(first & F.col("safe")).alias("_safe1"),
        count_where(first & F.col("execution_success")).alias("_ran1"),
        count_where(retry & F.col("parse_valid")).alias("_parsed2"),
        count_where(retry & F.col("execution_success")).alias("_ran2"),
        F.count_distinct("normalized_sql_hash").alias("_unique"),
    )
    per_example = candidates.groupBy("example_id").agg(
        F.max(first & verified).alias("early"), F.max(verified).alias("ever")
    )
    gained = per_example.agg(
        count_where("early").alias("attempt1_verified_example_count"),
        count_where("ever and not early").alias("retry_incremental_verified_examples"),
        count_where("ever").alias("final_verified_example_count"),
    )
    asked = requested.agg(F.count_distinct("example_id").alias("requested_examples"))
    row = _beside(counts, gained, duplicate_retries(candidates), asked)
    n1, n2, wanted = (
        F.col(c) for c in ("attempt1_generated", "retry_generated", "requested_examples")
    )

    def coverage(name: str) -> Column:
        return _ratio(F.col(name), wanted)

    return row.select(
        "requested_examples",
        "attempt1_generated",
        "retry_generated",
        _ratio(F.col("_parsed1"), n1).alias("attempt1_parse_valid_rate"),
        _ratio(F.col("_safe1"), n1).alias("attempt1_safe_rate"),
        _ratio(F.col("_ran1"), n1).alias("attempt1_execution_success_rate"),
        "attempt1_verified_example_count",
        coverage("attempt1_verified_example_count").alias("attempt1_verified_example_coverage"),
        _ratio(F.col("_parsed2"), n2).alias("retry_parse_valid_rate"),
        _ratio(F.col("_ran2"), n2).alias("retry_execution_success_rate"),
        "retry_incremental_verified_examples",
        coverage("retry_incremental_verified_examples").alias("retry_incremental_coverage"),
        "duplicate_retry_count",
        _ratio(F.col("duplicate_retry_count"), n2).alias("duplicate_retry_rate"),
        _ratio(F.col("_unique"), F.col("_n")).alias("unique_candidate_sql_ratio"),
        "final_verified_example_count",
        coverage("final_verified_example_count").alias("final_verified_example_coverage"),
    )


def _beside(*rows: DataFrame) -> DataFrame:
    """One-row frames as one row, joined on a constant."""
    keyed = [row.withColumn("_one", F.lit(1)) for row in rows]
    result = keyed[0]
    for other in keyed[1:]:
        result = result.join(other, "_one")
    return result.drop("_one")


def generation_metrics(samples: DataFrame, group: str = "group_id") -> DataFrame:
    """One row over diagnostic completions: uniqueness, validity and reward spread."""
    malformed = ~F.coalesce("strict_format_valid", F.lit(False))
    extractable = (
        malformed
        & (F.coalesce("diagnostic_fallback_sql", F.lit("")) != "")
        & F.coalesce("fallback_parse_valid", F.lit(False))
    )
    sql = F.coalesce(
        F.when(F.col("strict_parsed_sql") != "", F.col("strict_parsed_sql")),
        F.col("diagnostic_fallback_sql"),
    )
    hashed = F.sha2("raw_completion", 256)
    overall = samples.agg(
        F.count("*").alias("completions"),
        F.count_distinct(hashed).alias("_raw"),
        # Completions without any SQL count as one more value.
        (F.count_distinct(F.sha2(sql, 256)) + F.max(sql.isNull().cast("int"))).alias("_sql"),
        count_where("total_reward is null").alias("reward_none_count"),
        F.round(rate("strict_format_valid"), 4).alias("format_valid_rate"),
        F.round(rate("strict_parsed_sql <> ''"), 4).alias("parse_valid_rate"),
        F.round(rate("safe"), 4).alias("safe_rate"),
        F.round(rate("execution_success"), 4).alias("execution_success_rate"),
        F.round(rate("strict_equivalent"), 4).alias("strict_correct_rate"),
        F.round(rate("stop_reason = 'sql_close'"), 4).alias("stop_at_sql_close_rate"),
        F.round(rate("stop_reason = 'max_new_tokens'"), 4).alias("truncation_rate"),
        F.round(F.avg(F.coalesce("completion_tokens", F.lit(0))), 2).alias(
            "mean_completion_tokens"
        ),
        F.round(rate(sql_block_count(F.col("raw_completion")) > 1), 4).alias(
            "multiple_sql_block_rate"
        ),
        _ratio(count_where(extractable), count_where(malformed)).alias(
            "format_invalid_but_sql_extractable_rate"
        ),
    )
    spread = (
        samples.groupBy(group)
        .agg(F.stddev_pop(F.coalesce("total_reward", F.lit(0.0))).alias("std"))
        .agg(
            F.count("*").alias("groups"),
            count_where(F.col("std") > STD_FLOOR).alias("nonzero_reward_std_group_count"),
        )
    )
    return (
        _beside(overall, spread)
        .withColumn("raw_completion_unique_ratio", _ratio(F.col("_raw"), F.col("completions")))
        .withColumn("normalized_sql_unique_ratio", _ratio(F.col("_sql"), F.col("completions")))
        .withColumn(
            "nonzero_reward_std_group_fraction",
            _ratio(F.col("nonzero_reward_std_group_count"), F.col("groups")),
        )
        .drop("_raw", "_sql")
    )

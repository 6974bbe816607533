"""Collecting candidates round by round, as steps over tables.

A round asks a generator for the attempts still open, judges the answers and appends the
records. What is done is read from the candidate table itself, so a run that was cut off
goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.aggregates import count_where
from evalspark.functions.identity import canonical_json, generation_seed, normalized_sql_hash, sha256
from evalspark.functions.prompts import failure_reason, retry_feedback, retry_prompt
from evalspark.functions.screening import sanitize_error
from evalspark.operators.metrics import candidate_failure
from evalspark.operators.scoring import parsed
from evalspark.operators.validate import DataError, require_empty


class FingerprintMismatch(DataError):
    """The table holds records of a run with other inputs or settings."""


def run_fingerprint(settings: dict[str, str]) -> Column:
    """Hash of all that defines a run; kept on every record it writes."""
    return sha256(canonical_json(**{k: F.lit(v) for k, v in settings.items()}))


def check_resume(candidates: DataFrame, fingerprint: Column) -> None:
    """Raise if any record stems from another run."""
    foreign = candidates.filter(~F.col("run_fingerprint").eqNullSafe(fingerprint))
    require_empty(foreign, "run_fingerprint", "records of another run", FingerprintMismatch)


def completed_keys(candidates: DataFrame, prompt_version: str) -> DataFrame:
    return (
        candidates.filter(F.col("teacher_prompt_version") == prompt_version)
        .select("example_id", "candidate_index")
        .distinct()
    )


def remaining(examples: DataFrame, completed: DataFrame, per_example: int) -> DataFrame:
    """Keys still to generate: every index of every example that is not done."""
    indexes = F.sequence(F.lit(0), F.lit(per_example - 1))
    planned = examples.select("example_id", F.explode(indexes).alias("candidate_index"))
    return planned.join(completed, ["example_id", "candidate_index"], "left_anti")


def next_attempts(examples: DataFrame, candidates: DataFrame, max_attempts: int) -> DataFrame:
    """Per unverified example the next attempt and what to say about the last one.

    A verified example is complete; it is never asked for again.
    """
    last = candidates.groupBy("example_id").agg(
        F.max("candidate_index").alias("last_index"),
        F.bool_or("execution_equivalent").alias("done"),
        F.max_by(
            F.struct(
                candidate_failure().alias("reason"),
                "execution_error_message_sanitized",
                "execution_error_type",
            ),
            "candidate_index",
        ).alias("last"),
    )
    open_examples = examples.join(last, "example_id", "left").filter(
        ~F.coalesce("done", F.lit(False))
    )
    attempt = F.coalesce(F.col("last_index") + 1, F.lit(0))
    return open_examples.select(
        "example_id",
        attempt.cast("int").alias("candidate_index"),
        F.col("last.reason").alias("retry_reason"),
        F.when(
            F.col("last").isNotNull(),
            retry_feedback(
                F.col("last.reason"),
                F.col("last.execution_error_message_sanitized"),
                F.col("last.execution_error_type"),
            ),
        ).alias("feedback"),
    ).filter(F.col("candidate_index") < max_attempts)


def attempt_prompts(prompts: DataFrame, attempts: DataFrame, seed: int) -> DataFrame:
    """Prompts of the open attempts, with feedback and seed."""
    return attempts.join(prompts.select("example_id", "db_id", "prompt"), "example_id").select(
        "example_id",
        "db_id",
        "candidate_index",
        retry_prompt(F.col("prompt"), F.col("feedback")).alias("prompt"),
        generation_seed(seed, F.col("example_id"), F.col("candidate_index")).alias(
            "generation_seed"
        ),
    )


Generator = Callable[[str, dict, int], list[str]]


def generate(inputs: DataFrame, generator: Generator, num_candidates: int = 1) -> DataFrame:
    """Call a generator on ``example_id, db_id, split, prompt``: one row per candidate.

    The generator is called inside the tasks and sees the ids, the split and the prompt.
    """
    columns = ["example_id", "db_id", "split", "prompt"]
    if inputs.columns != columns:
        raise DataError(f"a generator may see exactly {columns}, got {inputs.columns}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, indexes, texts = [], [], []
            for row in batch.to_pylist():
                prompt = row.pop("prompt")
                for index, text in enumerate(generator(prompt, row, num_candidates)):
                    ids.append(row["example_id"])
                    indexes.append(index)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(indexes, pa.int32()), pa.array(texts, pa.string())],
                names=["example_id", "candidate_index", "raw_candidate_output"],
            )

    return inputs.mapInArrow(
        run, "example_id string, candidate_index int, raw_candidate_output string"
    )


def candidate_records(
    completions: DataFrame, verdicts: DataFrame, seed: int, require_plan: bool = False
) -> DataFrame:
    """Full records: parsed, screened and joined to the verdicts of what was run.

    ``verdicts`` has ``success, error_type, error_message, equivalent, kind``.
    """
    keys = ["example_id", "candidate_index"]
    joined = parsed(completions, "raw_candidate_output", require_plan).join(verdicts, keys, "left")
    sql, safe = F.col("parse.sql"), F.coalesce("safety.safe", F.lit(False))
    ok = safe & F.coalesce("success", F.lit(False))
    valid = sql.isNotNull() & F.col("parse.parse_error").isNull()
    equivalent = ok & F.coalesce("equivalent", F.lit(False))
    failed = safe & (F.col("success") == F.lit(False))
    reason = failure_reason(valid, sql, safe, ok, equivalent)
    return joined.select(
        *keys,
        "raw_candidate_output",
        sql.alias("candidate_sql"),
        F.col("parse.plan").alias("candidate_plan"),
        valid.alias("parse_valid"),
        safe.alias("safe"),
        ok.alias("execution_success"),
        equivalent.alias("execution_equivalent"),
        generation_seed(seed, F.col("example_id"), F.col("candidate_index")).alias(
            "generation_seed"
        ),
        normalized_sql_hash(sql).alias("normalized_sql_hash"),
        F.coalesce("safety.error_type", F.lit("format_error")).alias("safety_error_type"),
        F.when(failed, F.col("error_type")).otherwise("none").alias("execution_error_type"),
        F.when(failed, sanitize_error(F.col("error_message"))).alias(
            "execution_error_message_sanitized"
        ),
        F.when(safe, F.col("kind")).alias("verification_kind"),
        reason.alias("retry_reason"),
    )


def until_target(examples: DataFrame, candidates: DataFrame, order: str, target: int) -> DataFrame:
    """The examples, in order, up to the one that brings the ``target``-th verified.

    The cut is the largest ordinal among the first ``target`` verified examples, which is
    a top-k and needs no running sum over all rows.
    """
    verified = examples.join(
        candidates.filter("execution_equivalent").select("example_id"), "example_id", "left_semi"
    )
    cut = (
        verified.orderBy(order)
        .limit(target)
        .agg(F.when(F.count("*") == target, F.max(order)).otherwise(F.lit(2**62)).alias("cut"))
    )
    return examples.filter(F.col(order) <= cut.scalar())


def progress(examples: DataFrame, completed: DataFrame, per_example: int) -> DataFrame:
    """One row: examples and candidates planned and completed."""
    done = completed.groupBy("example_id").agg(F.count("*").alias("n"))
    joined = examples.select("example_id").join(done, "example_id", "left")
    return joined.agg(
        F.count("*").alias("examples_planned"),
        count_where("n > 0").alias("examples_completed"),
        (F.count("*") * per_example).alias("candidates_planned"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidates_completed"),
    )

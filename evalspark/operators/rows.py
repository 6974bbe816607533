"""Prompt rows, training rows and paired targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.aggregates import count_where
from evalspark.functions.prompts import SCHEMA_PLACEHOLDER, build_prompt, target_text
from evalspark.functions.text import WORD_RUN
from evalspark.operators.ranking import percentiles_nearest
from evalspark.operators.sampling import first_n
from evalspark.operators.validate import (
    apply_split_policy,
    assert_calibration_splits,
    require_empty,
)
from evalspark.session import materialize


class TargetMissing(KeyError):
    """A distilled target is missing; gold SQL never stands in for it."""


def word_count(text: Column) -> Column:
    """Default token counter; pass another column function to use a real tokenizer."""
    return F.regexp_count(text, F.lit(WORD_RUN))


def _prompt(schema_text: Column, include_plan: bool, version: str) -> Column:
    return build_prompt(
        F.col("question"), schema_text, F.col("db_id"), F.col("evidence"), include_plan, version
    )


def prompt_rows(
    examples: DataFrame, include_plan: bool = False, version: str = "bird-v1"
) -> DataFrame:
    """``example_id, db_id, prompt, prompt_truncated``; the id, not the text, is the key."""
    return examples.select(
        "example_id",
        "db_id",
        _prompt(F.col("schema_text"), include_plan, version).alias("prompt"),
        F.lit(False).alias("prompt_truncated"),
    )


def prompt_rows_within(
    examples: DataFrame,
    max_tokens: int,
    count: Callable[[Column], Column] = word_count,
    include_plan: bool = False,
    version: str = "bird-v1",
) -> DataFrame:
    """As ``prompt_rows``; a prompt over budget keeps the schema's first whole lines that fit.

    Lines are counted once and summed up within the row, so no shuffle is needed. The
    counter must be additive over lines, as counting words is.
    """
    no_schema = count(_prompt(F.lit(""), include_plan, version))
    lines = F.split("schema_text", r"\r\n|[\n\r]")
    sized = examples.withColumns(
        {
            "_budget": F.lit(max_tokens) - no_schema,
            "_lines": lines,
            "_tokens": F.transform(lines, lambda line: count(line)),
        }
    )
    fits = F.aggregate(
        "_tokens",
        F.struct(
            F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("kept"), F.lit(True).alias("open")
        ),
        lambda acc, n: F.struct(
            (acc["sum"] + n).cast("bigint").alias("sum"),
            F.when(acc["open"] & (acc["sum"] + n <= F.col("_budget")), acc["kept"] + 1)
            .otherwise(acc["kept"])
            .alias("kept"),
            (acc["open"] & (acc["sum"] + n <= F.col("_budget"))).alias("open"),
        ),
    )
    kept = sized.withColumn("_fit", fits).withColumn(
        "_schema",
        F.when(F.col("_fit.open"), F.col("schema_text"))
        .when(F.col("_fit.kept") == 0, F.lit(SCHEMA_PLACEHOLDER))
        .otherwise(F.array_join(F.slice("_lines", F.lit(1), F.col("_fit.kept")), "\n")),
    )
    return kept.select(
        "example_id",
        "db_id",
        _prompt(F.col("_schema"), include_plan, version).alias("prompt"),
        (~F.col("_fit.open")).alias("prompt_truncated"),
        F.col("_fit.kept").alias("kept_lines"),
    )


def sft_rows(
    examples: DataFrame, targets: DataFrame | None = None, include_plan: bool = False
) -> DataFrame:
    """Instruction rows; with ``targets`` (``example_id, target_sql``) none may be missing."""
    if targets is None:
        rows = examples.withColumn("target_sql", F.col("gold_sql"))
    else:
        rows = examples.join(targets, "example_id", "left")
        missing = examples.select("example_id").join(
            targets.filter("target_sql <> ''"), "example_id", "left_anti"
        )
        require_empty(missing, "example_id", "no distilled target", TargetMissing)
    return rows.select(
        F.lit("").alias("instruction"),
        _prompt(F.col("schema_text"), include_plan, "bird-v1").alias("input"),
        target_text(F.col("target_sql"), include_plan).alias("output"),
        "example_id",
        "db_id",
    )


def verified_targets(candidates: DataFrame) -> DataFrame:
    """One verified candidate per example: lowest index, then earliest."""
    usable = candidates.filter(
        "parse_valid and safe and execution_success and execution_equivalent "
        "and candidate_sql <> ''"
    )
    return usable.groupBy("example_id").agg(
        F.min_by("candidate_sql", F.struct("candidate_index", "created_at")).alias("target_sql")
    )


def paired_targets(
    examples: DataFrame, candidates: DataFrame, require_all: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold and distilled SQL of the same ids, the ids dropped, and the coverage row."""
    targets = verified_targets(candidates)
    gold = examples.select("example_id", "db_id", "gold_sql")
    dropped = gold.select("example_id").join(targets, "example_id", "left_anti")
    if require_all:
        require_empty(dropped, "example_id", "no verified candidate", TargetMissing)
    paired = gold.join(targets, "example_id").withColumnRenamed("target_sql", "distilled_sql")
    found = targets.select("example_id", F.lit(True).alias("found"))
    told = gold.select("example_id").join(found, "example_id", "left")
    summary = told.agg(
        F.count("*").alias("requested_count"),
        F.count("found").alias("paired_count"),
        F.count_if(F.col("found").isNull()).alias("dropped_count"),
    ).withColumn(
        "coverage",
        F.when(F.col("requested_count") > 0, F.col("paired_count") / F.col("requested_count"))
        .otherwise(0.0),
    )
    return paired, dropped, summary


def gold_arm(examples: DataFrame, paired: DataFrame) -> DataFrame:
    """The examples the gold arm may train on: those both arms have."""
    return examples.join(paired.select("example_id"), "example_id", "left_semi")


def calibration_rows(
    examples: DataFrame, order: str, n: int, allowed: list[str] | None = None
) -> DataFrame:
    """The first ``n`` calibration texts; rows of other splits are left out."""
    allowed = assert_calibration_splits(allowed or ["train", "calibration"])
    selected, _ = apply_split_policy(examples, allowed)
    return first_n(selected, order, n).select(
        "example_id",
        "split",
        F.concat(
            F.lit("Question: "), "question", F.lit("\nSchema:\n"), "schema_text"
        ).alias("text"),
    )


LENGTH_FRACTIONS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}
BUDGETS = [512, 768, 1024, 1536]  # fixed values: the prompt lengths reported on


def _lengths(examples: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    evidence = F.when(F.col("evidence") != "", count(F.col("evidence"))).otherwise(0)
    parts = {
        "schema": count(F.col("schema_text")),
        "evidence": evidence,
        "prompt": count(_prompt(F.col("schema_text"), False, "bird-v1")),
    }
    table = F.array(
        *[F.struct(F.lit(k).alias("part"), v.cast("bigint").alias("tokens")) for k, v in parts.items()]
    )
    return examples.select(F.inline(table))


def length_profile(
    examples: DataFrame, count: Callable[[Column], Column] = word_count
) -> DataFrame:
    """``part, name, value``: length percentiles of schema, evidence and prompt."""
    # Three numbers per example, at the price of reading every text.
    lengths = materialize(_lengths(examples, count), "lengths")
    return percentiles_nearest(lengths, ["part"], "tokens", LENGTH_FRACTIONS)


def over_budget(
    examples: DataFrame,
    count: Callable[[Column], Column] = word_count,
    budgets: list[int] = BUDGETS,
) -> DataFrame:
    """``budget, n_over, rate`` of prompts longer than each budget."""
    prompts = _lengths(examples, count).filter("part = 'prompt'")
    counts = prompts.agg(
        F.count("*").alias("n"),
        *[count_where(F.col("tokens") > b).alias(str(b)) for b in budgets],
    )
    return counts.unpivot(["n"], [str(b) for b in budgets], "budget", "n_over").select(
        F.col("budget").cast("bigint").alias("budget"),
        "n_over",
        F.when(F.col("n") > 0, F.col("n_over") / F.col("n")).otherwise(0.0).alias("rate"),
    )


def with_previous_attempt(candidates: DataFrame) -> DataFrame:
    """Each candidate's predecessor among its example's attempts, by index."""
    previous = candidates.select(
        "example_id",
        (F.col("candidate_index") + 1).alias("candidate_index"),
        F.struct(
            "parse_valid", "candidate_sql", "safe", "execution_success", "execution_equivalent",
            "execution_error_message_sanitized", "execution_error_type",
        ).alias("previous"),
    )
    return candidates.join(previous, ["example_id", "candidate_index"], "left")

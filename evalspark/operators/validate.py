"""Checks on examples and candidates, and the split rules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.aggregates import count_where
from evalspark.sources.schemas import (
    CALIBRATION_SPLITS,
    DB_ID_SHAPE,
    EVALUATION_SPLITS,
    EXAMPLE_ID_SHAPE,
    FORBIDDEN_TRAINING_SPLITS,
    SPLITS,
    TRAINING_SPLITS,
)

SHOWN = 10


class DataError(ValueError):
    """Input that breaks a rule."""


class SplitError(DataError):
    """A split that is unknown or not allowed here."""


def require_empty(rows: DataFrame, column: str, what: str, error: type = DataError) -> None:
    """Raise with a few of the offending values if there is any row."""
    found = [str(r[0]) for r in rows.select(column).limit(SHOWN).collect()]
    if found:
        raise error(f"{what}: {found}")


def _filled(name: str) -> Column:
    return F.coalesce(F.length(name), F.lit(0)) > 0


def _errors(rules: dict[str, Column]) -> Column:
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*broken))


def example_errors(examples: DataFrame) -> DataFrame:
    """Add ``errors``, the names of the fields that are not as they should be."""
    filled = ["question", "schema_text", "gold_sql", "source", "source_version"]
    rules = {name: _filled(name) for name in filled}
    rules["split"] = F.col("split").isin(SPLITS)
    rules["db_id"] = F.col("db_id").rlike(DB_ID_SHAPE)
    rules["example_id"] = F.col("example_id").rlike(EXAMPLE_ID_SHAPE)
    return examples.withColumn("errors", _errors(rules))


def candidate_errors(candidates: DataFrame) -> DataFrame:
    rules = {
        "candidate_index": F.col("candidate_index") >= 0,
        "raw_candidate_output": _filled("raw_candidate_output"),
    }
    flags = ["parse_valid", "safe", "execution_success", "execution_equivalent"]
    texts = ["example_id", "teacher_model", "teacher_prompt_version", "created_at"]
    rules |= {name: F.col(name).isNotNull() for name in flags + texts}
    return candidates.withColumn("errors", _errors(rules))


def duplicate_ids(examples: DataFrame, key: str = "example_id") -> DataFrame:
    return examples.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def split_mismatches(examples: DataFrame, declared: str | Column) -> DataFrame:
    declared = F.lit(declared) if isinstance(declared, str) else declared
    return examples.withColumn("declared_split", declared).filter(
        ~F.col("split").eqNullSafe(F.col("declared_split"))
    )


def assert_training_splits(allowed: Iterable[str]) -> list[str]:
    allowed = sorted(set(allowed))
    if allowed != TRAINING_SPLITS:
        raise SplitError(f"training may only use {TRAINING_SPLITS}, got {allowed}")
    return allowed


def assert_calibration_splits(allowed: Iterable[str]) -> list[str]:
    allowed = sorted(set(allowed))
    if not set(allowed) <= set(CALIBRATION_SPLITS):
        raise SplitError(f"calibration may only use {CALIBRATION_SPLITS}, got {allowed}")
    return allowed


def require_eval_split(split: str | None) -> str:
    if split not in EVALUATION_SPLITS:
        raise SplitError(f"name one of {EVALUATION_SPLITS}, got {split!r}")
    return split


def split_report(examples: DataFrame, allowed: list[str]) -> DataFrame:
    """Per split its rows and what a policy does with them."""
    training = sorted(set(allowed)) == TRAINING_SPLITS
    decision = (
        F.when(~F.coalesce(F.col("split").isin(SPLITS), F.lit(False)), "unknown")
        .when(F.lit(training) & F.col("split").isin(FORBIDDEN_TRAINING_SPLITS), "forbidden")
        .when(F.col("split").isin(allowed), "included")
        .otherwise("excluded")
    )
    return (
        examples.groupBy("split").agg(F.count("*").alias("n")).withColumn("decision", decision)
    )


def apply_split_policy(examples: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """The allowed rows and the report; unknown and forbidden splits raise.

    The check reads the report, which has one row per split, not the examples.
    """
    report = split_report(examples, allowed)
    bad = report.filter(F.col("decision").isin("unknown", "forbidden"))
    require_empty(bad, "split", f"policy {allowed} met", SplitError)
    return examples.filter(F.col("split").isin(allowed)), report


def select_split(examples: DataFrame, split: str | None) -> DataFrame:
    return examples.filter(F.col("split") == require_eval_split(split))


def training_source_violations(examples: DataFrame, validation_ids: DataFrame) -> DataFrame:
    """Rows that must not be trained on: a wrong split, or a validation id."""
    wrong = examples.filter(~F.col("split").isin(TRAINING_SPLITS)).select(
        "example_id", F.lit("split").alias("rule")
    )
    ids = validation_ids.select("example_id").distinct()
    leaked = (
        examples.select("example_id").distinct().join(ids, "example_id", "left_semi")
    ).select("example_id", F.lit("validation_id").alias("rule"))
    return wrong.unionByName(leaked)


def assert_formal_training_source(examples: DataFrame, validation_ids: DataFrame) -> None:
    require_empty(
        training_source_violations(examples, validation_ids),
        "example_id",
        "not allowed in training",
        SplitError,
    )


def calibration_violations(examples: DataFrame, allowed: list[str]) -> DataFrame:
    return examples.filter(~F.col("split").isin(allowed)).select("example_id", "split")


def missing_databases(required: DataFrame, registry: DataFrame) -> DataFrame:
    return required.select("db_id").distinct().join(registry, "db_id", "left_anti")


def registry_rollup(entries: DataFrame) -> DataFrame:
    """Counts over registry entries: ``path, readable, check_ok, schema_hash``."""
    found = F.col("path").isNotNull()
    readable = F.coalesce("readable", F.lit(False))
    return entries.agg(
        F.count("*").alias("required"),
        count_where(found).alias("resolved"),
        count_where(~found).alias("missing"),
        count_where(found & ~readable).alias("unreadable"),
        count_where(readable & ~F.coalesce("check_ok", F.lit(False))).alias("check_failed"),
        count_where(readable & F.col("schema_hash").isNull()).alias("unhashed"),
    )


def audit(
    examples: DataFrame,
    registry: DataFrame,
    violations: DataFrame,
    gold_runs: DataFrame,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """One row: sizes, rule violations, gold success and whether all is well.

    ``gold_runs`` has ``success`` per example, ``violations`` are rows of any rule.
    """
    # Counted per database first: a hot database is one row by the time it is joined.
    per_db = examples.groupBy("db_id").agg(F.count("*").alias("n"))
    unknown = per_db.join(registry.select("db_id").distinct(), "db_id", "left_anti")
    parts = [
        examples.agg(F.count("*").alias("examples"), F.count_distinct("split").alias("splits")),
        unknown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("missing_db")),
        violations.agg(F.count("*").alias("leaks")),
        gold_runs.agg(F.count("*").alias("gold_total"), count_where("success").alias("gold_success")),
    ]
    if candidates is not None:
        verified = F.expr("parse_valid and safe and execution_success and execution_equivalent")
        parts.append(
            candidates.agg(F.count("*").alias("candidates"), count_where(verified).alias("verified"))
        )
    return one_row(*parts).withColumn(
        "ok", F.expr("missing_db = 0 and leaks = 0 and gold_success = gold_total")
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Put the counts of one-row frames side by side as the columns of one row."""

    def long(part: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in part.columns]
        return part.select(F.inline(F.array(*cells)))

    names = [name for part in parts for name in part.columns]
    values = [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    return reduce(DataFrame.unionAll, map(long, parts)).agg(*values)


# All a generator may know besides the prompt.
MODEL_INPUTS = ["example_id", "db_id", "split"]


def model_inputs(rows: DataFrame) -> DataFrame:
    """What a generator is given: ids, split and prompt, never gold SQL or results."""
    return rows.select(*MODEL_INPUTS, "prompt")

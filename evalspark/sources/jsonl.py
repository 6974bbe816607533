"""Reading JSON Lines and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions.completions import parse_completion
from evalspark.operators import validate
from evalspark.session import materialize
from evalspark.sources import schemas

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL folder; blank lines are skipped and a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_with_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_jsonl``, but bad lines are kept in ``_corrupt`` with their file's name."""
    return (
        spark.read.schema(f"{schema}, {CORRUPT} string")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_name"))
    )


# Where a line stands: its file, where its part of the file begins, and its number among the
# lines of the task, which rises within the part.
PLACE = ["source_file", "_part", "_at"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines, blank ones too, as ``value`` with their ``PLACE`` and the folder's partition columns."""
    return spark.read.text(path).select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_part"),
        F.monotonically_increasing_id().alias("_at"),
    )


def with_line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Replace the ``PLACE`` of rows of ``lines`` by ``source_file`` and ``line``, from 1 on.

    Files are read in parts by many tasks. Each part counts its own lines; the parts before it
    in the file are added up, one small row per part.
    """
    parts = lines.groupBy("source_file", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("source_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    line = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return rows.join(starts, ["source_file", "_part"]).withColumn("line", line).drop("_part", "_at", "_first", "_before")


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """The record of each line that is not blank, with its place; ``_corrupt`` holds a bad line.

    A partition column takes the place of the record's field of that name, as Spark's readers have it.
    """
    # The parser's own limit would call a line bad for a text of over 20 million characters.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "maxStringLen": str(2**31 - 1)}
    record = F.from_json("value", f"{schema}, {CORRUPT} string", options)
    parsed = lines.filter(F.trim(F.regexp_replace("value", r"\s", " ")) != "").withColumn("_record", record)
    # A line that is JSON but no object is no record either.
    bad = F.coalesce(F.col(f"_record.{CORRUPT}"), F.when(~F.col("value").rlike(r"^\s*\{"), F.col("value")))
    folders = [c for c in lines.columns if c not in ("value", *PLACE)]
    fields = [c for c in parsed.select("_record.*").columns if c not in (CORRUPT, *folders)]
    return parsed.select(*[F.col(f"_record.`{c}`") for c in fields], *folders, *PLACE, bad.alias(CORRUPT))


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``source_file``, ``line`` and ``text`` of the lines that hold no record."""
    lines = read_lines(spark, path)
    bad = parse_lines(lines, schema).filter(F.col(CORRUPT).isNotNull())
    return with_line_numbers(bad.select(*PLACE, F.col(CORRUPT).alias("text")), lines).select(
        "source_file", "line", "text"
    )


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that each hold one JSON array."""
    return (
        spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    )


def _require_none(rows: DataFrame, lines: DataFrame, detail: Column, what: str) -> None:
    """Raise with the file and line of a few of the rows if there is any."""
    few = rows.select(*PLACE, detail.cast("string").alias("detail")).limit(validate.SHOWN)
    if few.isEmpty():
        return
    found = with_line_numbers(few, lines).orderBy("source_file", "line").collect()
    raise validate.DataError(f"{what}: " + "; ".join(f"{r.source_file}:{r.line} {r.detail}" for r in found))


def read_examples(
    spark: SparkSession, path: str, declared_split: str | None = None
) -> DataFrame:
    """Examples, checked: a bad line, a bad row, a wrong split or a repeated id raises.

    The source is read and parsed once, into a table that the checks and the result read. Only
    what a check finds is looked up in the source again, for its line numbers.
    """
    lines = read_lines(spark, path)
    parsed = parse_lines(lines, schemas.EXAMPLE).fillna({"evidence": ""})
    kept = materialize(validate.example_errors(parsed), "read-examples")
    _require_none(kept.filter(F.col(CORRUPT).isNotNull()), lines, F.substring(CORRUPT, 1, 80), "not a JSON object")
    told = F.concat_ws(" ", "example_id", F.array_join("errors", ","))
    _require_none(kept.filter(F.size("errors") > 0), lines, told, "bad example")
    if declared_split is not None:
        wrong = validate.split_mismatches(kept, declared_split)
        _require_none(wrong, lines, F.concat_ws(" ", "example_id", "split"), "split mismatch")
    twice = validate.duplicate_ids(kept)
    _require_none(kept.join(twice, "example_id", "left_semi"), lines, F.col("example_id"), "duplicate id")
    return kept.drop(CORRUPT, "errors", *PLACE)


def migrate_candidates(candidates: DataFrame) -> DataFrame:
    """Bring old rows, which kept the whole completion in ``candidate_sql``, up to date."""
    legacy = F.col("raw_candidate_output").isNull()
    old = F.when(legacy, F.coalesce("candidate_sql", F.lit("")))
    found = candidates.withColumn("_old", old).withColumn("_parse", parse_completion(F.col("_old")))
    filled = F.col("_old") != ""
    valid = F.col("_parse.sql").isNotNull() & F.col("_parse.parse_error").isNull()

    def instead(new: Column, name: str) -> Column:
        return F.when(legacy, new).otherwise(F.col(name))

    return found.withColumns(
        {
            "raw_candidate_output": F.coalesce("raw_candidate_output", "_old"),
            "candidate_sql": instead(F.when(filled, F.col("_parse.sql")), "candidate_sql"),
            "candidate_plan": instead(F.when(filled, F.col("_parse.plan")), "candidate_plan"),
            "parse_valid": F.when(legacy & filled, valid).otherwise(F.col("parse_valid")),
        }
    ).drop("_old", "_parse")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidates, migrated and checked."""
    candidates = migrate_candidates(read_jsonl(spark, path, schemas.CANDIDATE)).fillna(
        {"teacher_model_revision": "unknown", "attempt_index": 0}
    )
    validate.require_empty(
        validate.candidate_errors(candidates).filter(F.size("errors") > 0),
        "example_id",
        "bad candidate",
    )
    return candidates

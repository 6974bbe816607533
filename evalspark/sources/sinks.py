"""Writing examples, candidates and exports. Spark's commit protocol makes them atomic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the evaluator's prediction format.
EVAL_ID_PREFIX = "bird-dev-"
PREDICTION_MARK = "\t----- bird -----\t"
MISSING_PREDICTION = "SELECT 1"
# How a trainer finds the columns of the rows written by ``write_sft``.
SFT_COLUMNS = {"prompt": "instruction", "query": "input", "response": "output"}


_WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"
# Files that a task keeps open at once; one that meets more splits sorts what is left of its rows.
WRITERS = 32


def write_by_split(examples: DataFrame, path: str) -> None:
    """One folder of JSONL per split; a split without rows gets none.

    A task keeps a file per split open and writes its rows as they come. By default Spark sorts
    them by split first, which holds whole texts in memory beside what the scan holds.
    """
    conf = examples.sparkSession.conf
    before = conf.get(_WRITERS_CONF, None)
    conf.set(_WRITERS_CONF, str(WRITERS))
    try:
        examples.write.mode("error").partitionBy("split").json(path)
    finally:
        if before is None:
            conf.unset(_WRITERS_CONF)
        else:
            conf.set(_WRITERS_CONF, before)


def append_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_sft(rows: DataFrame, path: str, alias: str) -> dict:
    """Write instruction rows and return the descriptor a trainer needs for them."""
    rows.select("instruction", "input", "output").write.mode("error").json(path)
    return {alias: {"file_name": path.rsplit("/", 1)[-1], "columns": dict(SFT_COLUMNS)}}


def export_id(example_id: Column, question_id: Column) -> Column:
    """The number after the evaluation prefix, where there is one."""
    number = F.regexp_extract(example_id, rf"^{EVAL_ID_PREFIX}(\d+)$", 1)
    bare = F.regexp_replace(number, r"^0+(?=\d)", "")
    return F.coalesce(question_id.cast("string"), F.when(number != "", bare), example_id)


def predictions(records: DataFrame) -> DataFrame:
    """``question_id, db_id, SQL``; the id is a JSON number where ``is_number`` holds."""
    question_id = export_id(F.col("example_id"), F.col("question_id"))
    return records.select(
        question_id.alias("question_id"),
        question_id.rlike(r"^\d+$").alias("is_number"),
        "db_id",
        "SQL",
    )


def prediction_lines(records: DataFrame) -> DataFrame:
    """One JSON text per prediction, numeric ids without quotes."""
    row = predictions(records)
    number = F.col("question_id").try_cast("bigint").alias("question_id")
    numeric = F.to_json(F.struct(number, "db_id", "SQL"))
    return row.select(
        F.when(F.col("is_number"), numeric)
        .otherwise(F.to_json(F.struct("question_id", "db_id", "SQL")))
        .alias("value")
    )


def write_predictions(records: DataFrame, path: str) -> None:
    prediction_lines(records).write.mode("error").text(path)


def prediction_map(records: DataFrame) -> DataFrame:
    """Evaluator entries; a missing prediction counts as wrong through a placeholder."""
    last = F.element_at(F.split("example_id", "-"), -1)
    number = F.regexp_replace(last, r"^0+(?=\d)", "")
    missing = F.coalesce("sql", F.lit("")) == ""
    sql = F.when(missing, MISSING_PREDICTION).otherwise(F.col("sql"))
    return records.select(
        F.when(last.rlike(r"^\d+$"), number).otherwise(last).alias("question_id"),
        F.concat(sql, F.lit(PREDICTION_MARK), "db_id").alias("prediction"),
        missing.alias("missing"),
    )


def verified_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.filter("execution_equivalent")


def union_candidates(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)

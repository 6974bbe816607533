"""Running a workload of SQL texts on Spark and logging what became of each.

Queries are jobs, so they are submitted from the driver, a few at a time. Each has a scheduler
pool of its own: in a session with ``spark.scheduler.mode=FAIR`` a short query gets its share of
the cores beside long ones. Their results go from the executors straight to a table; the driver
keeps one line per query.
"""

from __future__ import annotations

import threading
import time
import uuid
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.functions.screening import screen
from evalspark.operators.equivalence import RUNS_SENT, cache_lookup, cells
from evalspark.session import scratch_path

TIMEOUT_MS = 30_000
RUN_SCHEMA = (
    "example_id string, candidate_index int, sql string, success boolean, "
    "columns array<string>, error_type string, error_message string, duration_ms double, "
    "timed_out boolean, row_count bigint, truncated boolean"
)
ROW_SCHEMA = (
    "example_id string, candidate_index int, row_idx bigint, "
    "cells array<struct<tag:string,num:double,str:string>>"
)
_FLUSH = 1000
_TIMED_OUT = 8  # place of ``timed_out`` in a line of the log


def _error(exception: Exception) -> tuple[str, str]:
    condition = exception.getCondition() if isinstance(exception, PySparkException) else None
    return condition or type(exception).__name__, str(exception)


def _failed(row, kind: str, message: str, started: float, timed_out: bool = False) -> tuple:
    spent = (time.monotonic() - started) * 1000
    return (
        row.example_id, row.candidate_index, row.sql, False, None, kind, message, spent, timed_out,
        0, False,
    )


def _run_query(
    spark: SparkSession, row, rows_path: str, max_rows: int | None, timeout_ms: int
) -> tuple:
    """Run one query, append its rows, and return its line of the log."""
    started = time.monotonic()
    tag = f"workload-{uuid.uuid4().hex}"
    context = spark.sparkContext
    expired = threading.Event()

    def interrupt() -> None:
        expired.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_ms / 1000, interrupt)
    # As many pools as threads, however many queries there are.
    context.setLocalProperty("spark.scheduler.pool", threading.current_thread().name)
    context.addJobTag(tag)
    timer.start()
    try:
        result = spark.sql(row.sql)
        names = result.columns
        unique = [f"c{i}" for i in range(len(names))]
        renamed = result.toDF(*unique)
        # A limit ends in one task of at most max_rows + 1 rows, in the query's order.
        capped = renamed if max_rows is None else renamed.limit(max_rows + 1).coalesce(1)
        path = f"{rows_path}/query={tag}"
        seen = Observation()
        capped.observe(seen, F.count(F.lit(1)).alias("n")).select(
            F.lit(row.example_id).alias("example_id"),
            F.lit(row.candidate_index).cast("int").alias("candidate_index"),
            # Grows with the task, so it keeps a sorted result's order; _dense closes the gaps.
            F.monotonically_increasing_id().alias("row_idx"),
            cells(capped, unique).alias("cells"),
        ).write.parquet(path)
        found = seen.get["n"]
        truncated = max_rows is not None and found > max_rows
        count = min(found, max_rows) if max_rows is not None else found
        spent = (time.monotonic() - started) * 1000
        return (
            row.example_id, row.candidate_index, row.sql, True, names, "none", "", spent, False,
            count, truncated,
        )
    except Exception as exception:  # noqa: BLE001  a failing query is a line of the log
        if expired.is_set():
            return _failed(row, "timeout", f"over {timeout_ms} ms", started, timed_out=True)
        return _failed(row, *_error(exception), started)
    finally:
        timer.cancel()
        context.removeJobTag(tag)
        context.setLocalProperty("spark.scheduler.pool", None)


def _sent(lines: DataFrame, count: int | None = None) -> DataFrame:
    """Lines to be joined with rows, sent to every task unless they are very many."""
    count = lines.count() if count is None else count
    return F.broadcast(lines) if count <= RUNS_SENT else lines


# Bits of a row's number that hold its place within its task; the task is above them.
_PLACE_BITS = 33


def _dense(rows: DataFrame) -> DataFrame:
    """The rows of all results, each result numbered from 0 without gaps in its own order.

    A row's place is the number of rows of the earlier tasks of its query plus its place
    within its task, so one count per query and task is all that is summed up.
    """
    located = rows.withColumn("task", F.shiftright("row_idx", _PLACE_BITS))
    before = (
        Window.partitionBy("query")
        .orderBy("task")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        located.groupBy("query", "task")
        .agg(F.count("*").alias("n"))
        .select("query", "task", F.sum("n").over(before).alias("start"))
        .filter("start > 0")
    )
    place = F.col("row_idx").bitwiseAND(F.lit(2**_PLACE_BITS - 1))
    # One line per file is sent to the rows; shuffled, a whole task's rows would meet it in one task.
    starts = _sent(starts, len(rows.inputFiles()))
    return located.join(starts, ["query", "task"], "left").select(
        "example_id",
        "candidate_index",
        (F.coalesce("start", F.lit(0)) + place).alias("row_idx"),
        "cells",
    )


def run_workload(
    spark: SparkSession,
    workload: DataFrame,
    max_rows: int | None = None,
    timeout_ms: int = TIMEOUT_MS,
    threads: int = 8,
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run ``example_id, candidate_index, sql`` and return the runs and the result rows.

    A row that is not one read-only statement is logged as such and never run. Queries
    that timed out beside others, which may have held all cores, are run again one by one
    when the others are through. ``max_rows`` cuts each result and marks it as truncated;
    without it results are kept whole.
    """
    path = path or scratch_path(spark, "workload")
    rows_path, runs_path = f"{path}/rows", f"{path}/runs"
    screened = workload.select(
        "example_id", "candidate_index", "sql", screen(F.col("sql")).alias("safety")
    )

    def run(row) -> tuple:
        started = time.monotonic()
        if row.safety is None or not row.safety.safe:
            kind = row.safety.error_type if row.safety else "format_error"
            return _failed(row, kind, "not run", started)
        return _run_query(spark, row, rows_path, max_rows, timeout_ms)

    spark.createDataFrame([], RUN_SCHEMA).write.mode("append").parquet(runs_path)

    lines: list = []
    slow: list = []

    def flush() -> None:
        if lines:
            spark.createDataFrame(lines, RUN_SCHEMA).coalesce(1).write.mode("append").parquet(
                runs_path
            )
            lines.clear()

    def keep(finished) -> None:
        for row, line in (f.result() for f in finished):
            if line[_TIMED_OUT]:
                slow.append(row)
            else:
                lines.append(line)
        if len(lines) >= _FLUSH:
            flush()

    # With more pools than cores the scheduler would settle ties by name, and the last one starve.
    threads = min(threads, spark.sparkContext.defaultParallelism)
    with ThreadPoolExecutor(threads, thread_name_prefix="workload") as pool:
        # Query texts arrive partition by partition; a new one starts as soon as one ends.
        waiting: set = set()
        for row in screened.toLocalIterator(prefetchPartitions=True):
            waiting.add(pool.submit(lambda row=row: (row, run(row))))
            if len(waiting) >= 2 * threads:
                done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                keep(done)
        keep(waiting)
    lines += [run(row) for row in slow]
    flush()
    runs = spark.read.schema(RUN_SCHEMA).parquet(runs_path)
    if runs.filter("success").limit(1).count() == 0:
        return runs, spark.createDataFrame([], ROW_SCHEMA)
    rows = _dense(spark.read.schema(f"{ROW_SCHEMA}, query string").parquet(rows_path))
    return runs, rows if max_rows is None else rows.filter(F.col("row_idx") < max_rows)


def run_gold(
    spark: SparkSession, gold: DataFrame, store: str, **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``run_workload`` for gold, reusing what earlier calls left in the folder ``store``.

    ``gold`` has ``example_id, candidate_index, sql`` and the ``cache_key`` of
    ``equivalence.cache_key``. Returns the runs, the rows and the keys that were reused.
    Whole results are kept under their keys; failed or cut ones run again. A call's rows
    are written under its own batch and before its runs, so a call that breaks off leaves
    nothing that is read. Rows meet lines of runs, which are sent to them: shuffled by their
    result's key, a long result would be one task's.
    """
    names = ["example_id", "candidate_index"]
    stored_rows, stored_runs = f"{ROW_SCHEMA}, cache_key string, batch string", f"{RUN_SCHEMA}, cache_key string, batch string"
    for part, schema in (("rows", stored_rows), ("runs", stored_runs)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{store}/{part}")
    hits, misses = cache_lookup(gold, spark.read.schema(stored_runs).parquet(f"{store}/runs"))
    runs, rows = run_workload(spark, misses.select(*names, "sql"), **options)
    keyed = misses.select(*names, "cache_key").withColumn("batch", F.lit(uuid.uuid4().hex))
    whole = F.col("success") & ~F.col("truncated")
    kept = runs.filter(whole).join(keyed, names)
    kept_rows = rows.join(_sent(kept.select(*names, "cache_key", "batch")), names)
    kept_rows.write.mode("append").parquet(f"{store}/rows")
    kept.write.mode("append").parquet(f"{store}/runs")

    # Of calls that ran the same gold side by side, the first batch counts.
    found = spark.read.schema(stored_runs).parquet(f"{store}/runs")
    wanted = found.join(gold.select("cache_key").distinct(), "cache_key", "left_semi")
    chosen = wanted.groupBy("cache_key").agg(F.min("batch").alias("batch"))
    key = ["cache_key", "batch"]
    again = runs.filter(~whole)
    old_rows = spark.read.schema(stored_rows).parquet(f"{store}/rows")
    return (
        wanted.join(chosen, key, "left_semi").drop(*key).unionByName(again),
        old_rows.join(_sent(chosen), key, "left_semi").drop(*key).unionByName(
            rows.join(_sent(again.select(*names)), names, "left_semi")
        ),
        hits.select("cache_key"),
    )


# Spark's error conditions in the words that ``screening.message_bucket`` looks for.
_CONDITION_WORDS = {
    "TABLE_OR_VIEW_NOT_FOUND": "no such table",
    "UNRESOLVED_COLUMN": "no such column",
    "AMBIGUOUS_REFERENCE": "ambiguous column",
    "MISSING_AGGREGATION": "group by",
    "MISSING_GROUP_BY": "group by",
    "GROUP_BY_AGGREGATE": "group by",
}


def logged_message() -> Column:
    """A run's error message, led by the words its error condition stands for."""
    condition = F.coalesce("error_type", F.lit(""))
    words = F.coalesce(
        *[F.when(condition.startswith(c), F.lit(w)) for c, w in _CONDITION_WORDS.items()],
        F.lit(None).cast("string"),
    )
    return F.concat_ws(": ", words, F.when(words.isNull(), F.col("error_message")))


def run_summary(runs: DataFrame) -> DataFrame:
    """``outcome, n`` of a workload run."""
    outcome = F.when(F.col("success"), "success").otherwise(F.col("error_type"))
    return runs.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))

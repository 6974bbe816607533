"""The workload's shapes, its audit, and the flagship: judging a whole evaluation run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.completions import parse_completion
from evalspark.operators import equivalence, metrics, scoring, workload
from evalspark.plans.adapters import BASE
from evalspark.plans.registry import Tables, query
from evalspark.plans.workload import EVALUATION, SHAPES
from evalspark.session import scratch_path
from evalspark.sources import catalog


def _shape(name: str, text: str):
    used = [table for table in BASE if re.search(rf"\b{table}\b", text)]
    marked = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", r"\1 {\2}", text)

    @query(name, text)
    def run(t: Tables):
        """A query shape of the workload."""
        return t.spark.sql(marked, **{table: getattr(t, table) for table in used})

    return run


for _name, _text in SHAPES.items():
    _shape(_name, _text)


def register_views(t: Tables) -> None:
    for name in BASE:
        getattr(t, name).createOrReplaceTempView(name)


def _workload(t: Tables, rows: list[tuple[str, int, str]]) -> DataFrame:
    return t.spark.createDataFrame(rows, "example_id string, candidate_index int, sql string")


_BROKEN = {
    "bad-table": ("SELECT * FROM nowhere", "TABLE_OR_VIEW_NOT_FOUND"),
    "bad-column": ("SELECT nothing FROM orders", "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
    "not-a-read": ("UPDATE orders SET o_custkey = 1", "unsafe_sql"),
    "not-sql": ("hello there", "syntax_error"),
}


@query(
    "workload_audit",
    "\nUNION ALL ".join(
        [
            f"""SELECT '{name}' AS example_id, true AS success, 'none' AS error_type,
              count(*) AS row_count, false AS truncated FROM ({text})"""
            for name, text in SHAPES.items()
        ]
        + [f"SELECT '{k}', false, '{kind}', 0, false" for k, (_, kind) in _BROKEN.items()]
    ),
)
def workload_audit(t: Tables):
    """Every shape run as a workload query: what became of it and how many rows it gave."""
    register_views(t)
    texts = {**SHAPES, **{k: text for k, (text, _) in _BROKEN.items()}}
    rows = [(name, 0, text) for name, text in texts.items()]
    runs, _ = workload.run_workload(t.spark, _workload(t, rows))
    return runs.select("example_id", "success", "error_type", "row_count", "truncated")


_REUSED = {
    name: SHAPES[name] for name in ("w_projection", "w_join_group", "w_order")
}


@query(
    "gold_reuse",
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS example_id, count(*) AS row_count, true AS reused FROM ({text})"
        for name, text in _REUSED.items()
    ),
)
def gold_reuse(t: Tables):
    """Gold run once and judged with again: the second call reads the stored rows."""
    register_views(t)
    gold = _workload(t, [(name, 0, text) for name, text in _REUSED.items()])
    dataset, print_of = F.lit("0" * 64), F.lit(None).cast("string")
    key = equivalence.cache_key(dataset, print_of, F.lit("tables"), F.col("example_id"), F.col("sql"))
    keyed = gold.withColumn("cache_key", key)
    store = scratch_path(t.spark, "gold")
    workload.run_gold(t.spark, keyed, store)
    _, rows, hits = workload.run_gold(t.spark, keyed, store)
    reused = keyed.join(hits.withColumn("reused", F.lit(True)), "cache_key", "left")
    counts = rows.groupBy("example_id").agg(F.count("*").alias("row_count"))
    return reused.join(counts, "example_id", "left").select(
        "example_id",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("reused", F.lit(False)).alias("reused"),
    )


def evaluation_run(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Completions of the evaluation workload, parsed, and the verdicts of what was run."""
    register_views(t)
    spark = t.spark
    gold = [(example, 0, sql) for example, (sql, _) in EVALUATION.items()]
    answers = [
        (example, k, gold_sql, f"<sql>\n{sql}\n</sql>")
        for example, (gold_sql, candidates) in EVALUATION.items()
        for k, (sql, _) in enumerate(candidates)
    ]
    completions = spark.createDataFrame(
        answers, "example_id string, candidate_index int, gold_sql string, raw string"
    ).withColumn("sql", parse_completion(F.col("raw"))["sql"])
    gold_runs, gold_rows = workload.run_workload(spark, _workload(t, gold))
    runs, rows = workload.run_workload(
        spark, completions.select("example_id", "candidate_index", "sql")
    )
    names = catalog.table_names(catalog.catalog_of_views(spark, "tables"))
    known = names.select(F.col("tables").alias("schema_tables"), F.lit(1).alias("_one"))
    gold_known = gold_runs.withColumn("_one", F.lit(1)).join(known, "_one").drop("_one")
    judged = equivalence.verdicts(runs, gold_known, rows, gold_rows.drop("candidate_index"))
    header = runs.select(
        "example_id", "candidate_index", "success", "timed_out", "error_type", "error_message", "duration_ms"
    )
    keys = ["example_id", "candidate_index"]
    timed = completions.join(runs.select(*keys, F.col("duration_ms").alias("latency_ms")), keys, "left")
    return timed, judged.join(header, keys)


_KIND = {
    (example, k): kind
    for example, (_, candidates) in EVALUATION.items()
    for k, (_, kind) in enumerate(candidates)
}
_NOT_RUN = ("unsafe_sql", "syntax_error")


def _checked_equal(example: str, k: int) -> str:
    """SQL that decides equality where it is a matter of the rows."""
    gold, candidates = EVALUATION[example]
    mine, kind = candidates[k]
    if kind == "unordered_rows":
        g = f"SELECT a, round(b, 6) FROM ({gold}) AS g(a, b)" if "," in gold.split("FROM")[0] else gold
        m = f"SELECT a, round(b, 6) FROM ({mine}) AS m(a, b)" if "," in gold.split("FROM")[0] else mine
        return f"NOT EXISTS ((({g}) EXCEPT ALL ({m})) UNION ALL (({m}) EXCEPT ALL ({g})))"
    if kind == "ordered_rows":
        names = "abcd"[: gold.split("FROM")[0].count(",") + 1]
        columns = ", ".join(names)
        g, m = (
            f"(SELECT list(row({columns})) FROM ({sql}) AS x({columns}))" for sql in (gold, mine)
        )
        return f"{g} = {m}"
    return "false"


@query(
    "workload_verdicts",
    "\nUNION ALL ".join(
        f"""SELECT '{example}' AS example_id, {k}::INTEGER AS candidate_index, {_checked_equal(example, k)} AS strict_equivalent,
          '{'not_equivalent' if kind in _NOT_RUN else kind}' AS kind,
          {str(kind == 'empty_structural_partial').lower()} AS partial_credit"""
        for (example, k), kind in _KIND.items()
    ),
)
def workload_verdicts(t: Tables):
    """Candidates run beside gold on Spark and judged by their results."""
    _, judged = evaluation_run(t)
    return judged.select(
        "example_id", "candidate_index", "strict_equivalent", "kind", "partial_credit"
    )


def _bucket(kind: str, example: str, k: int) -> str:
    if kind in _NOT_RUN:
        return kind
    sql = EVALUATION[example][1][k][0]
    if "clients" in sql:
        return "wrong_table"
    if "o_price" in sql:
        return "wrong_column"
    return "none" if kind in ("unordered_rows", "ordered_rows") else "wrong_result"


@query(
    "workload_evaluation",
    "SELECT error_bucket, count(*) AS n FROM (VALUES "
    + ", ".join(f"('{_bucket(kind, e, k)}')" for (e, k), kind in _KIND.items())
    + ") AS v(error_bucket) GROUP BY error_bucket",
)
def workload_evaluation(t: Tables):
    """Evaluation records of the run, by error bucket."""
    return metrics.bucket_counts(evaluation_of(t))


def evaluation_of(t: Tables) -> DataFrame:
    completions, judged = evaluation_run(t)
    texts = completions.select(
        "example_id",
        "candidate_index",
        "raw",
        F.lit("dev").alias("split"),
        F.lit("tables").alias("db_id"),
        "gold_sql",
        "latency_ms",
    )
    told = judged.withColumn("error_message", workload.logged_message())
    return scoring.evaluation_records(scoring.parsed(texts, "raw"), told)

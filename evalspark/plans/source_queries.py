"""Reading and writing. Files go to the shared folder and are read back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from evalspark.plans.registry import Tables, query
from evalspark.session import scratch_path
from evalspark.sources import catalog, jsonl, schemas, sinks


@query(
    "split_files",
    """SELECT split, count(*) AS n, CAST(sum(length(question)) AS BIGINT) AS chars,
      CAST(sum(length(gold_sql)) AS BIGINT) AS sql_chars FROM examples GROUP BY split""",
    "examples",
)
def split_files(t: Tables):
    """Examples written as JSONL per split, read back and checked."""
    path = scratch_path(t.spark, "examples")
    sinks.write_by_split(t.adapted("examples").drop("ord"), path)
    examples = jsonl.read_examples(t.spark, path)
    return examples.groupBy("split").agg(
        F.count("*").alias("n"),
        F.sum(F.length("question")).alias("chars"),
        F.sum(F.length("gold_sql")).alias("sql_chars"),
    )


@query(
    "bad_lines",
    """SELECT CASE doc_id % 3 WHEN 0 THEN 'row' WHEN 1 THEN 'corrupt' END AS kind, count(*) AS n,
      CAST(sum(length(text)) FILTER (doc_id % 3 = 0) AS BIGINT) AS chars FROM documents WHERE doc_id % 3 <> 2 GROUP BY 1""",
)
def bad_lines(t: Tables):
    """A folder of good, corrupt and blank lines: blank ones vanish, corrupt ones are kept apart."""
    path = scratch_path(t.spark, "lines")
    good = F.to_json(F.struct(F.col("doc_id").alias("ord"), "text"))
    line = F.when(F.col("doc_id") % 3 == 0, good).when(F.col("doc_id") % 3 == 1, F.substring(good, 1, 9))
    t.documents.select(F.coalesce(line, F.lit("  ")).alias("value")).write.text(path)
    rows = jsonl.read_jsonl_with_bad(t.spark, path, "ord bigint, text string")
    kind = F.when(F.col(jsonl.CORRUPT).isNull(), "row").otherwise("corrupt")
    return rows.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "bad_line_numbers",
    """SELECT doc_id, true AS found_there FROM documents WHERE doc_id % 3 = 1""",
)
def bad_line_numbers(t: Tables):
    """Corrupt lines are reported at their place in their file, whichever task has read them.

    Each line says itself which line of its file it is; corrupt ones break off behind that.
    """
    path = scratch_path(t.spark, "numbered")
    # The low bits count the rows of a task, which writes one file; more rows are more files.
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
    placed = t.documents.withColumn("place", number)
    good = F.to_json(F.struct("place", F.col("doc_id").alias("ord"), "text"))
    broken = F.format_string('{"place":%d,"ord":%d,"text":', "place", "doc_id")
    line = F.when(F.col("doc_id") % 3 == 0, good).when(F.col("doc_id") % 3 == 1, broken).otherwise(" ")
    placed.select(line.alias("value")).write.text(path)
    bad = jsonl.bad_lines(t.spark, path, "place bigint, ord bigint, text string")
    said = F.regexp_extract("text", r'"place":(\d+),"ord":(\d+)', 1).cast("bigint")
    return bad.select(
        F.regexp_extract("text", r'"place":(\d+),"ord":(\d+)', 2).cast("bigint").alias("doc_id"),
        (F.col("line") == said).alias("found_there"),
    )


@query(
    "raw_source",
    """SELECT source AS db_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""",
)
def raw_source(t: Tables):
    """A raw training source in JSONL."""
    path = scratch_path(t.spark, "raw")
    t.documents.select(
        F.col("source").alias("db_id"), F.col("text").alias("question"), F.lit("SELECT 1").alias("SQL")
    ).write.json(path)
    raw = jsonl.read_jsonl(t.spark, path, schemas.RAW_SOURCE)
    return raw.groupBy("db_id").agg(F.count("*").alias("n"), F.sum(F.length("question")).alias("chars"))


@query(
    "json_documents",
    """SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""",
)
def json_documents(t: Tables):
    """Files that each hold one JSON array of records, here a file per task of the writer."""
    path = scratch_path(t.spark, "arrays")
    turn = F.struct(F.col("conv_id").cast("string").alias("db_id"), F.col("text").alias("question"))
    records = t.conversations.select(F.to_json(turn).alias("value"))
    records.mapInArrow(_as_array, "value string").write.text(path)
    read = jsonl.read_json_document(t.spark, path, schemas.RAW_SOURCE)
    return read.groupBy(F.col("db_id").cast("bigint").alias("conv_id")).agg(
        F.count("*").alias("n"), F.sum(F.length("question")).alias("chars")
    )


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of records with the brackets and commas of one array around them."""
    start = "["
    for batch in batches:
        for line in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_pydict({"value": [start + line]})
            start = ","
    yield pa.RecordBatch.from_pydict({"value": ["[]" if start == "[" else "]"]})


@query(
    "legacy_candidates",
    """, x AS (SELECT *, (conv_id * 7 + turn) % 14 AS v FROM completions)
    SELECT example_id, candidate_index, raw AS raw_candidate_output,
      CASE v WHEN 0 THEN 'SELECT o_totalprice FROM orders WHERE o_custkey = ' || conv_id
        WHEN 1 THEN 'SELECT COUNT(*) FROM orders ORDER BY 1;'
        WHEN 2 THEN 'SELECT o_totalprice FROM orders, customer c WHERE o_custkey = ' || turn
        WHEN 3 THEN 'SELECT turn FROM conversations WHERE text = ''a;b''' WHEN 8 THEN 'DROP TABLE orders'
        WHEN 9 THEN 'SELECT 1; DELETE FROM orders' WHEN 10 THEN 'SELECT text FROM conversations -- x; y'
        WHEN 12 THEN 'SELEC 1 FROM'
        WHEN 13 THEN 'WITH t AS (SELECT REPLACE(c_name, ''a'', ''b'') AS n FROM customer) SELECT n FROM t' END AS candidate_sql,
      CASE WHEN v = 1 THEN 'tables: orders' END AS candidate_plan, v IN (0, 1, 2, 8, 9, 10, 12, 13) AS parse_valid FROM x""",
    "completions",
)
def legacy_candidates(t: Tables):
    """Old candidate files, which kept the completion in the SQL field, read and migrated."""
    path = scratch_path(t.spark, "legacy")
    t.adapted("completions").select(
        "example_id",
        "candidate_index",
        F.col("raw").alias("candidate_sql"),
        F.lit("teacher-1").alias("teacher_model"),
        F.lit("v1").alias("teacher_prompt_version"),
        F.lit("2024-01-01").alias("created_at"),
        *[
            F.lit(True).alias(c)
            for c in ("parse_valid", "safe", "execution_success", "execution_equivalent")
        ],
    ).write.json(path)
    return jsonl.read_candidates(t.spark, path).select(
        "example_id",
        "candidate_index",
        "raw_candidate_output",
        "candidate_sql",
        "candidate_plan",
        "parse_valid",
    )


@query(
    "registry",
    """, d AS (SELECT DISTINCT source FROM documents)
    SELECT source AS db_id, 'db/' || source || '.sqlite' AS path, true AS valid FROM d
    UNION ALL SELECT 'up-' || source, 'db/../../' || source, false FROM d
    UNION ALL SELECT 'in-' || source, './db/../' || source, true FROM d
    UNION ALL SELECT 'abs-' || source, '/db/' || source, false FROM d
    UNION ALL SELECT 'bad.' || source, 'db/' || source, false FROM d""",
    "examples",
)
def registry(t: Tables):
    """Registry entries, and which of them are well formed and stay in their folder."""
    source = F.col("source")
    entries = {
        "": F.concat(F.lit("db/"), source, F.lit(".sqlite")),
        "up-": F.concat(F.lit("db/../../"), source),
        "in-": F.concat(F.lit("./db/../"), source),
        "abs-": F.concat(F.lit("/db/"), source),
        "bad.": F.concat(F.lit("db/"), source),
    }
    pairs = [x for p, path in entries.items() for x in (F.concat(F.lit(p), source), path)]
    databases = F.create_map(*pairs)
    # One registry document per source.
    documents = t.documents.select("source").distinct().select(
        F.to_json(F.struct(databases.alias("databases"))).alias("document")
    )
    path = scratch_path(t.spark, "registry")
    documents.repartition("document").write.text(path)
    lines = t.spark.read.text(path).withColumnRenamed("value", "document")
    return catalog.parse_registry(lines)


@query(
    "schema_text",
    """SELECT db_id, string_agg(trim(ddl), chr(10) ORDER BY name) AS schema_text FROM catalog
    WHERE type IN ('table', 'view') GROUP BY db_id""",
    "catalog",
)
def schema_text(t: Tables):
    """The schema text of every database."""
    return catalog.schema_text(t.adapted("catalog"))


@query(
    "table_names",
    "SELECT db_id, string_agg(name, ',' ORDER BY name) AS tables FROM catalog WHERE type = 'table' GROUP BY db_id",
    "catalog",
)
def table_names(t: Tables):
    """The table names of every database."""
    names = catalog.table_names(t.adapted("catalog"))
    return names.select("db_id", F.array_join("tables", ",").alias("tables"))


@query(
    "append_log",
    "SELECT generation_group_id, count(*) AS n, round(sum(reward), 4) AS total FROM samples GROUP BY 1",
    "samples",
)
def append_log(t: Tables):
    """A reward log appended to in two steps and read as one."""
    path = scratch_path(t.spark, "log")
    samples = t.adapted("samples").select("generation_group_id", "reward")
    for part in ("reward < 0", "reward >= 0 or reward is null"):
        sinks.append_records(samples.filter(part), path)
    log = jsonl.read_jsonl(t.spark, path, schemas.REWARD_SAMPLE)
    return log.groupBy("generation_group_id").agg(
        F.count("*").alias("n"), F.round(F.sum("reward"), 4).alias("total")
    )


@query(
    "sft_files",
    """SELECT '' AS instruction, md5(question) AS input, '<sql>' || chr(10) || gold_sql || chr(10) || '</sql>' AS output
    FROM examples""",
    "examples",
)
def sft_files(t: Tables):
    """Instruction rows written for a trainer and read back by its column names."""
    path = scratch_path(t.spark, "sft")
    rows = t.adapted("examples").select(
        F.lit("").alias("instruction"),
        F.col("question").alias("input"),
        F.concat(F.lit("<sql>\n"), "gold_sql", F.lit("\n</sql>")).alias("output"),
    )
    descriptor = sinks.write_sft(rows, path, "examples")
    names = list(descriptor["examples"]["columns"].values())
    read = jsonl.read_jsonl(t.spark, path, ", ".join(f"{n} string" for n in names))
    return read.withColumn("input", F.md5("input"))


@query(
    "prediction_export",
    """SELECT CASE WHEN ord % 3 = 0 THEN '{"question_id":' || ord || ',' WHEN ord % 3 = 1 THEN '{"question_id":' || (ord + 7) || ','
      ELSE '{"question_id":"' || example_id || '",' END || '"db_id":"' || db_id || '","SQL":"' || gold_sql || '"}' AS value
    FROM examples""",
    "examples",
)
def prediction_export(t: Tables):
    """Predictions in the evaluator's line format."""
    path = scratch_path(t.spark, "predictions")
    ord_ = F.col("ord")
    records = t.adapted("examples").select(
        F.when(ord_ % 3 == 0, F.concat(F.lit(sinks.EVAL_ID_PREFIX + "0"), ord_))
        .otherwise(F.col("example_id"))
        .alias("example_id"),
        F.when(ord_ % 3 == 1, ord_ + 7).alias("question_id"),
        "db_id",
        F.col("gold_sql").alias("SQL"),
    )
    sinks.write_predictions(records, path)
    return t.spark.read.text(path)


@query(
    "prediction_map",
    """SELECT CAST(ord AS VARCHAR) AS question_id, CASE WHEN ord % 4 = 0 THEN 'SELECT 1' WHEN ord % 4 = 1 THEN 'SELECT 1'
      ELSE gold_sql END || chr(9) || '----- bird -----' || chr(9) || db_id AS prediction, ord % 4 < 2 AS missing FROM examples""",
    "examples",
)
def prediction_map(t: Tables):
    """Evaluator entries, with a placeholder for what is missing."""
    sql = F.when(F.col("ord") % 4 == 0, "").when(F.col("ord") % 4 > 1, F.col("gold_sql"))
    return sinks.prediction_map(t.adapted("examples").withColumn("sql", sql))


@query(
    "verified_candidates",
    "SELECT example_id, candidate_index, candidate_sql FROM candidates WHERE execution_equivalent",
    "candidates",
)
def verified_candidates(t: Tables):
    """Candidates that passed, from file to file."""
    path = scratch_path(t.spark, "verified")
    sinks.append_records(sinks.verified_candidates(t.adapted("candidates")), path)
    return jsonl.read_jsonl(t.spark, path, schemas.CANDIDATE).select(
        "example_id", "candidate_index", "candidate_sql"
    )


@query(
    "candidate_union",
    """SELECT example_id, candidate_index, CASE WHEN attempt_index > 0 THEN created_at END AS created_at FROM candidates""",
    "candidates",
)
def candidate_union(t: Tables):
    """Candidates of two collections, one of which lacks a column."""
    candidates = t.adapted("candidates").select(
        "example_id", "candidate_index", "attempt_index", "created_at"
    )
    first = candidates.filter("attempt_index = 0").drop("created_at")
    both = sinks.union_candidates(first, candidates.filter("attempt_index > 0"))
    return both.drop("attempt_index")

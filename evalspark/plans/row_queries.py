"""Prompts, training rows and paired targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import prompts
from evalspark.operators import rows, sampling
from evalspark.plans.registry import Tables, query

_HEAD = """'Translate the following question into one SQLite SQL query for the database ''' || db_id || '''.'"""
_NL2 = "chr(10) || chr(10)"


def _sql_text(value: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in value.split("\n"))


def prompt_sql(schema: str, spec: str) -> str:
    return f"""{_HEAD} || {_NL2} || 'Database schema:' || chr(10) || {schema} || {_NL2} || 'Question: ' || question
      || CASE WHEN evidence <> '' THEN {_NL2} || 'Evidence: ' || evidence ELSE '' END || {_NL2} || {_sql_text(spec)}"""


@query(
    "prompts",
    f"""SELECT example_id, db_id, md5({prompt_sql('schema_text', prompts.PROTOCOL_PLAN)}) AS prompt,
      false AS prompt_truncated FROM examples""",
    "examples",
)
def prompt_rows(t: Tables):
    """Digest of every prompt with the plan protocol."""
    return rows.prompt_rows(t.adapted("examples"), include_plan=True).withColumn(
        "prompt", F.md5("prompt")
    )


@query(
    "prompts_strict",
    f"""SELECT example_id, db_id, md5({prompt_sql('schema_text', prompts.PROTOCOL_STRICT)}) AS prompt,
      false AS prompt_truncated FROM examples""",
    "examples",
)
def prompt_rows_strict(t: Tables):
    """Digest of every prompt with the strict protocol."""
    strict = rows.prompt_rows(t.adapted("examples"), version=prompts.STRICT_VERSION)
    return strict.withColumn("prompt", F.md5("prompt"))


# For the budget, a document's text is the schema and its language the question.
_BUDGET = 160
_WORDS = r"len(regexp_extract_all({0}, '[^\s]+'))"


def _budget_examples(t: Tables):
    return t.adapted("examples").select(
        "example_id",
        "db_id",
        F.col("evidence").alias("question"),
        F.col("question").alias("schema_text"),
        F.lit("").alias("evidence"),
    )


@query(
    "prompt_budget",
    f""", x AS (SELECT example_id, db_id, evidence AS question, question AS schema_text, '' AS evidence FROM examples),
    h AS (SELECT *, {_BUDGET} - {_WORDS.format(prompt_sql("''", prompts.PROTOCOL_SQL))} AS budget FROM x),
    l AS (SELECT example_id, unnest(range(len(string_split(schema_text, chr(10))))) AS pos,
        unnest(string_split(schema_text, chr(10))) AS line FROM h),
    s AS (SELECT example_id, pos, sum({_WORDS.format('line')}) OVER (PARTITION BY example_id ORDER BY pos) AS used FROM l),
    k AS (SELECT example_id, count(*) FILTER (used <= budget) AS kept, count(*) AS n FROM s JOIN h USING (example_id) GROUP BY 1),
    y AS (SELECT h.*, kept, kept < n AS cut, CASE WHEN kept = n THEN schema_text WHEN kept = 0 THEN '{prompts.SCHEMA_PLACEHOLDER}'
        ELSE array_to_string(string_split(schema_text, chr(10))[1:kept], chr(10)) END AS fitted FROM h JOIN k USING (example_id))
    SELECT example_id, db_id, md5({prompt_sql('fitted', prompts.PROTOCOL_SQL)}) AS prompt, cut AS prompt_truncated,
      kept AS kept_lines FROM y""",
    "examples",
)
def prompt_budget(t: Tables):
    """Prompts cut to a word budget at whole schema lines."""
    cut = rows.prompt_rows_within(_budget_examples(t), _BUDGET)
    return cut.withColumns(
        {"prompt": F.md5("prompt"), "kept_lines": F.col("kept_lines").cast("bigint")}
    )


@query(
    "sft_rows_gold",
    f"""SELECT '' AS instruction, md5({prompt_sql('schema_text', prompts.PROTOCOL_SQL)}) AS input,
      '<sql>' || chr(10) || gold_sql || chr(10) || '</sql>' AS output, example_id, db_id FROM examples""",
    "examples",
)
def sft_rows_gold(t: Tables):
    """Instruction rows with gold targets."""
    return rows.sft_rows(t.adapted("examples")).withColumn("input", F.md5("input"))


_VERIFIED = """, ok AS (SELECT * FROM candidates WHERE parse_valid AND safe AND execution_success AND execution_equivalent
      AND candidate_sql <> ''),
    targets AS (SELECT example_id, arg_min(candidate_sql, (candidate_index, created_at)) AS target_sql FROM ok GROUP BY 1)"""


@query("verified_targets", f"{_VERIFIED} SELECT * FROM targets", "candidates")
def verified_targets(t: Tables):
    """The chosen verified candidate of each example."""
    return rows.verified_targets(t.adapted("candidates"))


@query(
    "paired_targets",
    f"""{_VERIFIED} SELECT example_id, db_id, gold_sql, target_sql AS distilled_sql
    FROM conversation_examples JOIN targets USING (example_id)""",
    "conversation_examples candidates",
)
def paired_targets(t: Tables):
    """Gold and distilled SQL over the same ids."""
    paired, _, _ = rows.paired_targets(
        t.adapted("conversation_examples"), t.adapted("candidates"), require_all=False
    )
    return paired


@query(
    "paired_coverage",
    f"""{_VERIFIED} SELECT count(*) AS requested_count, count(target_sql) AS paired_count,
      count(*) - count(target_sql) AS dropped_count, count(target_sql) / count(*) AS coverage
    FROM conversation_examples LEFT JOIN targets USING (example_id)""",
    "conversation_examples candidates",
)
def paired_coverage(t: Tables):
    """How many requested examples have a pair."""
    _, _, summary = rows.paired_targets(
        t.adapted("conversation_examples"), t.adapted("candidates"), require_all=False
    )
    return summary


@query(
    "sft_rows_distilled",
    f"""{_VERIFIED}, p AS (SELECT c.example_id, c.db_id, 'Conversation ' || c.ord AS question, 'CREATE TABLE orders (o_custkey INTEGER)'
        AS schema_text, '' AS evidence, target_sql FROM conversation_examples c JOIN targets USING (example_id))
    SELECT '' AS instruction, {prompt_sql('schema_text', prompts.PROTOCOL_SQL)} AS input,
      '<sql>' || chr(10) || target_sql || chr(10) || '</sql>' AS output, example_id, db_id FROM p""",
    "conversation_examples candidates",
)
def sft_rows_distilled(t: Tables):
    """Instruction rows with distilled targets, for the paired ids."""
    examples = t.adapted("conversation_examples").select(
        "example_id",
        "db_id",
        "gold_sql",
        F.concat(F.lit("Conversation "), "ord").alias("question"),
        F.lit("CREATE TABLE orders (o_custkey INTEGER)").alias("schema_text"),
        F.lit("").alias("evidence"),
    )
    targets = rows.verified_targets(t.adapted("candidates"))
    return rows.sft_rows(examples.join(targets.select("example_id"), "example_id", "left_semi"), targets)


@query(
    "gold_arm",
    f"""{_VERIFIED} SELECT example_id, db_id, gold_sql FROM conversation_examples
    WHERE example_id IN (SELECT example_id FROM targets)""",
    "conversation_examples candidates",
)
def gold_arm(t: Tables):
    """The examples the gold arm keeps."""
    examples = t.adapted("conversation_examples")
    targets = rows.verified_targets(t.adapted("candidates"))
    return rows.gold_arm(examples, targets).select("example_id", "db_id", "gold_sql")


@query(
    "paired_distribution",
    f"""{_VERIFIED} SELECT db_id, count(*) AS n FROM conversation_examples JOIN targets USING (example_id) GROUP BY db_id""",
    "conversation_examples candidates",
)
def paired_distribution(t: Tables):
    """Paired examples per database."""
    paired, _, _ = rows.paired_targets(
        t.adapted("conversation_examples"), t.adapted("candidates"), require_all=False
    )
    return sampling.distribution(paired, "db_id")


@query(
    "calibration_rows",
    """SELECT example_id, split, md5('Question: ' || question || chr(10) || 'Schema:' || chr(10) || schema_text) AS text
    FROM (SELECT * FROM examples WHERE split IN ('train', 'calibration') ORDER BY ord LIMIT 64)""",
    "examples",
)
def calibration_rows(t: Tables):
    """The first calibration texts of the allowed splits."""
    return rows.calibration_rows(t.adapted("examples"), "ord", 64).withColumn("text", F.md5("text"))


_LENGTHS = f""", w AS (SELECT {_WORDS.format('schema_text')} AS schema,
      CASE WHEN evidence <> '' THEN {_WORDS.format('evidence')} ELSE 0 END AS evidence,
      {_WORDS.format(prompt_sql('schema_text', prompts.PROTOCOL_SQL))} AS prompt FROM examples),
    u AS (SELECT part, CAST(tokens AS BIGINT) AS tokens FROM (UNPIVOT w ON schema, evidence, prompt INTO NAME part VALUE tokens))"""


@query(
    "length_profile",
    f"""{_LENGTHS}, r AS (SELECT part, tokens, row_number() OVER (PARTITION BY part ORDER BY tokens) - 1 AS rank,
        count(*) OVER (PARTITION BY part) AS n FROM u),
    f(name, p) AS (VALUES ('p50', 0.5::DOUBLE), ('p90', 0.9), ('p95', 0.95), ('p99', 0.99), ('max', 1.0))
    SELECT part, name, tokens AS value FROM r, f WHERE rank = CAST(round_even(p * (n - 1), 0) AS BIGINT)""",
    "examples",
)
def length_profile(t: Tables):
    """Length percentiles of schema, evidence and prompt."""
    return rows.length_profile(t.adapted("examples"))


@query(
    "over_budget",
    f"""{_LENGTHS}, b(budget) AS (VALUES (512::BIGINT), (768), (1024), (1536))
    SELECT budget, count(*) FILTER (tokens > budget) AS n_over, count(*) FILTER (tokens > budget) / count(*) AS rate
    FROM u, b WHERE part = 'prompt' GROUP BY budget""",
    "examples",
)
def over_budget(t: Tables):
    """Prompts longer than each budget."""
    return rows.over_budget(t.adapted("examples"))


@query(
    "sql_features",
    """SELECT example_id, 'docs_' || evidence AS tables, 1::BIGINT AS joins,
      'd.doc_id = ' || ord AS filters, 'd.source' AS grouping,
      'tables: docs_' || evidence || chr(10) || 'joins: JOIN docs_' || evidence || ' AS e ON d.doc_id = e.doc_id'
      || chr(10) || 'filters: d.doc_id = ' || ord || chr(10) || 'grouping: d.source' || chr(10)
      || 'ordering: d.source DESC' AS plan FROM examples""",
    "examples",
)
def sql_features(t: Tables):
    """What each query of the corpus uses, and the plan text made of it."""
    sql = F.format_string(
        "SELECT d.source FROM docs_%s d JOIN docs_%s AS e ON d.doc_id = e.doc_id WHERE d.doc_id = %d "
        "GROUP BY d.source ORDER BY d.source DESC LIMIT 3",
        "evidence",
        "evidence",
        "ord",
    )
    parts = prompts.sql_features(sql)
    return t.adapted("examples").select(
        "example_id",
        F.array_join(parts["tables"], ",").alias("tables"),
        F.size(parts["joins"]).cast("bigint").alias("joins"),
        parts["filters"].alias("filters"),
        parts["grouping"].alias("grouping"),
        prompts.plan_text(sql).alias("plan"),
    )


# A query whose clauses hold queries, lists, calls and literals of their own, clause by clause.
_NESTED_JOIN = (
    "LEFT JOIN (SELECT doc_id FROM docs_{e} WHERE doc_id IN ({o}, 2) AND (quality = 1 OR toxic = 0) GROUP BY doc_id) "
    "AS e ON d.doc_id = coalesce(e.doc_id, {o})"
)
_NESTED_FILTER = (
    "d.doc_id IN (SELECT doc_id FROM labels WHERE quality = {o} ORDER BY doc_id) AND length(d.text) > {o} "
    "AND d.lang <> '{e}) GROUP BY x'"
)
_NESTED_GROUP = "d.source, coalesce(d.lang, (SELECT '{e}, a'))"
_NESTED_ORDER = "max(d.doc_id) OVER (PARTITION BY d.source ORDER BY {o}) DESC, d.source"
_NESTED = (
    f"WITH q AS (SELECT {{o}} AS n WHERE {{o}} > 0) SELECT d.source FROM docs_{{e}} d {_NESTED_JOIN} WHERE {_NESTED_FILTER} "
    f"GROUP BY {_NESTED_GROUP} HAVING count(*) > (SELECT max(n) FROM q LIMIT 1) ORDER BY {_NESTED_ORDER} LIMIT 3"
)


def _filled_sql(text: str) -> str:
    """``text`` as a literal of the checking engine, with the example's own values in it."""
    quoted = text.replace("'", "''")
    return f"replace(replace('{quoted}', '{{e}}', evidence), '{{o}}', CAST(ord AS VARCHAR))"


@query(
    "nested_features",
    f"""SELECT example_id, {_filled_sql(_NESTED_JOIN)} AS joins, {_filled_sql(_NESTED_FILTER)} AS filters,
      {_filled_sql(_NESTED_GROUP)} AS grouping, {_filled_sql(_NESTED_ORDER)} AS ordering,
      'docs_' || evidence || ',labels,q' AS tables FROM examples""",
    "examples",
)
def nested_features(t: Tables):
    """The whole clauses of queries that hold further queries in each of them."""
    sql = F.replace(F.replace(F.lit(_NESTED), F.lit("{e}"), F.col("evidence")), F.lit("{o}"), F.col("ord").cast("string"))
    return t.adapted("examples").select("example_id", prompts.sql_features(sql).alias("parts")).select(
        "example_id",
        F.array_join("parts.joins", " | ").alias("joins"),
        "parts.filters",
        "parts.grouping",
        "parts.ordering",
        F.array_join("parts.tables", ",").alias("tables"),
    )

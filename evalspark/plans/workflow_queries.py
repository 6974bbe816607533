"""Steps of candidate collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.prompts import FEEDBACK_PARSE, FEEDBACK_UNSAFE, FEEDBACK_WRONG
from evalspark.operators import generators, rows, workflow
from evalspark.plans.registry import Tables, query
from evalspark.plans.scoring_queries import SCORED


@query(
    "completed_keys",
    "SELECT DISTINCT example_id, candidate_index FROM candidates WHERE teacher_prompt_version = 'v2'",
    "candidates",
)
def completed_keys(t: Tables):
    """Keys the current prompt version has done."""
    return workflow.completed_keys(t.adapted("candidates"), "v2")


_DONE = """, done AS (SELECT DISTINCT example_id, candidate_index FROM candidates WHERE teacher_prompt_version = 'v2')"""


@query(
    "remaining_plan",
    f"""{_DONE}, p AS (SELECT example_id, unnest(range(4))::INTEGER AS candidate_index FROM conversation_examples)
    SELECT * FROM p WHERE (example_id, candidate_index) NOT IN (SELECT (example_id, candidate_index) FROM done)""",
    "conversation_examples candidates",
)
def remaining_plan(t: Tables):
    """Keys still to generate."""
    done = workflow.completed_keys(t.adapted("candidates"), "v2")
    return workflow.remaining(t.adapted("conversation_examples"), done, 4)


@query(
    "progress",
    f"""{_DONE}, d AS (SELECT example_id, count(*) AS n FROM done GROUP BY 1)
    SELECT count(*) AS examples_planned, count(n) AS examples_completed, count(*) * 4 AS candidates_planned,
      CAST(sum(n) AS BIGINT) AS candidates_completed FROM conversation_examples LEFT JOIN d USING (example_id)""",
    "conversation_examples candidates",
)
def progress(t: Tables):
    """Examples and candidates planned and done."""
    done = workflow.completed_keys(t.adapted("candidates"), "v2")
    return workflow.progress(t.adapted("conversation_examples"), done, 4)


_REASON = """CASE WHEN NOT parse_valid THEN 'parse_failed' WHEN NOT safe THEN 'unsafe_or_multiple_statements'
      WHEN NOT execution_success THEN 'execution_failed' WHEN NOT execution_equivalent THEN 'wrong_result' ELSE 'verified' END"""
_NEXT = f""", j AS (SELECT *, {_REASON} AS reason FROM candidates),
    l AS (SELECT example_id, max(candidate_index) AS last_index, bool_or(execution_equivalent) AS done,
      arg_max(reason, candidate_index) AS reason FROM j GROUP BY 1),
    nx AS (SELECT example_id, coalesce(last_index + 1, 0)::INTEGER AS candidate_index, reason AS retry_reason,
        CASE reason WHEN 'parse_failed' THEN '{FEEDBACK_PARSE}' WHEN 'unsafe_or_multiple_statements' THEN '{FEEDBACK_UNSAFE}'
          WHEN 'execution_failed' THEN 'Previous query failed with SQLite error category: no such column.'
          WHEN 'wrong_result' THEN '{FEEDBACK_WRONG}' END AS feedback
      FROM conversation_examples LEFT JOIN l USING (example_id) WHERE NOT coalesce(done, false))"""


@query(
    "next_attempts",
    f"{_NEXT} SELECT * FROM nx WHERE candidate_index < 4",
    "conversation_examples candidates",
)
def next_attempts(t: Tables):
    """The next attempt of every unverified example, with feedback."""
    return workflow.next_attempts(t.adapted("conversation_examples"), t.adapted("candidates"), 4)


@query(
    "retry_prompts",
    f"""{_NEXT} SELECT example_id, db_id, candidate_index, 'Q' || ord || CASE WHEN feedback IS NULL THEN ''
      ELSE chr(10) || chr(10) || feedback END AS prompt,
      CAST(CAST(('0x' || substr(sha256('3407:' || example_id || ':' || candidate_index), 1, 16)) AS UBIGINT) AS VARCHAR)
        AS generation_seed FROM nx JOIN conversation_examples USING (example_id) WHERE candidate_index < 4""",
    "conversation_examples candidates",
)
def retry_prompts(t: Tables):
    """Prompts of the next round, with feedback and seed."""
    examples = t.adapted("conversation_examples").withColumn("prompt", F.concat(F.lit("Q"), "ord"))
    attempts = workflow.next_attempts(examples, t.adapted("candidates"), 4)
    return workflow.attempt_prompts(examples, attempts, 3407).withColumn(
        "generation_seed", F.col("generation_seed").cast("string")
    )


@query(
    "previous_attempts",
    """SELECT c.example_id, c.candidate_index, p.candidate_sql AS previous_sql, p.execution_success AS previous_success
    FROM candidates c LEFT JOIN candidates p ON c.example_id = p.example_id AND c.candidate_index = p.candidate_index + 1""",
    "candidates",
)
def previous_attempts(t: Tables):
    """Each attempt beside the one before it."""
    return rows.with_previous_attempt(t.adapted("candidates")).select(
        "example_id",
        "candidate_index",
        F.col("previous.candidate_sql").alias("previous_sql"),
        F.col("previous.execution_success").alias("previous_success"),
    )


@query(
    "target_stop",
    """, v AS (SELECT ord, sum((example_id IN (SELECT example_id FROM candidates WHERE execution_equivalent))::INT)
        OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, example_id FROM conversation_examples)
    SELECT example_id FROM v WHERE coalesce(seen, 0) < 12""",
    "conversation_examples candidates",
)
def target_stop(t: Tables):
    """Examples a run works through before it has enough verified ones."""
    return workflow.until_target(
        t.adapted("conversation_examples"), t.adapted("candidates"), "ord", 12
    ).select("example_id")


@query(
    "candidate_records",
    f"""{SCORED}, x AS (SELECT *, sql IS NOT NULL AND error_type = 'none' AS ok_sql FROM w)
    SELECT example_id, candidate_index, raw AS raw_candidate_output, sql AS candidate_sql,
      CASE WHEN v = 1 THEN 'tables: orders' END AS candidate_plan, format_ok AS parse_valid, ok_sql AS safe,
      ok_sql AND success AS execution_success, ok_sql AND strict AS execution_equivalent,
      CAST(CAST(('0x' || substr(sha256('3407:' || example_id || ':' || candidate_index), 1, 16)) AS UBIGINT) AS VARCHAR)
        AS generation_seed, sha256(lower(trim(sql))) AS normalized_sql_hash,
      CASE WHEN sql IS NULL THEN 'format_error' ELSE error_type END AS safety_error_type,
      CASE WHEN ok_sql AND NOT success THEN 'sqlite_error' ELSE 'none' END AS execution_error_type,
      CASE WHEN ok_sql AND NOT success THEN 'no such column' END AS execution_error_message_sanitized,
      CASE WHEN ok_sql THEN CASE WHEN strict THEN 'ordered_rows' ELSE 'not_equivalent' END END AS verification_kind,
      CASE WHEN NOT format_ok THEN 'parse_failed' WHEN NOT ok_sql THEN 'unsafe_or_multiple_statements'
        WHEN NOT success THEN 'execution_failed' WHEN NOT strict THEN 'wrong_result' ELSE 'verified' END AS retry_reason FROM x""",
    "completions",
)
def candidate_records(t: Tables):
    """Full candidate records from completions and verdicts."""
    completions = t.adapted("completions").withColumnRenamed("raw", "raw_candidate_output")
    success = F.col("turn") % 4 != 3
    strict = success & (F.col("conv_id") % 3 == 0)
    verdicts = completions.select(
        "example_id",
        "candidate_index",
        success.alias("success"),
        F.when(success, "none").otherwise("sqlite_error").alias("error_type"),
        F.when(~success, "no such column: zz").alias("error_message"),
        strict.alias("equivalent"),
        F.when(strict, "ordered_rows").otherwise("not_equivalent").alias("kind"),
    )
    return workflow.candidate_records(completions, verdicts, 3407).withColumn(
        "generation_seed", F.col("generation_seed").cast("string")
    )


def _echo(prompt: str, context: dict, count: int) -> list[str]:
    """Stands in for a model: the prompt's size and what else the generator was told."""
    told = "/".join(context[k] for k in ("example_id", "db_id", "split"))
    return [f"<sql>SELECT {len(prompt) + i} -- {told}</sql>" for i in range(count)]


@query(
    "generator_hook",
    """SELECT example_id, i::INTEGER AS candidate_index, '<sql>SELECT ' || (length(question) + i) || ' -- ' || example_id
      || '/' || db_id || '/' || split || '</sql>' AS raw_candidate_output
    FROM (SELECT *, unnest(range(2)) AS i FROM examples)""",
    "examples",
)
def generator_hook(t: Tables):
    """A user's generator called on whole prompts inside the tasks."""
    inputs = t.adapted("examples").select(
        "example_id", "db_id", "split", F.col("question").alias("prompt")
    )
    return workflow.generate(inputs, _echo, 2)


@query(
    "generator_function",
    """, p AS (SELECT example_id, CASE WHEN ord % 2 = 0 THEN ['labels', 'docs_' || evidence] ELSE ['docs_' || evidence, 'labels'] END AS tables
      FROM examples)
    SELECT example_id, i::INTEGER AS candidate_index, '<sql>' || chr(10) || CASE WHEN i < 2 THEN 'SELECT COUNT(*) FROM ' || tables[i + 1]
      ELSE 'SELECT doc_id FROM ' || tables[1] || ' ORDER BY doc_id' END || chr(10) || '</sql>' AS raw_candidate_output
    FROM (SELECT *, unnest(range(3)) AS i FROM p)""",
    "examples",
)
def generator_function(t: Tables):
    """A generator that reads the prompt's schema, called from SQL on a table of prompts."""
    asked = F.when(F.col("ord") % 2 == 0, "labels").otherwise(F.concat(F.lit("docs_"), "evidence"))
    prompts = t.adapted("examples").select(
        "example_id", "db_id", "split", F.concat("schema_text", F.lit("\nQuestion: rows of "), asked).alias("prompt")
    )
    generators.register_generator(t.spark, "schema_candidates", generators.schema_generator)
    return t.spark.sql("SELECT * FROM schema_candidates(TABLE({prompts}), 3)", prompts=prompts)

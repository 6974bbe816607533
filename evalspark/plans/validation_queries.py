"""Checks on examples, candidates, splits and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import leakage, validate
from evalspark.plans.registry import Tables, query

_BROKEN = """, b AS (SELECT ord, CASE WHEN ord % 11 = 3 THEN '-' || example_id ELSE example_id END AS example_id,
      CASE WHEN ord % 13 = 5 THEN db_id || '/x' ELSE db_id END AS db_id,
      CASE WHEN ord % 17 = 2 THEN '' ELSE question END AS question, schema_text,
      CASE WHEN ord % 19 = 4 THEN NULL ELSE gold_sql END AS gold_sql,
      CASE WHEN ord % 23 = 6 THEN 'holdout' ELSE split END AS split, source, source_version FROM examples)"""


def broken_examples(t: Tables):
    """The examples with a fault in some fields of some rows."""
    ord_ = F.col("ord")
    return (
        t.adapted("examples")
        .withColumns(
            {
                "example_id": F.when(
                    ord_ % 11 == 3, F.concat(F.lit("-"), "example_id")
                ).otherwise(F.col("example_id")),
                "db_id": F.when(ord_ % 13 == 5, F.concat("db_id", F.lit("/x"))).otherwise(
                    F.col("db_id")
                ),
                "question": F.when(ord_ % 17 == 2, "").otherwise(F.col("question")),
                "gold_sql": F.when(ord_ % 19 != 4, F.col("gold_sql")),
                "split": F.when(ord_ % 23 == 6, "holdout").otherwise(F.col("split")),
            }
        )
    )


@query(
    "example_validation",
    f"""{_BROKEN} SELECT ord, concat_ws(',', CASE WHEN question = '' THEN 'question' END,
      CASE WHEN gold_sql IS NULL THEN 'gold_sql' END, CASE WHEN split = 'holdout' THEN 'split' END,
      CASE WHEN NOT regexp_full_match(db_id, '[A-Za-z0-9][A-Za-z0-9_-]{{0,63}}') THEN 'db_id' END,
      CASE WHEN NOT regexp_full_match(example_id, '[A-Za-z0-9][A-Za-z0-9_.-]{{0,127}}') THEN 'example_id' END)
      AS errors FROM b""",
    "examples",
)
def example_validation(t: Tables):
    """The faulty fields of every example."""
    checked = validate.example_errors(broken_examples(t))
    return checked.select("ord", F.array_join("errors", ",").alias("errors"))


@query(
    "candidate_validation",
    """SELECT example_id, candidate_index - 1 AS candidate_index,
      concat_ws(',', CASE WHEN candidate_index < 1 THEN 'candidate_index' END,
        CASE WHEN n_chars % 9 = 0 THEN 'raw_candidate_output' END) AS errors FROM candidates""",
    "candidates",
)
def candidate_validation(t: Tables):
    """The faulty fields of every candidate."""
    shifted = t.adapted("candidates").withColumns(
        {
            "candidate_index": F.col("candidate_index") - 1,
            "raw_candidate_output": F.when(F.col("n_chars") % 9 == 0, "").otherwise(
                F.col("raw_candidate_output")
            ),
            "teacher_model": F.lit("teacher-1"),
        }
    )
    checked = validate.candidate_errors(shifted)
    return checked.select(
        "example_id", "candidate_index", F.array_join("errors", ",").alias("errors")
    )


@query(
    "duplicate_ids",
    """SELECT md5(question) AS example_id, count(*) AS n FROM lines GROUP BY 1 HAVING count(*) > 1""",
    "lines",
)
def duplicate_ids(t: Tables):
    """Ids that occur more than once."""
    return validate.duplicate_ids(t.adapted("lines").select(F.md5("question").alias("example_id")))


@query(
    "split_mismatch",
    f"""{_BROKEN} SELECT ord, b.split, e.split AS declared_split FROM b JOIN examples e USING (ord)
    WHERE b.split <> e.split""",
    "examples",
)
def split_mismatch(t: Tables):
    """Rows whose split differs from the one their file declares."""
    declared = F.element_at(
        F.array(*[F.lit(s) for s in ["train"] * 5 + ["calibration", "dev", "test", "validation_tuning", "formal_validation"]]),
        (F.col("ord") % 10 + 1).cast("int"),
    )
    found = validate.split_mismatches(broken_examples(t), declared)
    return found.select("ord", "split", "declared_split")


@query(
    "split_policy",
    f"""{_BROKEN} SELECT split, count(*) AS n, CASE WHEN split = 'holdout' THEN 'unknown'
      WHEN split IN ('validation_tuning', 'formal_validation') THEN 'forbidden'
      WHEN split = 'train' THEN 'included' ELSE 'excluded' END AS decision FROM b GROUP BY split""",
    "examples",
)
def split_policy(t: Tables):
    """What the training policy does with each split."""
    allowed = validate.assert_training_splits(["train"])
    return validate.split_report(broken_examples(t), allowed)


@query(
    "split_policy_rows",
    "SELECT example_id, split FROM examples WHERE split IN ('train', 'calibration')",
    "examples",
)
def split_policy_rows(t: Tables):
    """The rows a calibration policy lets through; it would raise on an unknown split."""
    allowed = validate.assert_calibration_splits(["train", "calibration"])
    kept, _ = validate.apply_split_policy(t.adapted("examples"), allowed)
    return kept.select("example_id", "split")


@query(
    "eval_split",
    "SELECT example_id, length(question) AS n_chars FROM examples WHERE split = 'formal_validation'",
    "examples",
)
def eval_split(t: Tables):
    """The examples of an explicitly named evaluation split."""
    chosen = validate.select_split(t.adapted("examples"), "formal_validation")
    return chosen.select("example_id", F.length("question").cast("bigint").alias("n_chars"))


@query(
    "training_source_guard",
    """, v AS (SELECT DISTINCT md5(question) AS id FROM lines WHERE split = 'validation_tuning'),
    t AS (SELECT md5(question) AS id, split FROM lines WHERE split <> 'validation_tuning')
    SELECT rule, count(*) AS n FROM (SELECT 'split' AS rule FROM t WHERE split <> 'train'
      UNION ALL SELECT 'validation_id' FROM (SELECT DISTINCT id FROM t) WHERE id IN (SELECT id FROM v))
    GROUP BY rule""",
    "lines",
)
def training_source_guard(t: Tables):
    """Rows a training source must not hold: other splits and validation ids."""
    lines = t.adapted("lines").withColumn("example_id", F.md5("question"))
    validation = lines.filter("split = 'validation_tuning'")
    source = lines.filter("split <> 'validation_tuning'")
    found = validate.training_source_violations(source, validation)
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "calibration_guard",
    "SELECT example_id, split FROM examples WHERE split NOT IN ('train', 'calibration')",
    "examples",
)
def calibration_guard(t: Tables):
    """Rows that would contaminate a calibration set."""
    return validate.calibration_violations(t.adapted("examples"), ["train", "calibration"])


@query(
    "registry_coverage",
    """SELECT DISTINCT lang || '-' || source AS db_id FROM documents WHERE lang || '-' || source NOT IN
      (SELECT lang || '-' || source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""",
)
def registry_coverage(t: Tables):
    """Databases that examples need and the registry lacks."""
    required = t.documents.select("doc_id", F.concat_ws("-", "lang", "source").alias("db_id"))
    registered = required.join(t.labels.filter("toxic = 1"), "doc_id", "left_semi")
    return validate.missing_databases(required, registered.select("db_id").distinct())


_ENTRIES = """, e AS (SELECT o_custkey, CASE WHEN o_custkey % 7 <> 0 THEN 'p' END AS path,
      o_custkey % 5 <> 0 AS readable, o_custkey % 11 <> 0 AS check_ok,
      CASE WHEN o_custkey % 13 <> 0 THEN 'h' END AS schema_hash FROM (SELECT DISTINCT o_custkey FROM orders))"""


@query(
    "registry_rollup",
    f"""WITH {_ENTRIES[2:]} SELECT count(*) AS required, count(*) FILTER (path IS NOT NULL) AS resolved,
      count(*) FILTER (path IS NULL) AS missing,
      count(*) FILTER (path IS NOT NULL AND NOT readable) AS unreadable,
      count(*) FILTER (path IS NOT NULL AND readable AND NOT check_ok) AS check_failed,
      count(*) FILTER (path IS NOT NULL AND readable AND schema_hash IS NULL) AS unhashed FROM e""",
)
def registry_rollup(t: Tables):
    """How many registered databases resolve, open, check out and are hashed."""
    key = F.col("o_custkey")
    path = F.when(key % 7 != 0, "p")
    entries = t.orders.select(key).distinct().select(
        path.alias("path"),
        F.when(path.isNotNull(), key % 5 != 0).alias("readable"),
        (key % 11 != 0).alias("check_ok"),
        F.when(key % 13 != 0, "h").alias("schema_hash"),
    )
    return validate.registry_rollup(entries)


@query(
    "data_audit",
    """, c AS (SELECT DISTINCT split, question FROM lines), known AS (SELECT DISTINCT lang FROM documents WHERE lang <> 'es')
    SELECT (SELECT count(*) FROM lines) AS examples, 6::BIGINT AS splits,
      (SELECT count(*) FROM lines WHERE db_id NOT IN (SELECT lang FROM known)) AS missing_db,
      (SELECT count(*) FROM c a JOIN c b ON a.question = b.question AND a.split < b.split) AS leaks,
      (SELECT count(*) FROM executions) AS gold_total, (SELECT count(*) FROM executions WHERE success) AS gold_success,
      (SELECT count(*) FROM candidates) AS candidates,
      (SELECT count(*) FROM candidates WHERE execution_equivalent AND execution_success AND safe AND parse_valid) AS verified,
      false AS ok""",
    "lines executions candidates",
)
def data_audit(t: Tables):
    """One report row over examples, registry, overlaps, gold runs and candidates."""
    lines = t.adapted("lines")
    registry = t.documents.filter("lang <> 'es'").select(F.col("lang").alias("db_id"))
    shared = leakage.id_overlap(lines.withColumn("example_id", F.sha2("question", 256)))
    return validate.audit(
        lines, registry, shared, t.adapted("executions"), t.adapted("candidates")
    )


@query(
    "model_inputs",
    """SELECT example_id, db_id, split, md5('Q: ' || question) AS prompt FROM examples""",
    "examples",
)
def model_inputs(t: Tables):
    """All a generator gets to see of an example."""
    rows = t.adapted("examples").withColumn("prompt", F.concat(F.lit("Q: "), "question"))
    return validate.model_inputs(rows).withColumn("prompt", F.md5("prompt"))



"""Overlap between splits, and gold data inside prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.identity import content_signature
from evalspark.operators import leakage
from evalspark.plans.identity_queries import NORM_QUESTION, NORM_SQL, SIGNATURE
from evalspark.plans.registry import Tables, query

_NQ = NORM_QUESTION.format("question")


def _by_content(t: Tables):
    """Document lines under their content id, so copies share an id."""
    lines = t.adapted("lines")
    signature = content_signature(
        *[F.col(c) for c in ("db_id", "question", "evidence", "gold_sql")]
    )
    return lines.withColumn("example_id", signature)


@query(
    "id_overlap",
    f""", c AS (SELECT DISTINCT split, {SIGNATURE} AS example_id FROM lines)
    SELECT a.split AS left_split, b.split AS right_split, a.example_id
    FROM c a JOIN c b ON a.example_id = b.example_id AND a.split < b.split""",
    "lines",
)
def id_overlap(t: Tables):
    """Ids found in more than one split, per pair of splits."""
    return leakage.id_overlap(_by_content(t)).select("left_split", "right_split", "example_id")


_OVERLAP = f""", q AS (SELECT example_id, split, question, {_NQ} AS norm FROM lines),
    e AS (SELECT DISTINCT split, question FROM q), n AS (SELECT DISTINCT split, norm FROM q)
    SELECT q.example_id, q.split AS left_split, e.split AS right_split, 'question_overlap_exact' AS rule
    FROM q JOIN e ON q.question = e.question AND q.split < e.split
    UNION ALL SELECT q.example_id, q.split, n.split, 'question_overlap_normalized'
    FROM q JOIN n ON q.norm = n.norm AND q.split < n.split"""


@query("question_overlap", _OVERLAP, "lines")
def question_overlap(t: Tables):
    """Questions that a later split holds too, exactly and normalized."""
    return leakage.question_overlap(t.adapted("lines"))


def _prompts(t: Tables):
    """Each document's first line as gold text, the other lines as the prompt."""
    lines = F.split("question", "\n")
    return t.adapted("examples").select(
        "example_id",
        F.get(lines, F.lit(0)).alias("gold_sql"),
        F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(2))), "\n").alias("prompt"),
    )


_PROMPT = """, p AS (SELECT example_id, string_split(question, chr(10))[1] AS gold_sql,
      array_to_string(string_split(question, chr(10))[2:], chr(10)) AS prompt FROM examples)"""
_PROMPT_LEAK = f"""SELECT example_id, 'prompt_leakage_gold_sql' AS rule FROM p
      WHERE contains({NORM_SQL.format('prompt')}, {NORM_SQL.format('gold_sql')})
    UNION ALL SELECT example_id, 'prompt_leakage_gold_sql_raw' FROM p WHERE contains(prompt, trim(gold_sql))"""


@query("prompt_leakage", f"{_PROMPT} {_PROMPT_LEAK}", "examples")
def prompt_leakage(t: Tables):
    """Prompts that hold their gold text, normalized and raw."""
    return leakage.prompt_leakage(_prompts(t))


def _answers(t: Tables):
    """Per assistant turn the user's turn before it and the words of the answer."""
    turns = t.conversations
    asked = turns.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")
    )
    both = turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"])
    key = F.concat(F.lit("turn-"), "conv_id", F.lit("-"), "turn").alias("example_id")
    words = both.select(key, F.explode(F.split("text", r"[^\p{L}]+")).alias("value"))
    return both.select(key, "prompt"), words


@query(
    "result_leakage",
    r"""WITH b AS (SELECT 'turn-' || a.conv_id || '-' || a.turn AS example_id, u.text AS prompt, a.text
      FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE a.role = 'assistant' AND u.role = 'user'),
    w AS (SELECT example_id, prompt, unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS value FROM b)
    SELECT example_id, value, count(*) AS occurrences FROM w
    WHERE length(value) >= 6 AND contains(prompt, value) GROUP BY 1, 2""",
)
def result_leakage(t: Tables):
    """Result strings that stand in the prompt."""
    prompts, words = _answers(t)
    return leakage.result_leakage(prompts, words)


_FROM_TEST = """SELECT DISTINCT c.example_id FROM conv_split c JOIN candidates k USING (example_id)
    WHERE c.split = 'test'"""
_CONV_SPLIT = """, conv_split AS (SELECT example_id, CASE WHEN ord % 3 = 0 THEN 'test' ELSE 'train' END AS split
      FROM conversation_examples)"""


def _conversation_splits(t: Tables):
    return t.adapted("conversation_examples").withColumn(
        "split", F.when(F.col("ord") % 3 == 0, "test").otherwise("train")
    )


@query("candidates_from_test", f"{_CONV_SPLIT} {_FROM_TEST}", "conversation_examples candidates")
def candidates_from_test(t: Tables):
    """Test examples that candidates were generated from."""
    return leakage.candidates_from_test(_conversation_splits(t), t.adapted("candidates"))


@query(
    "leakage_audit",
    f""", q AS (SELECT example_id, split, question, {_NQ} AS norm FROM examples),
    p AS (SELECT example_id, string_split(question, chr(10))[1] AS gold_sql,
      array_to_string(string_split(question, chr(10))[2:], chr(10)) AS prompt FROM examples),
    found AS (
      SELECT 'question_overlap_exact' AS rule FROM q JOIN (SELECT DISTINCT split, question FROM q) e
        ON q.question = e.question AND q.split < e.split
      UNION ALL SELECT 'question_overlap_normalized' FROM q JOIN (SELECT DISTINCT split, norm FROM q) e
        ON q.norm = e.norm AND q.split < e.split
      UNION ALL SELECT rule FROM ({_PROMPT_LEAK})
      UNION ALL SELECT 'distillation_from_test' FROM q WHERE split = 'test')
    SELECT rule, count(*) AS violations FROM found GROUP BY rule""",
    "examples",
)
def leakage_audit(t: Tables):
    """All rules at once, counted by rule; every example has a candidate here."""
    examples = t.adapted("examples")
    found = leakage.audit_examples(examples, prompts=_prompts(t), candidates=examples)
    return found.groupBy("rule").agg(F.count("*").alias("violations"))


_KEYS = [
    ("id", "example_id"),
    ("normalized_question", _NQ),
    ("question_evidence", "db_id || '|' || question || '|' || evidence"),
    ("question_sql", "db_id || '|' || question || '|' || gold_sql"),
]


@query(
    "heldout_overlap",
    "\nUNION ALL ".join(
        f"""SELECT '{name}' AS rule, count(DISTINCT (split, {key})) FILTER
          ({key} IN (SELECT {key} FROM heldout)) AS overlap FROM lines"""
        for name, key in _KEYS
    ),
    "lines heldout",
)
def heldout_overlap(t: Tables):
    """Distinct keys shared with the held-out corpus, on four kinds of key."""
    return leakage.heldout_overlap(t.adapted("lines"), t.adapted("heldout"))


@query(
    "content_overlap_pairs",
    """, k AS (SELECT DISTINCT split, db_id, trim(question) AS q FROM lines)
    SELECT a.split AS left_split, b.split AS right_split, count(*) AS overlap
    FROM k a JOIN k b ON a.db_id = b.db_id AND a.q = b.q AND a.split < b.split GROUP BY 1, 2""",
    "lines",
)
def content_overlap_pairs(t: Tables):
    """Shared (database, question) keys per pair of splits."""
    return leakage.content_overlap_pairs(t.adapted("lines"))


@query(
    "duplicate_counts",
    f"""SELECT count(*) - count(DISTINCT (db_id, trim(question))) AS duplicate_exact,
      count(*) - count(DISTINCT (db_id, {_NQ})) AS duplicate_normalized FROM lines""",
    "lines",
)
def duplicate_counts(t: Tables):
    """Rows beyond the first of their key."""
    return leakage.duplicate_counts(t.adapted("lines"))


@query(
    "duplicate_detail",
    """, k AS (SELECT *, row_number() OVER w AS rn, first_value(example_id) OVER w AS first_id,
        first_value(gold_sql) OVER w AS first_sql, first_value(evidence) OVER w AS first_evidence
      FROM lines WINDOW w AS (PARTITION BY db_id, trim(question) ORDER BY ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT db_id, first_id, example_id AS later_id, first_sql, gold_sql AS later_sql,
      first_sql = gold_sql AS same_sql, first_evidence = evidence AS same_evidence FROM k WHERE rn > 1""",
    "lines",
)
def duplicate_detail(t: Tables):
    """Each repeated row beside the first one of its key."""
    return leakage.duplicate_detail(t.adapted("lines"), "ord")


@query(
    "exposure",
    """WITH e AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0), v AS (SELECT DISTINCT doc_id FROM documents)
    SELECT (SELECT count(*) FROM e) AS exposed, (SELECT count(*) FROM v) AS evaluated,
      (SELECT count(*) FROM e WHERE doc_id IN (SELECT doc_id FROM v)) AS intersection,
      (SELECT count(*) FROM v WHERE doc_id NOT IN (SELECT doc_id FROM e)) AS unexposed,
      (SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM v)) = 0 AS is_subset""",
)
def exposure(t: Tables):
    """How many documents a model has seen already, labels being what it saw."""
    seen = t.labels.filter("toxic = 0").select(F.col("doc_id").alias("example_id"))
    return leakage.exposure(seen, t.documents.select(F.col("doc_id").alias("example_id")))


@query(
    "split_proof",
    f""", c AS (SELECT split, {SIGNATURE} AS example_id FROM lines), d AS (SELECT DISTINCT * FROM c)
    SELECT 'size:' || split AS metric, count(*) AS value FROM d GROUP BY split
    UNION ALL SELECT 'overlap:' || a.split || '/' || b.split, count(*)
      FROM d a JOIN d b ON a.example_id = b.example_id AND a.split < b.split GROUP BY a.split, b.split
    UNION ALL SELECT 'union_size', count(DISTINCT example_id) FROM c
    UNION ALL SELECT 'sum_of_sizes', count(*) FROM d
    UNION ALL SELECT 'rows', count(*) FROM c""",
    "lines",
)
def split_proof(t: Tables):
    """Split sizes, overlaps and totals."""
    return leakage.split_proof(_by_content(t))

"""Completions: the SQL in them and what kind of SQL it is.

The checks state, for each way the adapter builds a completion, what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.completions import (
    fallback_sql,
    parse_completion,
    sql_block_count,
    stop_reason,
)
from evalspark.functions.screening import message_bucket, sanitize_error, screen
from evalspark.operators.metrics import bucket_counts
from evalspark.operators.scoring import scorable
from evalspark.plans.registry import Tables, query

EXPECTED = """, v AS (SELECT *, (conv_id * 7 + turn) % 14 AS v, regexp_matches(lower(text), '\\b(select|with)\\b') AS wordy
      FROM completions),
    e AS (SELECT *, CASE v WHEN 0 THEN 'SELECT o_totalprice FROM orders WHERE o_custkey = ' || conv_id
        WHEN 1 THEN 'SELECT COUNT(*) FROM orders ORDER BY 1;'
        WHEN 2 THEN 'SELECT o_totalprice FROM orders, customer c WHERE o_custkey = ' || turn
        WHEN 3 THEN 'SELECT turn FROM conversations WHERE text = ''a;b''' WHEN 8 THEN 'DROP TABLE orders'
        WHEN 9 THEN 'SELECT 1; DELETE FROM orders' WHEN 10 THEN 'SELECT text FROM conversations -- x; y'
        WHEN 12 THEN 'SELEC 1 FROM'
        WHEN 13 THEN 'WITH t AS (SELECT REPLACE(c_name, ''a'', ''b'') AS n FROM customer) SELECT n FROM t'
      END AS sql,
      CASE WHEN v = 5 AND NOT wordy THEN 'SELECT 1'
        WHEN v = 11 AND NOT wordy THEN 'SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey' END AS fallback,
      v IN (0, 1, 2, 8, 9, 10, 12, 13) AS format_ok,
      CASE WHEN v = 3 THEN 'fence' WHEN v IN (7, 11) THEN 'none' ELSE 'tags' END AS protocol,
      CASE v WHEN 3 THEN 'missing <sql> tags, SQL taken from a fence' WHEN 4 THEN 'duplicate <sql> tags'
        WHEN 5 THEN 'unbalanced <sql> tags' WHEN 6 THEN '<sql> block is empty'
        WHEN 7 THEN 'no <sql> block and no SQL fence' WHEN 11 THEN 'no <sql> block and no SQL fence' END AS parse_error,
      CASE WHEN v = 10 THEN 2 WHEN v IN (1, 2, 3) THEN 1 ELSE 0 END AS warnings FROM v),
    s AS (SELECT *, coalesce(sql, fallback) AS run_sql, CASE WHEN coalesce(sql, fallback) IS NULL THEN NULL
        WHEN v IN (8, 9) THEN 'unsafe_sql' WHEN v = 12 THEN 'syntax_error' ELSE 'none' END AS error_type FROM e)"""


@query(
    "parse_completion",
    f"""{EXPECTED} SELECT example_id, turn, sql, CASE WHEN v = 1 THEN 'tables: orders' END AS plan, format_ok,
      parse_error, protocol, CAST(warnings AS BIGINT) AS warnings FROM s""",
    "completions",
)
def parse(t: Tables):
    """The SQL and plan block of every completion, with what is wrong with it."""
    parsed = t.adapted("completions").withColumn("p", parse_completion(F.col("raw")))
    return parsed.select(
        "example_id",
        "turn",
        *[f"p.{c}" for c in ("sql", "plan", "format_ok", "parse_error", "protocol")],
        F.size("p.warnings").cast("bigint").alias("warnings"),
    )


@query(
    "parse_completion_with_plan",
    f"""{EXPECTED} SELECT example_id, turn, sql, v = 1 AS format_ok,
      coalesce(parse_error, CASE WHEN v <> 1 THEN '<plan> is required but missing' END) AS parse_error FROM s""",
    "completions",
)
def parse_with_plan(t: Tables):
    """As before where a plan is required: the SQL stays, the format is bad."""
    parsed = t.adapted("completions").withColumn("p", parse_completion(F.col("raw"), True))
    return parsed.select("example_id", "turn", "p.sql", "p.format_ok", "p.parse_error")


@query(
    "fallback_sql",
    f"{EXPECTED} SELECT example_id, turn, fallback AS sql FROM s WHERE sql IS NULL",
    "completions",
)
def fallback(t: Tables):
    """SQL taken from completions that hold no usable block."""
    found = t.adapted("completions").withColumn("p", parse_completion(F.col("raw")))
    return found.filter("p.sql is null").select(
        "example_id", "turn", fallback_sql(F.col("raw")).alias("sql")
    )


@query(
    "stop_reason",
    """SELECT example_id, turn, CASE WHEN ends_with(rtrim(raw, chr(10) || ' '), '</sql>') THEN 'sql_close'
        ELSE 'max_tokens_or_eos' END AS stop_reason,
      CAST((length(lower(raw)) - length(replace(lower(raw), '<sql>', ''))) // 5 AS BIGINT) AS blocks FROM completions""",
    "completions",
)
def stops(t: Tables):
    """Why generation stopped and how many blocks it opened."""
    return t.adapted("completions").select(
        "example_id",
        "turn",
        stop_reason(F.col("raw")).alias("stop_reason"),
        sql_block_count(F.col("raw")).cast("bigint").alias("blocks"),
    )


@query(
    "screen_sql",
    f"""{EXPECTED} SELECT example_id, turn, run_sql, error_type, error_type = 'none' AS safe,
      CASE v WHEN 12 THEN -1 WHEN 9 THEN 2 ELSE 1 END::BIGINT AS statements,
      CASE WHEN v = 8 THEN 'drop' ELSE '' END AS forbidden FROM s WHERE run_sql IS NOT NULL""",
    "completions",
)
def screened(t: Tables):
    """Safety class of the SQL to run."""
    found = scorable(t.adapted("completions"), "raw").filter("run_sql is not null")
    return found.select(
        "example_id",
        "turn",
        "run_sql",
        "safety.error_type",
        "safety.safe",
        F.col("safety.statement_count").cast("bigint").alias("statements"),
        F.array_join("safety.forbidden", ",").alias("forbidden"),
    )


# Statements of each class around a document's own words, which stand in literals,
# comments and names and must not change the class.
_CORPUS = {
    "none": [
        "SELECT a FROM t WHERE b = '{w}; DROP TABLE t'",
        "WITH x AS (SELECT 1) SELECT * FROM x /* {w} ; DELETE */;",
        'SELECT "drop {w}" FROM t -- ; {w}',
        "SELECT REPLACE(a, ''{w}'', '''') FROM t UNION SELECT ''{w}''".replace("''", "'"),
    ],
    "unsafe_sql": [
        "REPLACE INTO t VALUES ('{w}')",
        "SELECT 1; PRAGMA writable_schema = ON -- {w}",
        "WITH x AS (SELECT '{w}') DELETE FROM t",
        "SELECT load_extension('{w}')",
        "INSERT OR REPLACE INTO t VALUES ('{w}')",
    ],
    "syntax_error": ["SELEC '{w}' FROM t", "SELECT (a FROM t WHERE b = '{w}'", "SELECT a, '{w}' FROM"],
    "format_error": ["   "],
}
# Queries inside queries: the class depends on words at every depth.
_NESTED = {
    "none": [
        "SELECT a FROM (SELECT b FROM t WHERE c IN (SELECT '{w})' FROM u) AND d) q WHERE (a, 1) IN (SELECT 1, 2)",
        "WITH q AS (SELECT CASE WHEN a THEN (SELECT '{w}') ELSE 0 END AS x FROM t) SELECT trim(both '{w}' FROM x) FROM q",
        "SELECT sum(a) FILTER (WHERE b = '{w}') OVER (PARTITION BY c ORDER BY d) FROM t UNION SELECT 2 ORDER BY 1",
    ],
    "syntax_error": [
        "SELECT a FROM (SELECT b FROM t WHERE c = '{w}' AND) q",
        "SELECT a FROM t WHERE x IN (SELECT b FROM u GROUP BY b WHERE '{w}' = b)",
        "WITH q AS (SELECT (CASE WHEN a THEN '{w}') FROM t) SELECT * FROM q",
        "SELECT f(g(a FROM t), '{w}') FROM u",
    ],
    "unsafe_sql": ["SELECT a FROM (SELECT load_extension('{w}') FROM t) q", "SELECT (SELECT 1); DROP TABLE t -- {w}"],
}


def _cases(texts: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(kind, text) for kind, of_kind in texts.items() for text in of_kind]


def _audit_sql(cases: list[tuple[str, str]]) -> str:
    kinds = " ".join(f"WHEN {i} THEN '{kind}'" for i, (kind, _) in enumerate(cases))
    return f"SELECT kind AS error_type, count(*) AS n FROM (SELECT CASE ord % {len(cases)} {kinds} END AS kind FROM lines) GROUP BY kind"


def _audit(t: Tables, cases: list[tuple[str, str]]):
    word = F.regexp_replace(F.regexp_extract("question", r"^\S*", 0), r"[^\p{L}]", "")
    sql = F.coalesce(
        *[
            F.when(F.col("ord") % len(cases) == i, F.replace(F.lit(text), F.lit("{w}"), word))
            for i, (_, text) in enumerate(cases)
        ]
    )
    corpus = t.adapted("lines").select(sql.alias("sql")).select(screen(F.col("sql")).alias("safety"))
    return bucket_counts(corpus.select("safety.error_type"), "error_type")


CASES, NESTED_CASES = _cases(_CORPUS), _cases(_NESTED)


@query("structural_audit", _audit_sql(CASES), "lines")
def structural_audit(t: Tables):
    """How much of a query corpus is a plain read, and what the rest is."""
    return _audit(t, CASES)


@query("nested_audit", _audit_sql(NESTED_CASES), "lines")
def nested_audit(t: Tables):
    """The same of a corpus whose queries hold further queries."""
    return _audit(t, NESTED_CASES)


@query(
    "error_sanitizer",
    """SELECT example_id, CASE k % 9 WHEN 0 THEN 'no such table' WHEN 1 THEN 'no such column' WHEN 2 THEN 'misuse'
        WHEN 5 THEN 'ambiguous column' WHEN 7 THEN 'syntax error' ELSE error_message END AS category,
      CASE k % 9 WHEN 0 THEN 'wrong_table' WHEN 1 THEN 'wrong_column' WHEN 2 THEN 'aggregation_error'
        WHEN 3 THEN 'group_by_error' WHEN 4 THEN 'order_error' WHEN 5 THEN 'join_error' WHEN 6 THEN 'join_error'
        WHEN 7 THEN 'filter_error' ELSE 'schema_error' END AS bucket FROM executions""",
    "executions",
)
def error_sanitizer(t: Tables):
    """Error messages reduced to a category and to a bucket."""
    message = F.col("error_message")
    return t.adapted("executions").select(
        "example_id", sanitize_error(message).alias("category"), message_bucket(message).alias("bucket")
    )

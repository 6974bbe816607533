"""The given tables in the shape of the data model.

An adapter is a projection written once as SQL that both Spark and the checking engine
run; where the dialects differ there is one text for each. The operators under test are
never part of an adapter.
"""

from __future__ import annotations

import math
import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from evalspark.plans.registry import Tables

_SPLIT_OF = """CASE {0} % 10 WHEN 5 THEN 'calibration' WHEN 6 THEN 'dev' WHEN 7 THEN 'test'
    WHEN 8 THEN 'validation_tuning' WHEN 9 THEN 'formal_validation' ELSE 'train' END"""
_SPLIT = _SPLIT_OF.format("doc_id")

SQL = {
    # One example per document.
    "examples": f"""
        SELECT doc_id AS ord, 'doc-' || doc_id AS example_id, source AS db_id, text AS question,
          'CREATE TABLE docs_' || lang || ' (doc_id INTEGER, text TEXT);' || chr(10)
            || 'CREATE TABLE labels (doc_id INTEGER,' || chr(10) || '  quality INTEGER, toxic INTEGER);'
            AS schema_text,
          'SELECT text FROM docs_' || lang || ' WHERE doc_id = ' || doc_id AS gold_sql,
          {_SPLIT} AS split, 'documents' AS source, 'v1' AS source_version, lang AS evidence
        FROM documents""",
    # One example per line of a document.
    "lines": """
        SELECT doc_id * 100000 + pos AS ord, 'line-' || doc_id || '-' || pos AS example_id,
          lang AS db_id, line AS question, lang AS evidence,
          'SELECT ' || length(line) AS gold_sql, SPLIT_OF AS split
        FROM document_lines""".replace("SPLIT_OF", _SPLIT),
    "heldout": """
        SELECT 'line-' || item_id || '-' || pos AS example_id, 'en' AS db_id, line AS question,
          'en' AS evidence, 'SELECT ' || length(line) AS gold_sql
        FROM benchmark_lines""",
    # One completion per assistant turn: the turn's whole text around a block of SQL.
    "completions": """
        SELECT 'conv-' || conv_id AS example_id, 'conv-' || conv_id AS group_id,
          'db-' || conv_id % 7 AS db_id, CAST(floor((turn - 1) / 2) AS INT) AS candidate_index,
          conv_id, turn, 'SELECT o_totalprice FROM orders WHERE o_custkey = ' || conv_id AS gold_sql,
          CASE (conv_id * 7 + turn) % 14
            WHEN 0 THEN '<sql>' || chr(10) || 'SELECT o_totalprice FROM orders WHERE o_custkey = '
              || conv_id || chr(10) || '</sql>'
            WHEN 1 THEN '<plan>' || chr(10) || 'tables: orders' || chr(10) || '</plan>' || chr(10)
              || '<sql>SELECT COUNT(*) FROM orders ORDER BY 1;</sql>'
            WHEN 2 THEN text || chr(10) || '<sql>SELECT o_totalprice FROM orders, customer c WHERE o_custkey = '
              || turn || '</sql>'
            WHEN 3 THEN '```sql' || chr(10) || 'SELECT turn FROM conversations WHERE text = ''a;b''' || chr(10) || '```'
            WHEN 4 THEN '<sql>SELECT 1</sql>' || text || '<sql>SELECT 2</sql>'
            WHEN 5 THEN text || '<sql>SELECT 1'
            WHEN 6 THEN '<sql>' || chr(10) || '  ' || chr(10) || '</sql>' || text
            WHEN 7 THEN text
            WHEN 8 THEN '<SQL>DROP TABLE orders</SQL>'
            WHEN 9 THEN '<sql>SELECT 1; DELETE FROM orders</sql>'
            WHEN 10 THEN '<sql>' || chr(10) || '```sql' || chr(10) || 'SELECT text FROM conversations -- x; y'
              || chr(10) || '```' || chr(10) || '</sql>' || chr(10) || text
            WHEN 11 THEN text || ' Here it is: SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey'
            WHEN 12 THEN '<sql>SELEC 1 FROM</sql>'
            ELSE '<sql>WITH t AS (SELECT REPLACE(c_name, ''a'', ''b'') AS n FROM customer) SELECT n FROM t</sql>'
          END AS raw, text
        FROM conversations WHERE role = 'assistant'""",
    # The same turns as judged candidates; what became of them follows from the lengths.
    "candidates": """
        SELECT *, CASE WHEN execution_success THEN 'none' WHEN safe THEN 'sqlite_error' END
            AS execution_error_type,
          CASE WHEN safe AND NOT execution_success THEN 'no such column' END
            AS execution_error_message_sanitized,
          execution_success AND n_chars % 3 <> 1 AS execution_equivalent
        FROM (SELECT *, safe AND n_chars % 4 <> 0 AS execution_success
          FROM (SELECT *, parse_valid AND n_chars % 5 <> 0 AS safe,
              CASE WHEN parse_valid
                THEN 'SELECT o_totalprice FROM orders WHERE o_custkey < ' || n_chars % 11 END AS candidate_sql
            FROM (SELECT 'conv-' || conv_id AS example_id, 'db-' || conv_id % 7 AS db_id,
                CAST(floor((turn - 1) / 2) AS INT) AS candidate_index,
                CAST(floor((turn - 1) / 2) AS INT) AS attempt_index,
                CASE WHEN conv_id % 4 = 0 THEN 'v1' ELSE 'v2' END AS teacher_prompt_version,
                '2024-01-01T00:00:0' || turn AS created_at, text AS raw_candidate_output,
                length(text) AS n_chars, length(text) % 6 <> 5 AS parse_valid
              FROM conversations WHERE role = 'assistant') a) b) c""",
    # One example per conversation.
    "conversation_examples": """
        SELECT DISTINCT conv_id AS ord, 'conv-' || conv_id AS example_id, 'db-' || conv_id % 7 AS db_id,
          'SELECT o_totalprice FROM orders WHERE o_custkey < ' || conv_id % 11 AS gold_sql
        FROM conversations""",
    # One logged execution per event.
    "executions": """
        SELECT event_id AS ord, 'ev-' || event_id AS example_id, 'db-' || user_id AS db_id,
          value * 301.7137 AS duration_ms, event_type <> 'error' AS success,
          event_type = 'error' AND k < 20 AS timed_out,
          CASE WHEN event_type <> 'error' THEN 'none' WHEN k < 20 THEN 'timeout'
            WHEN k < 50 THEN 'sqlite_error' WHEN k < 70 THEN 'unsafe_sql'
            WHEN k < 80 THEN 'internal_error' ELSE 'worker_lost' END AS error_type,
          CASE k % 9 WHEN 0 THEN 'no such table: T' || k WHEN 1 THEN 'No such column: a.b'
            WHEN 2 THEN 'misuse of aggregate: SUM()' WHEN 3 THEN 'error in GROUP BY clause'
            WHEN 4 THEN '1st ORDER BY term does not match' WHEN 5 THEN 'ambiguous column name: x'
            WHEN 6 THEN 'cannot JOIN using column id' WHEN 7 THEN 'near "WHERE": syntax error'
            ELSE 'database disk image is malformed' END AS error_message,
          ts, k
        FROM event_fields""",
    # One scored completion per event.
    "samples": """
        SELECT 'g-' || user_id || '-' || event_type AS generation_group_id,
          CASE WHEN event_type IN ('error', 'signup') THEN -0.4
            WHEN k = 13 THEN NULL ELSE least(value, 150.0) / 100 - 0.5 END AS reward,
          event_type <> 'error' AS parse_ok,
          CASE WHEN event_type = 'error' THEN NULL ELSE k <> 7 END AS safe,
          event_type IN ('click', 'purchase') AS execution_success,
          event_type = 'purchase' AND value > 20 AS strict_equivalent
        FROM event_fields""",
    # One evaluation record per event.
    "records": """
        SELECT 'ev-' || event_id AS example_id,
          CASE user_id % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'formal_validation' END AS split,
          event_type AS mode, value AS latency_ms, k <> 3 AS format_ok, k <> 3 AS format_valid,
          k > 5 AS sql_parse_ok, k > 5 AS sql_parse_valid, k > 9 AS safe,
          k > 9 AND event_type <> 'error' AS execution_success,
          k > 9 AND event_type = 'purchase' AS execution_equivalent,
          k > 9 AND event_type = 'purchase' AS strict_equivalent,
          k > 9 AND event_type = 'view' AND k < 15 AS verification_partial,
          k % 17 = 0 AS exact_match,
          CASE WHEN k <= 3 THEN 'format_error' WHEN k <= 5 THEN 'syntax_error'
            WHEN k <= 9 THEN 'unsafe_sql' WHEN event_type = 'error' THEN 'timeout'
            WHEN event_type = 'purchase' THEN 'none' ELSE 'wrong_result' END AS error_bucket,
          CASE WHEN k % 2 = 0 THEN 'sql_close' WHEN k % 3 = 0 THEN 'max_new_tokens' ELSE 'eos' END
            AS stop_reason,
          CASE WHEN k % 10 = 0 THEN '<sql>a</sql><SQL>b</SQL>' ELSE '<sql>a</sql>' END AS raw_completion,
          CASE WHEN k % 8 <> 0 THEN k END AS completion_token_count
        FROM event_fields""",
    # Query results: an order's rows, one per line number.
    "gold_rows": """
        SELECT o, row_idx, price, CASE f WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS flag, n
        FROM (SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS row_idx, min(l_extendedprice) AS price,
            max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS f, count(*) AS n
          FROM lineitem GROUP BY l_orderkey, l_linenumber) x""",
    # Candidates for each order: 0 same, 1 within tolerance, 2 a wrong price, 3 rows turned
    # round, 4 a row lost, 5 a row doubled.
    "candidate_rows": """
        SELECT o, CASE part WHEN 6 THEN 5 ELSE part END AS k,
          CASE part WHEN 3 THEN 8 - row_idx WHEN 6 THEN 100 + row_idx ELSE row_idx END AS row_idx,
          CASE WHEN part = 1 THEN price + 1e-7 WHEN part = 2 AND row_idx = o % 7 + 1 THEN price + 0.5
            ELSE price END AS price, flag, n
        FROM seven_gold_rows
        WHERE CASE part WHEN 4 THEN row_idx <> o % 7 + 1 WHEN 6 THEN row_idx = o % 7 + 1 ELSE true END""",
    "arms": """
        SELECT 'doc-' || doc_id AS example_id, quality = 1 AS a, toxic = 0 AS b FROM labels""",
}

# What Spark reads instead. An order's lines are brought together at once, under the id of the example
# they belong to, so that what is counted or joined per example need not be moved again. All of that
# is one task's, which is why tasks get no more than so many lines.
LINES_PER_TASK = 200_000
_LINES_TOGETHER = """FROM (SELECT /*+ REPARTITION(LINE_TASKS, example_id) */ * FROM (SELECT 'o-' || l_orderkey AS example_id,
            l_linenumber, l_extendedprice, l_returnflag FROM lineitem) i) l GROUP BY example_id,"""
SPARK_SQL = {
    "gold_rows": SQL["gold_rows"].replace("FROM lineitem GROUP BY l_orderkey,", _LINES_TOGETHER)
    .replace("SELECT o,", "SELECT example_id, CAST(substring(example_id, 3) AS BIGINT) AS o,")
    .replace("SELECT l_orderkey AS o,", "SELECT example_id,"),
    "candidate_rows": SQL["candidate_rows"].replace("SELECT o,", "SELECT example_id, o,"),
}

# Texts that the two dialects spell differently: Spark first.
TWO_DIALECTS = {
    "seven_gold_rows": (
        "SELECT g.*, part FROM gold_rows g LATERAL VIEW explode(sequence(0, 6)) p AS part",
        "SELECT *, CAST(unnest(range(7)) AS INTEGER) AS part FROM gold_rows",
    ),
    "document_lines": (
        """SELECT doc_id, lang, source, CAST(pos AS BIGINT) AS pos, line FROM documents
           LATERAL VIEW posexplode(split(text, chr(10))) l AS pos, line""",
        """SELECT doc_id, lang, source, unnest(range(len(string_split(text, chr(10))))) AS pos,
             unnest(string_split(text, chr(10))) AS line FROM documents""",
    ),
    "benchmark_lines": (
        """SELECT item_id, CAST(pos AS BIGINT) AS pos, line FROM benchmark
           LATERAL VIEW posexplode(split(text, chr(10))) l AS pos, line""",
        """SELECT item_id, unnest(range(len(string_split(text, chr(10))))) AS pos,
             unnest(string_split(text, chr(10))) AS line FROM benchmark""",
    ),
    "event_fields": (
        """SELECT event_id, ts, user_id, event_type, value,
             CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events""",
        """SELECT event_id, ts, user_id, event_type, value,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    ),
    "catalog": (
        """SELECT DISTINCT source AS db_id, inline(array(
             struct('table' AS type, 'docs_' || lang AS name,
               'CREATE TABLE docs_' || lang || ' (doc_id INTEGER, text TEXT)' AS ddl),
             struct('view' AS type, 'v_' || lang AS name,
               ' CREATE VIEW v_' || lang || ' AS SELECT doc_id FROM docs_' || lang AS ddl),
             struct('index' AS type, 'i_' || lang AS name,
               'CREATE INDEX i_' || lang || ' ON docs_' || lang || '(doc_id)' AS ddl)))
           FROM documents""",
        """SELECT DISTINCT source AS db_id, 'table' AS type, 'docs_' || lang AS name,
             'CREATE TABLE docs_' || lang || ' (doc_id INTEGER, text TEXT)' AS ddl FROM documents
           UNION ALL SELECT DISTINCT source, 'view', 'v_' || lang,
             ' CREATE VIEW v_' || lang || ' AS SELECT doc_id FROM docs_' || lang FROM documents
           UNION ALL SELECT DISTINCT source, 'index', 'i_' || lang,
             'CREATE INDEX i_' || lang || ' ON docs_' || lang || '(doc_id)' FROM documents""",
    ),
}

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _text(name: str, dialect: int) -> str:
    if dialect == 0 and name in SPARK_SQL:
        return SPARK_SQL[name]
    return SQL[name] if name in SQL else TWO_DIALECTS[name][dialect]


def _sources(text: str) -> list[str]:
    found = re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", text)
    return list(dict.fromkeys(found))


def _line_tasks(tables: Tables) -> int:
    """As many tasks as the session shuffles to, or more for a long table."""
    usual = int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, math.ceil(tables.lineitem.count() / LINES_PER_TASK))


def frame(tables: Tables, name: str) -> DataFrame:
    if name in BASE:
        return getattr(tables, name)
    text = _text(name, 0)
    if "LINE_TASKS" in text:
        text = text.replace("LINE_TASKS", str(_line_tasks(tables)))
    known = [s for s in _sources(text) if s in BASE or s in SQL or s in TWO_DIALECTS]
    for source in known:
        text = re.sub(rf"\b(FROM|JOIN) {source}\b(?!')", rf"\1 {{{source}}}", text)
    # Names inside string literals were caught too; put those back.
    text = re.sub(r"'[^']*'", lambda m: re.sub(r"\{(\w+)\}", r"\1", m.group(0)), text)
    return tables.spark.sql(text, **{s: frame(tables, s) for s in known if f"{{{s}}}" in text})


def _needed(name: str, order: list[str]) -> None:
    for source in _sources(_text(name, 1)):
        if source in SQL or source in TWO_DIALECTS:
            _needed(source, order)
    if name not in order:
        order.append(name)


def with_ctes(names: list[str], sql: str) -> str:
    order: list[str] = []
    for name in names:
        _needed(name, order)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({_text(n, 1)})" for n in order)
    return f"WITH {ctes}\n{sql}" if not sql.lstrip().startswith(",") else f"WITH {ctes}{sql}"

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import prompts, screening

TABLES = ["region", "nation", "orders"]
# Statements by rule, over tables that the data has.
SAFE = [
    *(f"SELECT count(*) FROM {t}" for t in TABLES),
    *(f"WITH q AS (SELECT * FROM {t}) SELECT max(1) FROM q" for t in TABLES),
    *(f"(SELECT 1 FROM {t}) UNION (SELECT 2 FROM {t});" for t in TABLES),
    "SELECT replace(n_name, 'drop table', '') FROM nation -- ; delete from nation",
    "SELECT transform(array(1), x -> x + 1) FROM region JOIN nation USING (r)",
    "SELECT map('a', 1), reflective FROM orders",
]
UNSAFE = [
    *(f"{verb} {t}" for verb in ("DROP TABLE", "TRUNCATE TABLE", "DESCRIBE", "DELETE FROM") for t in TABLES),
    *(f"SELECT 1 FROM {t}; SELECT 2" for t in TABLES),
    *(f"SELECT {call}('java.lang.System', 'exit') FROM region" for call in ("java_method", "reflect", "try_reflect")),
    "SELECT load_extension('x')",
    "SELECT TRANSFORM(r_name) USING 'cat' AS (x) FROM region",
    *(f"SELECT * FROM {kind}.`/etc/hostname`" for kind in ("text", "csv", "json", "parquet")),
    "WITH q AS (SELECT 1) DELETE FROM orders",
    "(DELETE FROM orders)",
]
BROKEN = ["SELEC 1 FROM", "SELECT 1 FROM", "SELECT (1", "SELECT 'open", "with you. SELECT 1", "SELECT 1</sql>"]


def _classes(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, sql string").orderBy("i")
    return [r[0] for r in frame.select(screening.screen(F.col("sql"))).collect()]


def test_safe(spark):
    for text, kind in zip(SAFE, _classes(spark, SAFE)):
        assert (kind.safe, kind.error_type, kind.statement_count) == (True, "none", 1), text


def test_unsafe(spark):
    for text, kind in zip(UNSAFE, _classes(spark, UNSAFE)):
        assert (kind.safe, kind.error_type) == (False, "unsafe_sql"), text
    two = _classes(spark, ["SELECT 1; DROP TABLE users"])[0]
    assert two.statement_count == 2


def test_broken_and_empty(spark):
    for text, kind in zip(BROKEN, _classes(spark, BROKEN)):
        assert (kind.safe, kind.error_type) == (False, "syntax_error"), text
    assert _classes(spark, ["   "])[0].error_type == "format_error"
    assert _classes(spark, [None])[0] is None


def test_tables_and_order(spark):
    texts = {
        "SELECT * FROM users JOIN orders ON users.id = orders.uid": ["orders", "users"],
        "SELECT 1": [],
        "SELECT 'FROM fake' FROM a AS x, b y WHERE 1": ["a", "b"],
        'SELECT * FROM main."My Table" -- FROM c': ["My Table"],
        "SELECT * FROM (SELECT 1 FROM t) JOIN u USING (x)": ["t", "u"],
    }
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, sql string").orderBy("i")
    rows = frame.select(screening.source_tables(F.col("sql"))).collect()
    assert [r[0] for r in rows] == list(texts.values())
    ordered = ["SELECT * FROM t ORDER BY x", "SELECT * FROM t", "SELECT 'order by'", "SELECT * FROM (SELECT 1 ORDER BY 1)"]
    frame = spark.createDataFrame(list(enumerate(ordered)), "i int, sql string").orderBy("i")
    sql = F.col("sql")
    rows = frame.select(screening.has_order_by(sql), screening.outer_order_by(sql)).collect()
    assert [tuple(r) for r in rows] == [(True, True), (False, False), (False, False), (True, False)]


def test_sanitizer_and_buckets(spark):
    messages = ["no such column: x", "Near \"x\": syntax ERROR", "disk " + "y" * 300, None, "no such table: t", "GROUP BY missing"]
    frame = spark.createDataFrame(list(enumerate(messages)), "i int, m string").orderBy("i")
    m = F.col("m")
    rows = frame.select(screening.sanitize_error(m), screening.message_bucket(m)).collect()
    assert [r[0] for r in rows] == ["no such column", "syntax error", ("disk " + "y" * 300)[:160], "", "no such table", "GROUP BY missing"]
    assert [r[1] for r in rows] == ["wrong_column", "schema_error", "schema_error", "schema_error", "wrong_table", "group_by_error"]


def test_plan_text(spark):
    sql = "SELECT a FROM t LEFT JOIN u ON t.x = u.x WHERE a > 1 GROUP BY a ORDER BY a LIMIT 2"
    row = spark.range(1).select(prompts.plan_text(F.lit(sql)), prompts.plan_text(F.lit("SELECT 1"))).first()
    assert row[0] == "tables: t, u\njoins: LEFT JOIN u ON t.x = u.x\nfilters: a > 1\ngrouping: a\nordering: a"
    assert row[1] == "tables: "

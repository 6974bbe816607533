"""Nested queries: clause texts end at their own depth, misplaced words are found at any depth."""

from __future__ import annotations

import itertools
import random
import time

from pyspark.sql import functions as F

from evalspark.functions import outline, prompts, screening

# Clause by clause: filters, joins, grouping, ordering of each query.
QUERIES = {
    "SELECT a FROM t WHERE a IN (1, 2) AND b > 3": ("a IN (1, 2) AND b > 3", [], None, None),
    "SELECT a FROM t WHERE a IN (SELECT x FROM u WHERE y = 1 GROUP BY x ORDER BY x LIMIT 1) OR f(b) > 3 GROUP BY a, coalesce(b, (c)) HAVING count(*) > (SELECT max(n) FROM v) ORDER BY a DESC, b LIMIT 2": (
        "a IN (SELECT x FROM u WHERE y = 1 GROUP BY x ORDER BY x LIMIT 1) OR f(b) > 3", [], "a, coalesce(b, (c))", "a DESC, b"),
    "SELECT * FROM (SELECT x FROM u WHERE y = ')') s": ("y = ')'", [], None, None),
    "WITH q AS (SELECT x FROM u WHERE deep = 1) SELECT x FROM q WHERE top = 2": ("top = 2", [], None, None),
    "SELECT a FROM t LEFT OUTER JOIN u ON t.x = u.x AND u.y IN (1, 2) CROSS JOIN (SELECT z FROM v JOIN w USING (z) WHERE z > 0) q, r WHERE 1 = 1": (
        "1 = 1",
        ["CROSS JOIN (SELECT z FROM v JOIN w USING (z) WHERE z > 0) q", "JOIN w USING (z)", "LEFT OUTER JOIN u ON t.x = u.x AND u.y IN (1, 2)"],
        None, None),
    "SELECT left(a, 2) FROM t JOIN u ON left(t.x, 1) = right(u.x, 1) ORDER BY left(a, 1)": (
        None, ["JOIN u ON left(t.x, 1) = right(u.x, 1)"], None, "left(a, 1)"),
    "SELECT row_number() OVER (PARTITION BY a ORDER BY b) FROM t": (None, [], None, "b"),
    "SELECT row_number() OVER (PARTITION BY a ORDER BY b) FROM t ORDER BY c": (None, [], None, "c"),
    "SELECT count(*) FILTER (WHERE a > (1)) FROM t WHERE b": ("b", [], None, None),
    "SELECT t.where, t.\"order by\" FROM t WHERE x = 'GROUP BY y' -- WHERE no\n GROUP BY z": ("x = 'GROUP BY y'", [], "z", None),
    "SELECT a FROM t WHERE x UNION SELECT b FROM u WHERE y": ("x", [], None, None),
    "SELECT a\n  FROM t\n WHERE x  =\t1;": ("x = 1", [], None, None),
    "SELECT CASE WHEN a THEN (SELECT 1 FROM q WHERE z) ELSE 2 END FROM t WHERE é = 'ü'": ("é = 'ü'", [], None, None),
    "SELECT 1": (None, [], None, None),
    "": (None, [], None, None),
}

# Whole selects to be put into one another.
PARTS = [
    "SELECT a FROM t",
    "SELECT a, count(DISTINCT b) FROM t WHERE c BETWEEN 1 AND 2 AND NOT d GROUP BY a HAVING count(*) > 1 ORDER BY 2 LIMIT 3",
    "SELECT extract(year FROM d), trim(both 'x' FROM e), substring(f FROM 2) FROM t",
    "SELECT CASE WHEN a IS NOT DISTINCT FROM b THEN 1 ELSE CASE x WHEN 2 THEN 3 END END AS end FROM t",
    "SELECT sum(a) FILTER (WHERE b > 0) OVER (PARTITION BY c ORDER BY d) FROM t JOIN u USING (x)",
    "SELECT group_concat(a ORDER BY b LIMIT 2) FROM (t CROSS JOIN u)",
    "SELECT t.from, t.order, t.group, x AS limit FROM t AS having JOIN u",
    "SELECT -a, +b, a * -1, count(*), t.* FROM t",
    "WITH q AS (SELECT 1), r(x, y) AS (SELECT 1, 2) SELECT * FROM q, r WHERE EXISTS (SELECT 1)",
    "SELECT 1 UNION ALL SELECT 2 EXCEPT SELECT 3",
    "(SELECT 1 FROM t) UNION (SELECT 2 FROM t) ORDER BY 1",
    "SELECT now() FROM t WHERE a IN () OR b LIKE '%(' ESCAPE '/'",
    "SELECT a FROM t WHERE (a, b) IN (SELECT c, d FROM u) LIMIT 5 OFFSET 2",
    "SELECT cast(a AS int) FROM t ORDER BY a COLLATE nocase DESC NULLS LAST",
]
BROKEN = [
    "SELECT a FROM t WHERE",
    "SELECT a FROM t WHERE x AND",
    "SELECT a FROM t WHERE x = GROUP BY a",
    "SELECT a FROM t WHERE x OR OR y",
    "SELECT a FROM WHERE x",
    "SELECT a FROM t JOIN ON t.x = 1",
    "SELECT a FROM t JOIN u ON WHERE x",
    "SELECT a FROM t WHERE x WHERE y",
    "SELECT a FROM t LIMIT 3 WHERE x",
    "SELECT a FROM t ORDER BY a GROUP BY a",
    "SELECT a WHERE x FROM t",
    "SELECT a FROM t HAVING x GROUP BY a",
    "SELECT (a FROM t) FROM t",
    "SELECT count(a WHERE b) FROM t",
    "SELECT f(, a) FROM t",
    "SELECT (= a) FROM t",
    "SELECT CASE WHEN a THEN 1 FROM t",
    "SELECT CASE WHEN THEN 1 END FROM t",
    "SELECT CASE a WHEN 1 THEN END FROM t",
    "SELECT a END FROM t",
    "SELECT a FROM t UNION",
    "SELECT a FROM t WHERE x IN",
    "SELECT a FROM t WHERE NOT",
    "SELECT a., b FROM t",
    "SELECT a FROM t LIMIT",
    "SELECT a || FROM t",
]


def _screened(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, sql string").orderBy("i")
    return [r[0].error_type for r in frame.select(screening.screen(F.col("sql"))).collect()]


def test_clauses_end_at_their_own_depth(spark):
    frame = spark.createDataFrame(list(enumerate(QUERIES)), "i int, sql string").orderBy("i")
    parts = prompts.sql_features(F.col("sql"))
    rows = frame.select(parts["filters"], parts["joins"], parts["grouping"], parts["ordering"]).collect()
    for text, row in zip(QUERIES, rows):
        assert tuple(row) == QUERIES[text], text


def test_depth_and_lead(spark):
    sql = F.lit("SELECT f((a)) FROM t NATURAL LEFT JOIN u")
    tokens = spark.range(1).select(outline.outline(sql)).first()[0]
    assert [(t.word, t.depth) for t in tokens[:7]] == [("select", 0), ("f", 0), ("(", 0), ("(", 1), ("a", 2), (")", 1), (")", 0)]
    assert [(t.word, t.lead) for t in tokens if t.word == "join"] == [("join", 9)]
    assert "".join(t.raw for t in tokens) == "SELECT f((a)) FROM t NATURAL LEFT JOIN u"


def test_whole_queries_nest_in_one_another(spark):
    holders = [
        "{}", "SELECT * FROM ({}) q", "SELECT a FROM t WHERE x IN ({}) AND y", "SELECT ({}) AS z, f(({}), 1) FROM t",
        "WITH q AS ({}) SELECT * FROM q", "SELECT a FROM t JOIN ({}) q ON q.x = (SELECT 1) ORDER BY ({})",
    ]
    texts = [h.replace("{}", p) for h, p in itertools.product(holders, PARTS)]
    texts += [h.replace("{}", t) for h, t in zip(itertools.cycle(holders[1:]), texts[len(PARTS):])]
    for text, kind in zip(texts, _screened(spark, texts)):
        assert kind == "none", text


def test_errors_are_found_at_any_depth(spark):
    holders = ["{}", "SELECT * FROM ({}) q", "SELECT a FROM t WHERE x IN ({}) AND y", "WITH q AS (SELECT f(({})) FROM t) SELECT * FROM q"]
    texts = [h.replace("{}", b) for h, b in itertools.product(holders, BROKEN)]
    for text, kind in zip(texts, _screened(spark, texts)):
        assert kind == "syntax_error", text


def test_what_is_quoted_is_not_read(spark):
    texts = [
        "SELECT 'WHERE AND )' FROM t", 'SELECT "from where" FROM `order by`', "SELECT a /* WHERE ( */ FROM t -- AND",
        "SELECT 'it''s (' FROM t WHERE a = ''",
    ]
    assert _screened(spark, texts) == ["none"] * len(texts)
    # What makes a statement unsafe is told before a word out of place.
    assert _screened(spark, ["SELECT a FROM t WHERE; DROP TABLE t", "DELETE FROM t WHERE AND"]) == ["unsafe_sql"] * 2


def test_the_cheap_look_agrees_with_the_fold(spark):
    rng = random.Random(2)
    pieces = [
        "select", "from", "where", "group by", "having", "order by", "limit", "a", "b", "t", "_", "1", "(", ")", "f(a)",
        "(a, b)", ",", "=", "and", "or", "not", "in", "on", "join", "is", "distinct", "case", "end", "when", "as", ".", "*", "union",
    ]
    texts = ["select " + " ".join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(3000)]
    texts += [f"select a from t where {' '.join(rng.choices(pieces[7:20], k=3))} order by b" for _ in range(1000)]
    frame = spark.createDataFrame([(t + " ;",) for t in texts], "text string")
    rows = frame.select("text", outline._flat(F.col("text")).alias("flat"), outline._fold_misplaced(F.col("text")).alias("bad")).collect()
    assert not [r.text for r in rows if r.flat and r.bad]
    assert sum(r.flat for r in rows) > 150


def test_work_grows_with_the_tokens(spark):
    def seconds(words):
        text = "SELECT " + "f ( a ) , " * words + "b FROM t"
        frame = spark.createDataFrame([(text,)], "sql string").select(F.size(outline.outline(F.col("sql"))).alias("n"))
        started = time.monotonic()
        assert frame.first().n == 5 * words + 4
        return time.monotonic() - started

    seconds(10)
    # Sixteen times the tokens; a list copied for each of them took far over a hundred times as long.
    assert seconds(4800) < 60 * max(seconds(300), 0.05)

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.completions import fallback_sql, parse_completion
from evalspark.operators import scoring


TABLES = ["supplier", "lineitem"]


def _parse(spark, text, plan=False):
    frame = spark.createDataFrame([(text,)], "t string")
    return frame.select(parse_completion(F.col("t"), plan).alias("p")).first().p


def test_blocks(spark):
    for table in TABLES:
        wrote, plan = f"SELECT max({table}) AS top\nFROM {table}", f"scan {table}, keep the top"
        for tag in ("sql", "Sql", "SQL"):
            p = _parse(spark, f"<plan>{plan} </plan><{tag}>\r\n\t{wrote} \r\n</{tag}>")
            assert (p.format_ok, p.sql, p.plan, p.parse_error) == (True, wrote, plan, None)
        p = _parse(spark, f"We need {table}.\n<sql>{wrote}</sql>\nThat was {table}.")
        assert p.format_ok and any("outside" in w for w in p.warnings)
        p = _parse(spark, f"<sql>\n```\n{wrote}\n```\n</sql>")
        assert (p.sql, p.format_ok) == (wrote, True) and any("fence" in w for w in p.warnings)


def test_refused(spark):
    reads = [f"SELECT count(*) FROM {t}" for t in TABLES]
    for text, word in {
        "".join(f"<sql>{r}</sql>" for r in reads): "duplicate",
        f"<sql>{reads[0]} and no end": "unbalanced",
        f"{reads[0]}</sql>": "unbalanced",
        f"<plan>first <sql>{reads[1]}</sql>": "unbalanced",
        "<sql> \t </sql>": "empty",
        f"</sql>{reads[1]}<sql>": "inverted",
        "\n".join(f"```sql\n{r}\n```" for r in reads): "multiple",
        f"{TABLES[0]} has no such column": "no <sql>",
        " ": "no <sql>",
    }.items():
        p = _parse(spark, text)
        assert p.sql is None and not p.format_ok and word in p.parse_error, text


def test_fence_and_required_plan(spark):
    p = _parse(spark, f"```sql\nSELECT * FROM {TABLES[0]}\n```")
    assert (p.sql, p.format_ok, p.protocol) == (f"SELECT * FROM {TABLES[0]}", False, "fence")
    assert "missing <sql> tags" in p.parse_error
    p = _parse(spark, "<sql>SELECT 1</sql>", plan=True)
    assert (p.sql, p.format_ok) == ("SELECT 1", False) and "<plan>" in p.parse_error


def test_fallback(spark):
    cases = {
        "Here is the SQL: SELECT 1": "SELECT 1",
        "WITH x AS (SELECT 1) SELECT * FROM x": "WITH x AS (SELECT 1) SELECT * FROM x",
        "SELECT 1; DROP TABLE t": None,
        "SELECT 1; SELECT 2": None,
        "<sql>SELECT 3</sql> and so on": "SELECT 3",
        "<sql>SELECT 1</sql><sql>SELECT 2</sql>": None,
        "I agree with you": None,
        "nothing": None,
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, t string").orderBy("i")
    assert [r[0] for r in frame.select(fallback_sql(F.col("t"))).collect()] == list(cases.values())


def test_rewards(spark):
    """What each kind of completion earns; wrong answers never pass a quarter."""
    texts = {
        "<plan>x</plan><sql>SELECT name FROM users ORDER BY id</sql>": ((True, True, False), 1.25),
        "<plan>x</plan><sql>SELECT 1</sql>": ((True, False, False), 0.25),
        "<plan>x</plan><sql>SELECT name FROM users WHERE 1 = 0</sql>": ((True, False, True), 0.5),
        "<plan>x</plan><sql>DROP TABLE users</sql>": ((True, True, False), -1.0),
        "<plan>x</plan><sql>SELECT name FROM users; DROP TABLE users</sql>": ((True, True, False), -1.0),
        "<plan>x</plan><sql>SELEC name</sql>": ((True, True, False), -1.0),
        "no tags": ((True, True, False), -0.8),
        "<sql>SELECT 1</sql><sql>SELECT 2</sql>": ((True, True, False), -0.8),
        "```sql\nSELECT 1\n```": ((True, True, False), 1.2),
        "so: SELECT 1": ((True, True, False), 0.8),
        "<plan>x</plan><sql>SELECT slow</sql>": ((False, False, False), 0.15),
    }
    rows = [(i, t, *o) for i, (t, (o, _)) in enumerate(texts.items())]
    frame = spark.createDataFrame(
        rows, "i int, t string, success boolean, strict_equivalent boolean, partial_credit boolean"
    )
    outcomes = frame.select("i", "success", "strict_equivalent", "partial_credit")
    scored = scoring.score(scoring.scorable(frame.select("i", "t"), "t", True), outcomes, ["i"])
    got = [r.total_reward for r in scored.orderBy("i").collect()]
    assert got == [total for _, total in texts.values()]

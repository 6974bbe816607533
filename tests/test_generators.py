"""Generators as table functions."""

from __future__ import annotations

import pytest

from evalspark.operators import generators

ROWS = [
    ("a", "d", "train", "CREATE TABLE t (x INT);\nCREATE TABLE other_one (y INT, z INT);\nQuestion: how many OTHER_ONE are there?"),
    ("b", "d", "dev", "no schema"),
    ("c", "d", "dev", None),
    ("d", "d", "dev", "create  table\nq (\n w TEXT)"),
]


@pytest.fixture
def prompts(spark):
    frame = spark.createDataFrame(ROWS, "example_id string, db_id string, split string, prompt string")
    frame.createOrReplaceTempView("prompts")
    generators.register_generator(spark, "candidates_of", generators.schema_generator)
    return frame


def test_called_from_sql(spark, prompts):
    found = spark.sql("SELECT * FROM candidates_of(TABLE(prompts), 3)")
    assert found.dtypes == [("example_id", "string"), ("candidate_index", "int"), ("raw_candidate_output", "string")]
    sql = {(r.example_id, r.candidate_index): r.raw_candidate_output.split("\n")[1] for r in found.collect()}
    assert sql == {
        ("a", 0): "SELECT COUNT(*) FROM other_one",
        ("a", 1): "SELECT COUNT(*) FROM t",
        ("a", 2): "SELECT y FROM other_one ORDER BY y",
        ("d", 0): "SELECT COUNT(*) FROM q",
        ("d", 1): "SELECT w FROM q ORDER BY w",
    }
    # Other queries go on from it, and columns may come in another order.
    one = "SELECT count(*) AS n FROM candidates_of(TABLE(SELECT prompt, split, db_id, example_id FROM prompts), 1)"
    assert spark.sql(one).first().n == 2


def test_other_columns_are_refused(spark, prompts):
    for columns in ("*, 'SELECT 1' AS gold_sql", "example_id, prompt", "example_id, db_id, split, prompt AS gold_sql"):
        with pytest.raises(Exception, match="may see exactly"):
            spark.sql(f"SELECT * FROM candidates_of(TABLE(SELECT {columns} FROM prompts), 1)").collect()


def test_any_generator(spark, prompts):
    generators.register_generator(spark, "echo", lambda prompt, context, n: [f"{context['split']} {len(prompt)}"] * n)
    rows = spark.sql("SELECT * FROM echo(TABLE(SELECT * FROM prompts WHERE split = 'dev'), 2)").collect()
    assert sorted((r.example_id, r.candidate_index) for r in rows) == [(i, k) for i in "bcd" for k in (0, 1)]
    assert {r.raw_candidate_output for r in rows if r.example_id == "b"} == {"dev 9"}

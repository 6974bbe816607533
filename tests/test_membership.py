"""Bloom filters of keys, and held-out overlap beyond what is broadcast."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evalspark.operators import leakage
from evalspark.operators.membership import likely_members


def test_members_pass_and_few_others(spark):
    count = 40_000
    keys = spark.range(count).select(F.lit("r").alias("rule"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    rows = spark.range(0, 240_000, 2).select(
        "id", F.lit("r").alias("rule"), F.sha2(F.col("id").cast("string"), 256).alias("key")
    )
    found = likely_members(rows, keys, ["rule", "key"], count)
    assert found.columns == rows.columns
    others = found.filter(F.col("id") >= count).count()
    assert found.filter(F.col("id") < count).count() == count // 2
    assert 0 < others < 0.01 * 100_000


def test_odd_filters(spark):
    rows = spark.createDataFrame([(None,), ("a",), ("a",), ("",)], "key string")
    assert likely_members(rows, rows.filter("key = 'a'"), ["key"], 1).count() == 2
    assert likely_members(rows, rows.filter("key is null"), ["key"], 1).count() == 1
    assert likely_members(rows, rows.limit(0), ["key"], 0).count() == 0
    assert likely_members(rows.limit(0), rows, ["key"], 4).count() == 0


@pytest.mark.parametrize("sent, filtered", [(0, 10**6), (0, 0)])
def test_heldout_overlap_by_every_way(spark, monkeypatch, sent, filtered):
    columns = ["example_id", "db_id", "split", "question", "evidence", "gold_sql"]
    corpus = spark.createDataFrame(
        [(f"e{i}", f"d{i % 7}", "train", f"Question {i % 300}?", "", f"SELECT {i}") for i in range(1000)]
        + [(f"e{i}", "d1", "test", f"Question {i}?", None, f"SELECT {i}") for i in range(990, 1010)],
        ", ".join(f"{c} string" for c in columns),
    )
    held = spark.createDataFrame(
        [(f"e{i}", f"d{i % 5}", "heldout", f"question {i}?", "", f"SELECT {i}") for i in range(250, 350)], corpus.schema
    )
    expected = sorted(map(tuple, leakage.heldout_overlap(corpus, held).collect()))
    assert any(n for _, n in expected)
    monkeypatch.setattr(leakage, "KEYS_SENT", sent)
    monkeypatch.setattr(leakage, "KEYS_FILTERED", filtered)
    assert sorted(map(tuple, leakage.heldout_overlap(corpus, held).collect())) == expected

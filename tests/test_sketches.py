"""Stored and merged sketches against exact ranks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import sketches

PROFILE = {"p01": 0.01, "p50": 0.5, "p99": 0.99, "max": 1.0}


def _off(values, value, rank):
    """How far a value's ranks are from the wanted one, as a share of the rows."""
    ordered = np.sort(values)
    low, high = np.searchsorted(ordered, value, "left"), np.searchsorted(ordered, value, "right")
    return max(0.0, low / len(ordered) - rank, rank - high / len(ordered))


def test_merged_sketches_keep_their_bound(spark, tmp_path):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(size=60_000), np.full(15_000, 3.0), rng.normal(50, 1, 5_000)])
    rows = spark.createDataFrame(
        [(i % 30, "hot" if i % 3 else f"db{i % 7}", float(v)) for i, v in enumerate(values)], "day int, db string, ms double"
    )
    sketches.sketch(rows, ["day", "db"], "ms").write.parquet(str(tmp_path / "sketches"))
    stored = spark.read.parquet(str(tmp_path / "sketches"))
    whole = sketches.quantiles(sketches.merge(stored, []), [], PROFILE).collect()
    assert {r.n for r in whole} == {80_000}
    for r in whole:
        assert _off(values, r.value, PROFILE[r["name"]]) <= sketches.rank_error()
    by = {r.db for r in stored.collect()}
    each = sketches.quantiles(sketches.merge(stored, ["db"]), ["db"], PROFILE).collect()
    assert len(each) == len(by) * len(PROFILE)
    hot = np.array([v for i, v in enumerate(values) if i % 3])
    for r in each:
        if r.db == "hot":
            assert _off(hot, r.value, PROFILE[r["name"]]) <= sketches.rank_error()
    # Merging reads the stored sketches alone.
    assert all("/sketches/" in f for f in sketches.merge(stored, []).inputFiles())


def test_few_rows_are_exact_and_odd_ones_left_out(spark):
    rows = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", None), ("a", float("nan")), ("b", None), (None, 7.0)], "db string, ms double"
    )
    made = sketches.sketch(rows, ["db"], "ms")
    assert {r.db: r.n for r in made.collect()} == {"a": 3, None: 1}
    got = {(r.db, r["name"]): r.value for r in sketches.quantiles(made, ["db"], {"half": 0.5, "max": 1.0}).collect()}
    assert got == {("a", "half"): 2.0, ("a", "max"): 3.0, (None, "half"): 7.0, (None, "max"): 7.0}
    none = sketches.sketch(rows.filter("false"), ["db"], "ms")
    assert none.count() == 0 and sketches.quantiles(sketches.merge(none, []), [], PROFILE).count() == 0


@pytest.mark.parametrize("k", [200, 800, 3200])
def test_larger_sketches_err_less(spark, k):
    values = np.random.default_rng(k).permutation(40_000).astype(float)
    rows = spark.createDataFrame([(float(v),) for v in values], "ms double").repartition(6)
    found = sketches.quantiles(sketches.sketch(rows, [], "ms", k), [], {f"{p}": p for p in (0.1, 0.5, 0.9)}).select("name", F.col("value"))
    assert all(_off(values, r.value, float(r["name"])) <= sketches.rank_error(k) for r in found.collect())

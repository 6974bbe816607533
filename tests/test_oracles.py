"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
import oracle
from evalspark.plans.workload import EVALUATION

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert oracle.difference(frame, con, ORACLES[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    records = contract.entry(spark)
    kinds = [kind for _, candidates in EVALUATION.values() for _, kind in candidates]
    equal = sum(kind in ("unordered_rows", "ordered_rows") for kind in kinds)
    assert equal == 6 and records.filter("execution_equivalent").count() == equal
    assert records.filter("error_bucket = 'unsafe_sql'").count() == 2

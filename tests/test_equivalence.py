from __future__ import annotations

import math
import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions.screening import outer_order_by
from evalspark.operators import equivalence as eq
from evalspark.operators import workload
from evalspark.operators.workload import ROW_SCHEMA, RUN_SCHEMA
from evalspark.plans import adapters, equivalence_queries, registry
from evalspark.session import scratch_path


def _cell(v):
    if v is None:
        return ("null", None, None)
    if isinstance(v, bool):
        return ("bool", None, str(v).lower())
    if isinstance(v, (int, float)):
        return ("num", float(v), repr(v) if math.isfinite(v) else {"inf": "Infinity", "nan": "NaN"}[repr(v)])
    return ("str", None, v)


def _run(example, k, rows, columns=None, sql="SELECT x FROM t", ok=True, truncated=False):
    columns = columns or [f"c{i}" for i in range(len(rows[0]) if rows else 1)]
    error = "none" if ok else "sqlite_error"
    return (example, k, sql, ok, columns, error, "", 1.0, False, len(rows), truncated)


def judge(spark, cases, **options):
    """Verdicts of ``name -> (candidate rows, gold rows, options)``."""
    runs, gold_runs, rows, gold_rows = [], [], [], []
    for name, (mine, gold, extra) in cases.items():
        runs.append(_run(name, 0, mine, **extra.get("mine", {})))
        gold_runs.append(_run(name, 0, gold, **extra.get("gold", {})))
        rows += [(name, 0, i, [_cell(v) for v in r]) for i, r in enumerate(mine)]
        gold_rows += [(name, 0, i, [_cell(v) for v in r]) for i, r in enumerate(gold)]
    gold_frame = spark.createDataFrame(gold_runs, RUN_SCHEMA).drop("candidate_index")
    if "tables" in options:
        known = F.array(*[F.lit(x) for x in options.pop("tables")])
        gold_frame = gold_frame.withColumn("schema_tables", known)
    found = eq.verdicts(
        spark.createDataFrame(runs, RUN_SCHEMA),
        gold_frame,
        spark.createDataFrame(rows, ROW_SCHEMA),
        spark.createDataFrame(gold_rows, ROW_SCHEMA).drop("candidate_index"),
        **options,
    )
    return {r.example_id: r for r in found.collect()}


def test_unordered(spark):
    found = judge(
        spark,
        {
            "multiset": ([["a"], ["b"]], [["b"], ["a"]], {}),
            "doubles": ([[1], [1], [2]], [[1], [2], [2]], {}),
            "null-text": ([[None]], [["NULL"]], {}),
            "null": ([[None], [1]], [[1], [None]], {}),
            "close": ([[1.0], [2.0000001]], [[1], [2.0]], {}),
            "far": ([[1.01]], [[1.0]], {}),
            "number-text": ([[1]], [["1"]], {}),
            "bool-number": ([[True]], [[1]], {}),
            "huge": ([[1e30]], [[1e30]], {}),
            "nan": ([[float("nan")], [float("inf")]], [[float("inf")], [float("nan")]], {}),
            "half-even": ([[0.0000005]], [[0.0]], {}),
            "framing": ([["a", "b:c"]], [["a:b", "c"]], {}),
            "fewer": ([[1]], [[1], [2]], {}),
        },
    )
    equal = {n for n, r in found.items() if r.equivalent}
    assert equal == {"multiset", "null", "close", "huge", "nan", "half-even"}
    assert all(found[n].kind == "unordered_rows" for n in equal)
    assert found["doubles"].reason == "row multisets differ"


def test_ordered(spark):
    ordered = {"gold": {"sql": "SELECT x FROM t ORDER BY x"}}
    found = judge(
        spark,
        {
            "turned": ([["a"], ["b"]], [["b"], ["a"]], ordered),
            "same": ([["b"], ["a"]], [["b"], ["a"]], ordered),
            "relative": ([[1e9 + 100], [0.0]], [[1e9], [1e-7]], ordered),
            "too-far": ([[5, 1.1], [6, 2.0]], [[5, 1.1], [6, 2.1]], ordered),
            "longer": ([["a"], ["b"]], [["a"]], ordered),
            "nan": ([[float("nan")], [float("inf")]], [[float("nan")], [float("inf")]], ordered),
            "types": ([["1"]], [[1]], ordered),
        },
    )
    equal = {n for n, r in found.items() if r.strict_equivalent}
    assert equal == {"same", "relative", "nan"}
    assert all(r.order_sensitive for r in found.values())
    assert found["same"].kind == "ordered_rows"
    assert found["too-far"].reason == "ordered mismatch at row 1 column 1"
    assert found["longer"].reason == "row counts differ"


def test_gates(spark):
    found = judge(
        spark,
        {
            "gold-failed": ([["a"]], [["a"]], {"gold": {"ok": False}}),
            "failed": ([], [["a"]], {"mine": {"ok": False}}),
            "cut": ([["a"]], [["a"]], {"mine": {"truncated": True}}),
            "gold-cut": ([["a"]], [["a"]], {"gold": {"truncated": True}}),
            "narrow": ([["a"]], [["a", "b"]], {}),
            "renamed": ([[3]], [[3]], {"mine": {"columns": ["total"]}, "gold": {"columns": ["COUNT(*)"]}}),
            "empty-mine": ([], [["a"]], {}),
            "empty-gold": ([["a"]], [], {}),
        },
    )
    assert {n for n, r in found.items() if r.equivalent} == {"renamed"}
    assert found["renamed"].column_count_match and not found["renamed"].column_match
    assert found["cut"].kind == found["gold-cut"].kind == "truncated_unverified"
    assert not found["narrow"].column_count_match and "column" in found["narrow"].reason
    assert "failed" in found["failed"].reason


def test_both_empty(spark):
    def case(mine):
        return ([], [], {"mine": {"sql": mine}, "gold": {"sql": "SELECT x FROM users WHERE 1=0"}})

    found = judge(
        spark,
        {
            "constant": case("SELECT 1 WHERE 1=0"),
            "sound": case("SELECT y FROM users WHERE 2=0"),
            "other": case("SELECT x FROM other WHERE 1=0"),
            "none": case(None),
        },
        tables=["users"],
    )
    assert not any(r.strict_equivalent for r in found.values())
    assert {n for n, r in found.items() if r.partial_credit} == {"sound"}
    assert found["sound"].kind == "empty_structural_partial"
    assert {found[n].kind for n in ("constant", "other", "none")} == {"empty_unverified"}


def test_order_rule_option(spark):
    nested = {"gold": {"sql": "SELECT x FROM (SELECT x FROM t ORDER BY x LIMIT 2)"}}
    cases = {"n": ([["a"], ["b"]], [["b"], ["a"]], nested)}
    assert not judge(spark, cases)["n"].equivalent
    assert judge(spark, cases, order_rule=outer_order_by)["n"].equivalent


def test_tolerance(spark):
    cases = {"n": ([[1.04]], [[1.0]], {}), "m": ([[1.06]], [[1.0]], {})}
    found = judge(spark, cases, tolerance=0.1)
    assert found["n"].equivalent and not found["m"].equivalent
    with pytest.raises(ValueError):
        eq.normalize_cell(F.col("c"), -0.1)


def test_rows_from_results(spark):
    line = '{"example_id":"e","rows":[[1,"a",null],[2.5,true,"é"]]}'
    schema = "example_id string, rows array<array<variant>>"
    logged = spark.createDataFrame([(line,)], "l string").select(F.from_json("l", schema).alias("r")).select("r.*")
    rows = eq.rows_from_results(logged).orderBy("row_idx").collect()
    assert [[tuple(c) for c in r.cells] for r in rows] == [
        [("num", 1.0, "1"), ("str", None, "a"), ("null", None, None)],
        [("num", 2.5, "2.5"), ("bool", None, "true"), ("str", None, "é")],
    ]


def test_numbers_round_as_their_decimal_text(spark):
    """Counts of steps against decimal arithmetic, around ties and over all magnitudes."""
    rng = np.random.default_rng(11)
    values = [0.0, -0.0, 0.5, 1, -1, 10**15, 2**53 + 1, 123456789012345678, 1e19, 0.1 + 0.2]
    values += [k * 1e-7 for k in range(-40, 41)] + [k + 5e-7 for k in range(1, 200, 7)]
    values += [float(v) for v in rng.normal(0, 1, 200) * 10.0 ** rng.integers(-9, 15, 200)]
    rows = [(i, _cell(v)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, c struct<tag:string,num:double,str:string>")
    got = frame.orderBy("i").select(eq.normalize_cell(F.col("c"))).collect()
    for value, row in zip(values, got):
        want = Decimal(repr(value)).quantize(Decimal("0.000001"))
        assert Decimal(row[0][4:]) == want * 10**6, value


def test_row_cap(spark):
    rows = spark.range(7).select(F.lit("e").alias("example_id"), F.col("id").alias("row_idx"))
    kept, sizes = eq.apply_row_cap(rows, ["example_id"], 5)
    assert kept.count() == 5
    assert sizes.first()[1:] == (5, True)


def test_wide_numbers_and_bytes(spark):
    """Neighbours of many digits differ; equal numbers of several types are one."""
    big = Decimal(10**25)
    frame = spark.createDataFrame(
        [(big + 1, big + 2, Decimal("10000000000000000000001.0000005"), 1e25, b"\xff\x01", b"caf\xc3\xa9")],
        "a decimal(38,0), b decimal(38,0), c decimal(38,10), d double, e binary, f binary",
    )
    cells = eq.cells(frame, frame.columns)
    texts = frame.select(F.transform(cells, lambda c: eq.normalize_cell(c))).first()[0]
    assert texts[0] == f"num:{10**31 + 10**6}" and texts[1] == f"num:{10**31 + 2 * 10**6}"
    # Half a step goes to the even one.
    assert texts[2] == f"num:{(10**22 + 1) * 10**6}"
    assert texts[3] == f"num:{10**31}"
    assert texts[4:] == ["bytes:FF01", "str:caf\u00e9"]
    exact = frame.select(F.transform(cells, lambda c: eq.normalize_cell(c, 0))).first()[0]
    assert exact[0] != exact[1]


def test_depth_of_order(spark):
    deep = "SELECT * FROM " + "(" * 9 + "SELECT 1 ORDER BY 1" + ")" * 9 + " t"
    texts = [deep, deep + " ORDER BY 1", deep + ")) ORDER BY 1"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, s string").orderBy("i")
    assert [r[0] for r in frame.select(outer_order_by(F.col("s"))).collect()] == [False, True, True]


@pytest.fixture
def plain_plans(spark):
    """Plans as they are written: nothing is sent around or put together at run time."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("false", "-1")):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_an_orders_lines_are_brought_together(spark, tmp_path, plain_plans):
    lines = [(o, n, float(o + n), "ANR"[n % 3]) for o in range(40) for n in (1, 2, 2, 3, 5)] + [(None, None, 1.0, None)]
    schema = "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = registry.Tables(spark, str(tmp_path)).adapted("gold_rows")
    found = rows.withColumn("at", F.spark_partition_id()).collect()
    assert len(found) == 161 and len({r.at for r in found}) > 1
    assert len({(r.o, r.at) for r in found}) == 41


def test_a_rows_digest_is_made_once_and_a_results_is_short(spark, plain_plans):
    rows = spark.createDataFrame([("a", 0, 0, [_cell(1.5), _cell("x")]), ("a", 0, 1, [_cell(2)])], ROW_SCHEMA)
    lines = eq._summaries(rows, ["example_id", "candidate_index"], eq.TOLERANCE)
    (line,) = lines.collect()
    assert line["size"] == 2 and len(line.sums) == 16


def test_runs_are_kept_without_their_texts(spark, monkeypatch):
    kept = []
    plain = eq.materialize
    monkeypatch.setattr(eq, "materialize", lambda df, name: kept.extend(df.columns) or plain(df, name))
    found = judge(spark, {"a": ([["x"]], [["x"]], {}), "none": ([], [], {})}, tables=["t"])
    assert found["a"].strict_equivalent and found["none"].kind == "empty_structural_partial"
    assert "gate" in kept and not {"sql", "gold_sql", "columns", "gold_columns", "schema_tables", "gold_tables"} & set(kept)


def test_a_long_result_is_no_tasks_own(spark, plain_plans):
    frame = spark.createDataFrame([("e", 0, "SELECT id FROM range(0, 50, 1, 5) ORDER BY id", "k")], "example_id string, candidate_index int, sql string, cache_key string")
    for _ in range(2):
        _, rows = workload.run_workload(spark, frame.drop("cache_key"))
        assert sorted(r.row_idx for r in rows.collect()) == list(range(50))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    store = scratch_path(spark, "gold")
    for _ in range(2):
        _, rows, _ = workload.run_gold(spark, frame, store)
        assert rows.count() == 50
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[(cache_key#\w+, batch|example_id)", plan)


def _odd_rows(spark):
    """Result rows with null keys, rows without counterpart, and a place that gold has twice."""
    gold = [("a", 0, [1.0, "x"]), ("a", 1, [2.0, "y"]), ("b", 0, [3.0, "z"]), ("b", 0, [3.5, "z"]), ("c", None, [1.0, "x"]), (None, 0, [1.0, "x"])]
    gold += [("d", i, [float(i), "d"]) for i in range(50)]
    mine = [("a", 0, 0, [1.0, "x"]), ("a", 0, 1, [2.0 + 1e-7, "y"]), ("a", 1, 0, [1.0, "x"]), ("a", 1, 1, [2.0, "n"]), ("a", 1, 7, [2.0, "y"])]
    mine += [("b", 0, 0, [3.0, "z"]), ("c", 0, None, [1.0, "x"]), (None, 0, 0, [1.0, "x"]), ("e", 2, 4, [1.0, "x"])]
    mine += [("d", k, i, [float(i) + (0.5 if i >= 40 and k else 0), "d"]) for k in range(2) for i in range(50)]
    cells = lambda r: [_cell(v) for v in r]
    return (
        spark.createDataFrame([(e, k, i, cells(r)) for e, k, i, r in mine], ROW_SCHEMA),
        spark.createDataFrame([(e, 0, i, cells(r)) for e, i, r in gold], ROW_SCHEMA).drop("candidate_index"),
    )


@pytest.mark.parametrize("together", [False, True])
def test_places_of_odd_rows(spark, together):
    mine, gold = _odd_rows(spark)
    if together:
        mine, gold = mine.repartition(3, "example_id"), gold.repartition(3, "example_id")
    found = {(r.example_id, r.candidate_index): (r.bad_row, r.bad_col) for r in eq.ordered_mismatches(mine, gold).collect()}
    assert found == {
        ("a", 0): (None, None), ("a", 1): (1, 1), ("b", 0): (0, 0), ("c", 0): (None, None), (None, 0): (0, 0),
        ("e", 2): (4, 0), ("d", 0): (None, None), ("d", 1): (40, 0),
    }


def _lines(spark, path):
    rows = [(o, n, float(o * 10 + n), "ANR"[n % 3]) for o in range(300) for n in range(1, 2 + o % 7)]
    schema = "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string"
    spark.createDataFrame([*rows, (None, None, 1.0, None), (None, 2, 1.0, "A")], schema).write.parquet(str(path / "lineitem.parquet"))
    return registry.Tables(spark, str(path))


def _judged(t, **options):
    runs, gold_runs = equivalence_queries.runs(t)
    rows = (equivalence_queries.long_rows(t, name) for name in ("candidate_rows", "gold_rows"))
    return eq.verdicts(runs, gold_runs, *rows, **options)


@pytest.mark.parametrize("by_example", [False, True])
def test_many_runs_are_judged_as_few(spark, tmp_path, monkeypatch, by_example):
    t = _lines(spark, tmp_path)
    expected = sorted(map(str, _judged(t).collect()))
    assert len(expected) > 1500 and {"ordered_rows", "unordered_rows", "not_equivalent"} <= {re.search(r"kind='(\w+)'", x)[1] for x in expected}
    monkeypatch.setattr(eq, "RUNS_SENT", 0)
    assert sorted(map(str, _judged(t, by_example=by_example).collect())) == expected


def test_rows_that_lie_together_are_not_moved(spark, tmp_path, monkeypatch, plain_plans):
    _lines(spark, tmp_path)
    monkeypatch.setattr(eq, "RUNS_SENT", 0)
    plan = registry.QUERIES["equiv_verdicts"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    moved = [m[1] for x in plan.splitlines() if "Reused" not in x and (m := re.search(r"Exchange hashpartitioning.*, (\w+),", x))]
    # The lines, once; the ids that wait, twice; the runs that wait and what has become of them, twice.
    assert sorted(moved) == ["ENSURE_REQUIREMENTS"] * 6 + ["REPARTITION_BY_NUM"]
    assert not re.search(r"hashpartitioning\([^)]*_?row", plan)


def test_long_tables_are_cut_into_more_tasks(spark, tmp_path, monkeypatch, plain_plans):
    t = _lines(spark, tmp_path)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert t.adapted("gold_rows").rdd.getNumPartitions() == usual
    monkeypatch.setattr(adapters, "LINES_PER_TASK", 100)
    assert t.adapted("gold_rows").rdd.getNumPartitions() == 12

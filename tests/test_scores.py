"""Rows, metrics, signal, statistics and workflow on hand-made input."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.functions.prompts import FEEDBACK_PARSE, FEEDBACK_UNSAFE, FEEDBACK_WRONG, retry_feedback
from evalspark.operators import equivalence, latency, metrics, rows, signal, stats, validate, workflow, workload
from evalspark.session import scratch_path
from evalspark.streaming import intake
from test_rules import examples


def test_metrics_of_four_records(spark):
    fields = "split string, execution_equivalent boolean, execution_success boolean, sql_parse_ok boolean, format_ok boolean, error_bucket string, exact_match boolean, verification_partial boolean, latency_ms double"
    data = [
        ("dev", True, True, True, True, "none", False, False, 1.0),
        ("dev", False, True, True, True, "wrong_result", False, False, 1.0),
        ("dev", False, False, False, False, "format_error", False, False, 1.0),
        ("test", False, False, False, True, "unsafe_sql", False, False, 1.0),
    ]
    found = {r.split: r for r in metrics.evaluation_metrics(spark.createDataFrame(data, fields)).collect()}
    total = found["ALL"]
    assert (total.execution_accuracy, total.valid_sql_rate, total.sql_parse_valid_rate) == (0.25, 0.5, 0.5)
    assert (total.format_valid_rate, total.execution_success_rate, total.unsafe_sql_rate) == (0.75, 0.5, 0.25)
    assert total.mean_latency_ms == 1.0 and total.num_examples == 4
    assert found["dev"].execution_accuracy == pytest.approx(1 / 3)
    nothing = metrics.evaluation_metrics(spark.createDataFrame([], fields)).collect()
    assert [(r.split, r.num_examples, r.execution_accuracy, r.mean_latency_ms) for r in nothing] == [("ALL", 0, 0.0, None)]


def _samples(spark, *items):
    fields = "generation_group_id string, reward double, parse_ok boolean, safe boolean, execution_success boolean, strict_equivalent boolean"
    return spark.createDataFrame(list(items), fields)


def test_signal(spark):
    strict = signal.signal_stats(_samples(spark, ("g", -0.5, True, True, True, True), ("g", 0.5, True, True, True, False))).first()
    assert (strict.generation_group_count, strict.nonzero_reward_std_group_count, strict.semantic_variance_group_count) == (1, 1, 1)
    assert (strict.parse_valid_completion_count, strict.execution_success_count, strict.strict_correct_count) == (2, 2, 1)
    assert strict.all_rewards_finite and strict.zero_std_group_fraction == 0.0
    form = signal.signal_stats(_samples(spark, ("g", -0.5, False, False, False, False), ("g", 0.5, False, False, False, False))).first()
    assert (form.nonzero_reward_std_group_count, form.semantic_variance_group_count) == (1, 0)
    null = signal.signal_stats(_samples(spark, ("g", 0.1, True, None, None, None), ("g", 0.2, True, True, None, None), ("h", None, True, None, None, None))).first()
    assert (null.semantic_variance_group_count, null.all_rewards_finite, null.generation_group_count) == (1, False, 2)
    empty = signal.signal_stats(_samples(spark)).first()
    assert (empty.generation_group_count, empty.zero_std_group_fraction, empty.all_rewards_finite) == (0, None, False)
    infinite = signal.signal_stats(_samples(spark, ("g", float("inf"), True, True, True, True))).first()
    assert not infinite.all_rewards_finite


def test_histogram(spark):
    frame = spark.createDataFrame([(0.3,), (0.35,), (-0.05,), (1.25,), (None,), (-1.0,)], "total_reward double")
    got = {r.bucket: r.n for r in signal.reward_histogram(frame).collect()}
    assert got == {"0.30": 2, "-0.10": 1, "1.20": 1, "None": 1, "-1.00": 1}


def test_gates(spark):
    base = dict(
        generation_group_count=10, nonzero_reward_std_group_count=5, nonzero_grad_step_count=3,
        parse_valid_completion_count=1, execution_success_count=2, semantic_variance_group_count=2,
        all_rewards_finite=True, trainable_param_sha256_changed=True, parameter_delta_l2=0.1,
        changed_parameter_tensor_count=1,
    )

    def gates(**change):
        row = signal.signal_gates(spark.createDataFrame([{**base, **change}])).first()
        return row.strict_gate, row.strong_gate

    assert gates() == (True, True)
    assert gates(generation_group_count=9) == (True, False)
    assert gates(nonzero_reward_std_group_count=2) == (False, False)
    assert gates(parameter_delta_l2=0.0) == (False, False)
    assert gates(all_rewards_finite=False) == (False, False)


def _arms(spark, a, b):
    left = spark.createDataFrame([(str(i), v) for i, v in enumerate(a)], "example_id string, correct boolean")
    right = spark.createDataFrame([(str(i), v) for i, v in enumerate(b)], "example_id string, correct boolean")
    return left, right


def test_mcnemar(spark):
    tied = stats.mcnemar(*_arms(spark, [True, False], [False, True])).first()
    assert (tied.b, tied.c, tied.discordant, tied.n, tied.p_value) == (1, 1, 2, 2, 1.0)
    known = stats.mcnemar(*_arms(spark, [True] + [False] * 9, [False] + [True] * 9)).first()
    assert (known.b, known.c) == (1, 9) and known.p_value == pytest.approx(22 / 1024)
    assert stats.mcnemar(*_arms(spark, [True] * 10, [False] * 10)).first().p_value < 0.01
    assert stats.mcnemar(*_arms(spark, [True], [True])).first().p_value == 1.0
    with pytest.raises(Exception, match="not paired"):
        stats.mcnemar(*_arms(spark, [True], [True, False])).collect()


def test_binomial_tail():
    for n in (1, 2, 7, 30, 200, 5000):
        for k in {0, 1, n // 3, n // 2 - (n % 2 == 0 and n > 2), n // 2}:
            exact = 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n
            assert stats.two_sided_binomial(k, n) == pytest.approx(min(1.0, exact), rel=1e-9)
    assert 0 < stats.two_sided_binomial(499_000, 1_000_000) < 0.05
    assert stats.two_sided_binomial(500_000, 1_000_000) == 1.0


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    values = rng.choice([-1.0, 0.0, 1.0], 800, p=[0.2, 0.5, 0.3])
    frame = spark.createDataFrame([(float(v),) for v in values], "difference double")
    got = stats.bootstrap_ci(frame, seed=1).first()
    resampled = values[rng.integers(0, 800, (4000, 800))].mean(axis=1)
    low, high = np.quantile(resampled, [0.025, 0.975])
    assert got.mean_difference == pytest.approx(values.mean())
    assert got.ci_low == pytest.approx(low, abs=0.008) and got.ci_high == pytest.approx(high, abs=0.008)
    again = stats.bootstrap_ci(frame.repartition(7), seed=1).first()
    assert (again.ci_low, again.ci_high) == pytest.approx((got.ci_low, got.ci_high))
    same = stats.bootstrap_ci(spark.createDataFrame([(0.1,)] * 30, "difference double"), n_bootstrap=200).first()
    assert same.ci_low == pytest.approx(0.1) and same.ci_high == pytest.approx(0.1)
    none = stats.bootstrap_ci(frame.filter("false")).first()
    assert (none.mean_difference, none.ci_low, none.ci_high, none.n_pairs) == (0.0, 0.0, 0.0, 0)
    for bad in ({"n_bootstrap": 10}, {"alpha": 1.5}):
        with pytest.raises(validate.DataError):
            stats.bootstrap_ci(frame, **bad)


@pytest.mark.parametrize("method", ["poisson", "multinomial"])
def test_bootstrap_variants(spark, method):
    """Few values with large counts, many values with small ones, and skew, against numpy."""
    rng = np.random.default_rng(8)
    for values in (
        rng.choice([-1.0, 0.0, 1.0], 3000, p=[0.1, 0.6, 0.3]),
        rng.normal(size=500),
        rng.exponential(size=400),
    ):
        frame = spark.createDataFrame([(float(v),) for v in values], "difference double")
        got = stats.bootstrap_ci(frame, seed=5, method=method).first()
        resampled = values[rng.integers(0, len(values), (4000, len(values)))].mean(axis=1)
        low, high = np.quantile(resampled, [0.025, 0.975])
        close = 0.12 * (high - low)
        assert got.ci_low == pytest.approx(low, abs=close) and got.ci_high == pytest.approx(high, abs=close)
        again = stats.bootstrap_ci(frame.repartition(5), seed=5, method=method).first()
        assert (again.ci_low, again.ci_high) == pytest.approx((got.ci_low, got.ci_high))
        other = stats.bootstrap_ci(frame, seed=6, method=method).first()
        assert (other.ci_low, other.ci_high) != (got.ci_low, got.ci_high)
    none = stats.bootstrap_ci(frame.filter("false"), method=method).first()
    assert (none.mean_difference, none.ci_low, none.ci_high, none.n_pairs) == (0.0, 0.0, 0.0, 0)
    gaps = spark.createDataFrame([(None,), (2.0,), (2.0,)], "difference double")
    assert tuple(stats.bootstrap_ci(gaps, method=method).first())[:3] == (2.0, 2.0, 2.0)


def test_bootstrap_draws():
    """Uniform numbers are even and unrelated between keys; counts are the inverse of the exact distribution."""
    draws = np.array([stats.uniform_draws(key, np.arange(2000)) for key in (0, 1, 77, 2**32 - 1)])
    assert np.histogram(draws, 10, (0, 1))[0] == pytest.approx(800, abs=120)
    assert np.abs(np.corrcoef(draws) - np.eye(4)).max() < 0.08
    even = (np.arange(200_000) + 0.5) / 200_000
    for n in (1, 3, 50, 10_000, 4_000_000):
        counts = stats.poisson_counts(n, even)
        assert counts.mean() == pytest.approx(n, rel=1e-4, abs=1e-3) and counts.var() == pytest.approx(n, rel=2e-3)
    assert (stats.poisson_counts(1, np.array([0.36, 0.37, 0.7357, 0.7359])) == [0, 1, 1, 2]).all()


CANDIDATE = "example_id string, candidate_index int, created_at string, candidate_sql string, parse_valid boolean, safe boolean, execution_success boolean, execution_equivalent boolean, execution_error_message_sanitized string, execution_error_type string"


def _candidates(spark, *items):
    return spark.createDataFrame([(*i, None, None) for i in items], CANDIDATE)


def test_targets(spark):
    ok = (True, True, True, True)
    made = _candidates(
        spark,
        ("ex-1", 1, "t", "SELECT second", *ok), ("ex-1", 0, "u", "SELECT first", *ok), ("ex-1", 0, "t", "SELECT early", *ok),
        ("ex-2", 0, "t", "SELECT wrong", True, True, True, False), ("ex-2", 1, "t", "", *ok),
    )
    assert [tuple(r) for r in rows.verified_targets(made).collect()] == [("ex-1", "SELECT early")]
    two = examples(spark, {"example_id": "ex-1"}, {"example_id": "ex-2", "question": "q2"})
    with pytest.raises(rows.TargetMissing, match="ex-2"):
        rows.paired_targets(two, made)
    paired, dropped, summary = rows.paired_targets(two, made, require_all=False)
    assert [r.distilled_sql for r in paired.collect()] == ["SELECT early"]
    assert [r.example_id for r in dropped.collect()] == ["ex-2"]
    assert tuple(summary.first()) == (2, 1, 1, 0.5)
    with pytest.raises(rows.TargetMissing):
        rows.sft_rows(two, rows.verified_targets(made))
    plan = rows.sft_rows(two, include_plan=True).first().output
    assert plan.startswith("<plan>\ntables: users\n</plan>\n<sql>\n")


def test_budget(spark):
    schema = "\n".join(f"CREATE TABLE t{i} (c{i} INTEGER);" for i in range(30))
    long = examples(spark, {"schema_text": schema})
    row = rows.prompt_rows_within(long, 50).first()
    assert row.prompt_truncated and len(row.prompt.split()) <= 50
    fuller = rows.prompt_rows_within(long, 55).first()
    assert row.kept_lines < fuller.kept_lines
    tiny = rows.prompt_rows_within(long, 5).first()
    assert tiny.kept_lines == 0 and "(schema truncated to fit budget)" in tiny.prompt
    whole = rows.prompt_rows_within(long, 500).first()
    assert not whole.prompt_truncated and whole.prompt == rows.prompt_rows(long).first().prompt


def test_feedback(spark):
    cases = [
        ("unsafe_or_multiple_statements", None, None, FEEDBACK_UNSAFE), ("parse_failed", None, None, FEEDBACK_PARSE),
        ("execution_failed", "no such table", "e", "Previous query failed with SQLite error category: no such table."),
        ("execution_failed", None, "timeout", "Previous query failed with SQLite error category: timeout."),
        ("execution_failed", "", None, FEEDBACK_PARSE), ("wrong_result", None, None, FEEDBACK_WRONG),
    ]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r string, m string, t string, want string")
    got = frame.select(retry_feedback(F.col("r"), F.col("m"), F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_rounds(spark):
    three = examples(spark, *[{"example_id": f"ex-{i}", "question": f"q{i}"} for i in range(3)])
    made = _candidates(
        spark, ("ex-0", 0, "t", "SELECT 1", True, True, True, True), ("ex-1", 0, "t", None, False, False, False, False),
        ("ex-1", 1, "t", "SELECT 2", True, True, True, False),
    )
    asked = {r.example_id: (r.candidate_index, r.retry_reason) for r in workflow.next_attempts(three, made, 3).collect()}
    assert asked == {"ex-1": (2, "wrong_result"), "ex-2": (0, None)}
    assert {r.example_id for r in workflow.next_attempts(three, made, 2).collect()} == {"ex-2"}
    ordered = three.withColumn("ord", F.substring("example_id", 4, 1).cast("int"))
    assert workflow.until_target(ordered, made, "ord", 1).count() == 1
    assert workflow.until_target(ordered, made, "ord", 2).count() == 3


def test_resume_and_generator(spark):
    settings = {"dataset": "d", "model": "m"}
    current = workflow.run_fingerprint(settings)
    mine = spark.range(2).select(current.alias("run_fingerprint"))
    workflow.check_resume(mine, current)
    with pytest.raises(workflow.FingerprintMismatch):
        workflow.check_resume(mine, workflow.run_fingerprint({**settings, "model": "n"}))
    with pytest.raises(workflow.FingerprintMismatch):
        workflow.check_resume(mine.unionAll(spark.sql("select cast(null as string)")), current)
    with pytest.raises(validate.DataError, match="gold_sql"):
        workflow.generate(examples(spark, {}).withColumn("prompt", F.lit("p")), lambda *_: [])
    inputs = examples(spark, {}).select("example_id", "db_id", "split", F.lit("p").alias("prompt"))
    out = workflow.generate(inputs, lambda prompt, context, n: [prompt + context["split"]] * n, 2).collect()
    assert [tuple(r) for r in out] == [("ex-1", 0, "ptrain"), ("ex-1", 1, "ptrain")]


def test_escalation_cap(spark):
    many = spark.range(101).select(F.col("id").cast("string").alias("example_id"))
    source = many.withColumn("gold_sql", F.lit("SELECT 1"))
    with pytest.raises(validate.DataError):
        latency.escalation_set(many, source, latency.ESCALATION_CAP)
    some = latency.escalation_set(many.limit(3), source.filter("example_id = '0'"))
    assert some.filter("matched").count() <= 1
    with pytest.raises(validate.DataError):
        latency.rerun_of_failures(source, spark.createDataFrame([("x", "timeout")], "example_id string, error_type string"), "timeout")


def test_stream_restarts(spark):
    """A log delivered in parts, with the query stopped between them, counts once."""
    path, table, checkpoint = (scratch_path(spark, n) for n in ("in", "table", "checkpoint"))
    total = 0
    for part in range(3):
        frame = spark.range(10).select(
            F.lit(f"g{part % 2}").alias("generation_group_id"), (F.col("id") / 10).alias("reward")
        )
        frame.write.mode("append").json(path)
        intake.stream_group_totals(intake.stream_samples(spark, path), table, checkpoint)
        total += 10
    rows_ = {r.generation_group_id: r for r in intake.latest_totals(spark, table).collect()}
    assert sum(r.n for r in rows_.values()) == total and rows_["g0"].n == 20
    assert rows_["g0"].reward_std == pytest.approx(np.std(np.arange(10) / 10))


def test_workload_timeout_and_errors(spark):
    """A query that runs too long is cut off and logged; the others go on."""
    texts = [
        ("slow", 0, "SELECT sum(a.id * b.id % 7) FROM range(10000000) a, range(10000000) b"),
        ("fine", 0, "SELECT id FROM range(5) ORDER BY id DESC"),
        ("long", 0, "SELECT id FROM range(50)"),
        ("lost", 0, "SELECT x FROM range(5)"),
        ("unsafe", 0, "DROP TABLE t"),
        ("nothing", 0, None),
    ]
    frame = spark.createDataFrame(texts, "example_id string, candidate_index int, sql string")
    runs, found = workload.run_workload(spark, frame, max_rows=10, timeout_ms=4000)
    log = {r.example_id: r for r in runs.collect()}
    assert log["slow"].timed_out and log["slow"].error_type == "timeout"
    assert log["fine"].success and log["fine"].columns == ["id"]
    assert (log["long"].row_count, log["long"].truncated) == (10, True)
    assert log["lost"].error_type.startswith("UNRESOLVED_COLUMN")
    assert (log["unsafe"].error_type, log["nothing"].error_type) == ("unsafe_sql", "format_error")
    values = found.filter("example_id = 'fine'").orderBy("row_idx").collect()
    assert [r.cells[0].str for r in values] == ["4", "3", "2", "1", "0"]
    assert found.filter("example_id = 'long'").count() == 10
    assert {r.outcome: r.n for r in workload.run_summary(runs).collect()}["success"] == 2


def test_short_query_beside_long_ones(spark):
    """Queries share the cores: a short one that starts last is not behind all tasks of the others."""
    long = "SELECT count(*) AS n FROM range(0, 1600000000, 1, 64) WHERE hash(id, {}) = 5"
    texts = [(f"long{i}", 0, long.format(i)) for i in range(7)]
    texts.append(("short", 0, "SELECT sum(id) AS n FROM range(0, 1000, 1, 2)"))
    frame = spark.createDataFrame(texts, "example_id string, candidate_index int, sql string").coalesce(1)
    runs, _ = workload.run_workload(spark, frame, timeout_ms=300_000)
    spent = {r.example_id: r.duration_ms for r in runs.collect()}
    assert spent.pop("short") < min(spent.values()) / 2
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_whole_results_keep_their_order(spark):
    """A sorted result of several tasks is numbered without gaps and judged as with a cap."""
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        spark.range(0, 20_000, 1, 7).createOrReplaceTempView("numbers")
        gold = [("up", 0, "SELECT id % 1000 AS x, id FROM numbers ORDER BY x, id")]
        mine = [
            ("up", 0, "SELECT id % 1000, id + 0 FROM numbers ORDER BY 1, 2 LIMIT 30000"),
            ("up", 1, "SELECT id % 1000 AS x, id FROM numbers ORDER BY x, id DESC"),
            ("up", 2, "SELECT id % 1000 AS x, id FROM numbers WHERE id < 19999 ORDER BY x, id"),
        ]
        schema = "example_id string, candidate_index int, sql string"
        kinds = []
        for cap in (None, 50_000):
            gold_runs, gold_rows = workload.run_workload(spark, spark.createDataFrame(gold, schema), cap)
            runs, rows = workload.run_workload(spark, spark.createDataFrame(mine, schema), cap)
            places = sorted(r.row_idx for r in gold_rows.select("row_idx").collect())
            assert places == list(range(20_000))
            known = gold_runs.drop("candidate_index")
            judged = equivalence.verdicts(runs, known, rows, gold_rows.drop("candidate_index"))
            kinds.append([r.kind for r in judged.orderBy("candidate_index").collect()])
        assert kinds == [["ordered_rows", "not_equivalent", "not_equivalent"]] * 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_workload_refuses_hazards(spark):
    """What would run code or read files is logged as unsafe and leaves no rows."""
    texts = [
        "SELECT java_method('java.lang.Math', 'abs', 1)",
        "SELECT reflect('java.lang.Math', 'abs', 1)",
        "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM range(2)",
        "SELECT * FROM text.`/etc/hostname`",
        "(SELECT 1 AS x) UNION (SELECT 2)",
    ]
    frame = spark.createDataFrame(
        [(f"h{i}", 0, t) for i, t in enumerate(texts)], "example_id string, candidate_index int, sql string"
    )
    runs, found = workload.run_workload(spark, frame)
    kinds = [r.error_type for r in runs.orderBy("example_id").collect()]
    assert kinds == ["unsafe_sql"] * 4 + ["none"]
    assert [r.example_id for r in found.collect()] == ["h4"] * 2


def test_gold_is_reused_while_its_key_stays(spark):
    store = scratch_path(spark, "gold")
    schema = "example_id string, candidate_index int, sql string"

    def run(*texts):
        frame = spark.createDataFrame([(f"e{i}", 0, sql) for i, sql in enumerate(texts)], schema)
        keyed = frame.withColumn("cache_key", F.concat_ws("/", "example_id", "sql"))
        runs, found, hits = workload.run_gold(spark, keyed, store)
        counts = {r.example_id: r["count"] for r in found.groupBy("example_id").count().collect()}
        return {r.example_id: (r.success, r.duration_ms) for r in runs.collect()}, counts, hits.count()

    first, counts, hits = run("SELECT id FROM range(5)", "SELECT none FROM nowhere", "SELECT id FROM range(0)")
    assert (counts, hits) == ({"e0": 5}, 0)
    again, counts, hits = run("SELECT id FROM range(5)", "SELECT none FROM nowhere", "SELECT id FROM range(0)")
    assert (counts, hits) == ({"e0": 5}, 2)
    assert again["e0"] == first["e0"] and again["e2"] == first["e2"] and not again["e1"][0]
    changed, counts, hits = run("SELECT id FROM range(7)")
    assert (counts, hits) == ({"e0": 7}, 0) and set(changed) == {"e0"}

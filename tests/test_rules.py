"""Validation, leakage, sampling, ranking and joins on hand-made rows."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import fingerprints, leakage, ranking, sampling, validate
from evalspark.operators.skew import salted_join
from evalspark.sources import catalog, jsonl, schemas, sinks

FIELDS = [f.split()[0] for f in schemas.EXAMPLE.split(", ")]


def examples(spark, *rows):
    base = dict(
        example_id="ex-1", db_id="tiny", question="How many users?", schema_text="CREATE TABLE users (id)",
        gold_sql="SELECT COUNT(*) FROM users", split="train", source="s", source_version="v", evidence="",
    )
    return spark.createDataFrame([tuple({**base, **r}[f] for f in FIELDS) for r in rows], schemas.EXAMPLE)


def rules(frame):
    return {r.rule for r in frame.collect()}


def test_overlap_rules(spark):
    same_id = examples(
        spark, {"example_id": "x"}, {"example_id": "x", "split": "test", "question": "other?"}
    )
    assert rules(leakage.audit_examples(same_id)) == {"id_overlap"}
    near = examples(
        spark,
        {"example_id": "a", "question": "How many users exist?"},
        {"example_id": "b", "question": "  how   many USERS exist?? ", "split": "test"},
    )
    assert rules(leakage.audit_examples(near)) == {"question_overlap_normalized"}
    exact = examples(spark, {"example_id": "a"}, {"example_id": "b", "split": "test"})
    assert rules(leakage.audit_examples(exact)) == {"question_overlap_exact", "question_overlap_normalized"}
    within = examples(spark, {"example_id": "a"}, {"example_id": "b"})
    assert rules(leakage.audit_examples(within)) == set()


def test_assert_clean(spark):
    fine = examples(spark, {"example_id": "a"}, {"example_id": "b", "split": "test", "question": "Second"})
    leakage.assert_clean(fine)
    with pytest.raises(leakage.LeakageError, match="id_overlap:x"):
        leakage.assert_clean(
            examples(spark, {"example_id": "x"}, {"example_id": "x", "split": "test", "question": "q2"})
        )
    with pytest.raises(Exception, match="unknown split"):
        leakage.id_overlap(examples(spark, {"split": "nowhere"})).collect()


def test_prompt_rules(spark):
    one = examples(spark, {"gold_sql": "SELECT name FROM users"})

    def audit(prompt, *values):
        prompts = one.withColumn("prompt", F.lit(prompt))
        cells = spark.createDataFrame([("ex-1", v) for v in values] or [("-", "-")], "example_id string, value string")
        return rules(leakage.audit_examples(one, prompts=prompts, result_strings=cells))

    both = {"prompt_leakage_gold_sql", "prompt_leakage_gold_sql_raw"}
    assert audit("Hint: SELECT name FROM users\n") == both
    assert audit("hint: select  NAME\nfrom users") == {"prompt_leakage_gold_sql"}
    assert audit("CREATE TABLE users (...)") == set()
    assert audit("the answer is Xylophone-42", "Xylophone-42") == {"prompt_leakage_gold_result"}
    assert audit("the answer is short", "short") == set()


def test_candidates_from_test(spark):
    rows = examples(spark, {"example_id": "a"}, {"example_id": "t", "split": "test", "question": "q2"})
    asked = spark.createDataFrame([("t",), ("t",), ("a",)], "example_id string")
    assert [r.example_id for r in leakage.candidates_from_test(rows, asked).collect()] == ["t"]


def test_split_policy(spark):
    rows = examples(
        spark, {"example_id": "a"}, {"example_id": "d", "split": "dev"}, {"example_id": "c", "split": "calibration"}
    )
    kept, report = validate.apply_split_policy(rows, ["train"])
    assert [r.example_id for r in kept.collect()] == ["a"]
    assert {r.split: r.n for r in report.filter("decision = 'excluded'").collect()} == {"dev": 1, "calibration": 1}
    for split in ("validation_tuning", "holdout"):
        with pytest.raises(validate.SplitError):
            validate.apply_split_policy(examples(spark, {"split": split}), ["train"])
    with pytest.raises(validate.SplitError):
        validate.assert_training_splits(["train", "dev"])
    with pytest.raises(validate.SplitError):
        validate.assert_calibration_splits(["dev"])
    with pytest.raises(validate.SplitError):
        validate.select_split(rows, "train")
    with pytest.raises(validate.SplitError):
        validate.assert_formal_training_source(rows, rows.filter("split = 'train'"))
    validate.assert_formal_training_source(rows.filter("split = 'train'"), rows.filter("split = 'dev'"))


def test_read_examples(spark, tmp_path):
    good = examples(spark, {"example_id": "a"}, {"example_id": "b", "split": "dev"})
    good.write.json(str(tmp_path / "good"))
    assert jsonl.read_examples(spark, str(tmp_path / "good")).count() == 2
    with pytest.raises(validate.DataError, match="split mismatch.*b"):
        jsonl.read_examples(spark, str(tmp_path / "good"), declared_split="train")
    for name, row in {"id": {"example_id": "-a"}, "db": {"db_id": "../x"}, "q": {"question": ""}, "s": {"split": "x"}}.items():
        examples(spark, row).write.json(str(tmp_path / name))
        with pytest.raises(validate.DataError, match="bad example"):
            jsonl.read_examples(spark, str(tmp_path / name))
    examples(spark, {}, {"question": "other"}).write.json(str(tmp_path / "twice"))
    with pytest.raises(validate.DataError, match="duplicate id.*ex-1"):
        jsonl.read_examples(spark, str(tmp_path / "twice"))
    (tmp_path / "bad.jsonl").write_text('{"example_id": "a"}\n\nnot json\n')
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.EXAMPLE).collect()
    kept = jsonl.read_jsonl_with_bad(spark, str(tmp_path / "bad.jsonl"), schemas.EXAMPLE)
    assert [(r._corrupt, r.source_file) for r in kept.collect()] == [(None, "bad.jsonl"), ("not json", "bad.jsonl")]


def test_json_document_and_splits(spark, tmp_path):
    path = tmp_path / "eval.json"
    path.write_text(json.dumps([{"db_id": "a", "question": "q\n1", "SQL": "SELECT 1", "question_id": 7, "difficulty": "simple"}, {"db_id": "b", "question": "q2"}], indent=1))
    rows = jsonl.read_json_document(spark, str(path), schemas.RAW_SOURCE).orderBy("db_id").collect()
    assert [(r.db_id, r.question, r.question_id) for r in rows] == [("a", "q\n1", "7"), ("b", "q2", None)]
    sinks.write_by_split(examples(spark, {"example_id": "a"}, {"example_id": "b", "split": "dev"}), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("split=*")) == ["split=dev", "split=train"]


def test_registry(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text(json.dumps({"databases": {"a": "dbs/a.sqlite", "b": "../b.sqlite", "c/d": "x", "e": "/etc/e", "f": "x/../f", "g": "x/../../g"}}, indent=2))
    valid = {r.db_id: r.valid for r in catalog.read_registry(spark, str(path)).collect()}
    assert valid == {"a": True, "b": False, "c/d": False, "e": False, "f": True, "g": False}


def _round_robin(rows, size, seed):
    """The loop the sample stands for: strata take turns until enough are chosen."""
    queues = defaultdict(list)
    for stratum, key in rows:
        queues[stratum].append((hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), key))
    for queue in queues.values():
        queue.sort()
    chosen = []
    while len(chosen) < size and any(queues.values()):
        for stratum in sorted(queues):
            if len(chosen) < size and queues[stratum]:
                chosen.append((queues[stratum].pop(0)[1], stratum))
    return chosen


@pytest.mark.parametrize("block", [3, sampling.TURN_BLOCK])
@pytest.mark.parametrize("size", [1, 3, 7, 20, 41, 60, 99, 200])
def test_round_robin_against_the_loop(spark, monkeypatch, size, block):
    sizes = {"a": 33, "b": 1, "c": 7, "d": 7, "e": 51}
    rows = [(s, f"{s}{i}") for s, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "db_id string, example_id string")
    sample = sampling.round_robin_sample(frame, "db_id", "example_id", size, 5)
    monkeypatch.setattr(sampling, "TURN_BLOCK", block)
    got = sampling.with_selection_order(sample, "db_id").orderBy("selection_order").collect()
    assert [(r.example_id, r.db_id) for r in got] == _round_robin(rows, size, 5)
    assert [r.selection_order for r in got] == list(range(1, min(size, len(rows)) + 1))


def test_validation_split_needs_enough_rows(spark):
    with pytest.raises(validate.DataError):
        sampling.train_validation_split(examples(spark, {}), 1, 0)


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_percentiles_against_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(np.concatenate([rng.normal(0, 50, n), np.full(n // 3, 7.25), [0.0]]), 2)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    fractions = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.99, "f": 1.0}
    linear = {r.name: r.value for r in ranking.percentiles_linear(frame, [], "v", fractions).collect()}
    for name, p in fractions.items():
        assert linear[name] == pytest.approx(np.quantile(values, p))
    nearest = {r.name: r.value for r in ranking.percentiles_nearest(frame, [], "v", fractions).collect()}
    ordered = sorted(values)
    for name, p in fractions.items():
        assert nearest[name] == ordered[int(round(p * (len(ordered) - 1)))]


def test_hot_keys_give_the_same_join(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), "id"
    )
    keyed = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    sized = keyed.join(rows.groupBy("k").agg(F.count("*").alias("n")), "k", "left")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(keyed, "k", how).select("k", "id", "v").collect()))
        for frame, size in ((keyed, None), (sized, "n")):
            got = salted_join(rows, frame, ["k"], ["id"], how, size=size, hot_rows=100, salts=5)
            assert sorted(map(tuple, got.select("k", "id", "v").collect())) == want


def test_set_hashes(spark):
    ids = [f"id-{i}" for i in range(500)]
    frame = spark.createDataFrame([(i,) for i in ids + ids[:9]], "example_id string")
    turned = spark.createDataFrame([(i,) for i in reversed(ids)], "example_id string")
    other = spark.createDataFrame([(i,) for i in ids[:-1] + ["x"]], "example_id string")
    want = hashlib.sha256("\n".join(sorted(ids)).encode()).hexdigest()
    assert fingerprints.listed_set_hash(frame, "example_id").first().ids_hash == want
    nothing = fingerprints.listed_set_hash(frame.limit(0), "example_id").first()
    assert (nothing.n, nothing.ids_hash) == (0, hashlib.sha256(b"").hexdigest())
    for hashed in (fingerprints.set_fingerprint, fingerprints.set_tree_hash):
        a, b, c = (tuple(hashed(f, "example_id").first()) for f in (frame, turned, other))
        assert a == b != c


def test_audit(spark):
    rows = examples(spark, {"example_id": "a"}, {"example_id": "b", "db_id": "gone"})
    registry = spark.createDataFrame([("tiny",)], "db_id string")
    runs = spark.createDataFrame([(True,), (True,)], "success boolean")
    report = validate.audit(rows, registry, leakage.audit_examples(rows), runs).first()
    assert (report.examples, report.missing_db, report.leaks, report.ok) == (2, 1, 0, False)
    fine = rows.filter("db_id = 'tiny'")
    assert validate.audit(fine, registry, leakage.audit_examples(fine), runs).first().ok

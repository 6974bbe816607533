"""Line numbers of bad records, reading examples in one scan, many result strings in one prompt."""

from __future__ import annotations

import collections
import json
import random
import re

import pyarrow as pa
import pytest

from evalspark.operators import leakage, validate
from evalspark.plans import registry, source_queries
from evalspark.sources import jsonl

SCHEMA = "ord bigint, text string"


@pytest.fixture
def small_parts(spark):
    """Files are read in parts of a few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "700")
    spark.conf.set(names[1], "0")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_bad_lines_of_files_in_many_parts(spark, tmp_path, small_parts):
    rng = random.Random(4)
    want = []
    for name in ("a", "b", "long name"):
        lines = []
        for i in range(1, 400):
            line = rng.choice(
                [json.dumps({"ord": i, "text": "x" * rng.randrange(60)}), "", " \t", "{broken", f"bad {i} é", "[1, 2]", "7", '"text"']
            )
            lines.append(line)
            if line.strip() and not (line.startswith('{"ord"')):
                want.append((f"{name}.jsonl", i, line))
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + rng.choice(["", "\n"]))
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 10 and lines.groupBy("source_file").agg({"_part": "max"}).first()[1] > 0
    found = jsonl.bad_lines(spark, str(tmp_path), SCHEMA).collect()
    name = [r.source_file.rsplit("/", 1)[1].replace("%20", " ") for r in found]
    assert sorted((n, r.line, r.text) for n, r in zip(name, found)) == sorted(want)


def test_no_bad_lines_and_no_lines(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"ord": 1}\n\n{"text": "x"}\n')
    assert jsonl.bad_lines(spark, str(tmp_path), SCHEMA).count() == 0
    (tmp_path / "empty.jsonl").write_text("")
    assert jsonl.bad_lines(spark, str(tmp_path / "empty.jsonl"), SCHEMA).count() == 0
    (tmp_path / "windows.jsonl").write_text('{"ord": 1}\r\n\r\nno\r\n')
    assert [(r.line, r.text) for r in jsonl.bad_lines(spark, str(tmp_path / "windows.jsonl"), SCHEMA).collect()] == [(3, "no")]


def _example(i, **changes):
    row = {"example_id": f"ex-{i}", "db_id": "db", "question": "q", "schema_text": "s", "gold_sql": "SELECT 1"}
    return json.dumps(row | {"split": "train", "source": "x", "source_version": "1"} | changes)


def test_examples_are_refused_by_file_and_line(spark, tmp_path, small_parts):
    good = [_example(i) for i in range(30)]
    path = tmp_path / "examples.jsonl"

    def read(lines, **options):
        path.write_text("\n".join(lines))
        return jsonl.read_examples(spark, str(path), **options)

    assert read(good).count() == 30 and "errors" not in read(good).columns and jsonl.CORRUPT not in read(good).columns
    assert read(good).filter("evidence = ''").count() == 30
    for lines, message in (
        ([*good[:20], "", "{oops", *good[20:]], r"examples.jsonl:22 \{oops"),
        ([*good, _example(77, split="x", question="")], r"examples.jsonl:31 ex-77 question,split|examples.jsonl:31 ex-77 split"),
        ([*good, "", good[3]], r"examples.jsonl:4 ex-3; .*examples.jsonl:32 ex-3"),
        ([_example(1), _example(2, split="dev")], r"split mismatch.*examples.jsonl:2 ex-2 dev"),
    ):
        with pytest.raises(validate.DataError, match=message):
            read(lines, declared_split="train")


def test_partition_columns_count_as_fields(spark, tmp_path):
    for split in ("train", "dev"):
        (tmp_path / "in" / f"split={split}").mkdir(parents=True)
        row = json.loads(_example(split))
        (tmp_path / "in" / f"split={split}" / "1.json").write_text(json.dumps({k: v for k, v in row.items() if k != "split"}))
    found = jsonl.read_examples(spark, str(tmp_path / "in")).collect()
    assert sorted((r.example_id, r.split) for r in found) == [("ex-dev", "dev"), ("ex-train", "train")]


def test_the_source_is_read_once(spark, tmp_path):
    path = tmp_path / "examples.jsonl"
    path.write_text("\n".join(_example(i) for i in range(5)))
    found = jsonl.read_examples(spark, str(path), declared_split="train")
    assert not any("examples.jsonl" in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and not re.search(r"FileScan (text|json)", plan)


def test_result_strings_against_plain_search(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(leakage, "VALUES_AT_ONCE", 7)
    prompts, cells = [], []
    for i in range(40):
        text = "".join(rng.choices("abcé ", k=rng.choice([0, 20, 400])))
        prompts.append((f"e{i}", text))
        for _ in range(rng.choice([0, 3, 200])):
            at, size = rng.randrange(len(text) + 1), rng.choice([5, 6, 7, 30])
            cells.append((f"e{i}", rng.choice([text[at : at + size], "".join(rng.choices("abcé ", k=size))])))
    prompts += [("none", None), ("alone", "abcabc")]
    cells += [("none", "abcabc"), ("missing", "abcabc"), ("alone", None), ("alone", "abcabc"), ("alone", "abcabc"), ("alone", "bcabca")]
    counted = collections.Counter((e, v) for e, v in cells if v and len(v) >= 6)
    texts = dict(prompts)
    want = sorted((e, v, n) for (e, v), n in counted.items() if v in (texts.get(e) or ""))
    p = spark.createDataFrame(prompts, "example_id string, prompt string")
    c = spark.createDataFrame(cells, "example_id string, value string")
    found = leakage.result_leakage(p, c)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    # Prompts are moved once: one row per example and portion of its values meets them.
    assert leakage.result_leakage(p.limit(0), c).count() == leakage.result_leakage(p, c.limit(0)).count() == 0


def test_more_rows_are_more_files(spark, tmp_path, monkeypatch):
    folder = tmp_path / "documents.parquet"
    spark.range(60).selectExpr("id AS doc_id", "'word ' || id AS text").repartition(6).write.parquet(str(folder))
    monkeypatch.setattr(source_queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(2**30))
    try:
        found = registry.QUERIES["bad_line_numbers"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted(map(tuple, found)) == [(i, True) for i in range(1, 60, 3)]
    assert len(list((tmp_path / "numbered").glob("part-*"))) == 6


def test_one_rows_texts_at_a_time():
    batch = pa.RecordBatch.from_pydict({
        "example_id": ["a", "b", "c"],
        "prompt": ["xx abcabc", "nothing", "bcabca"],
        "values": [[{"value": "abcabc", "occurrences": 2}, {"value": "zzzzzz", "occurrences": 1}], [{"value": "abcabc", "occurrences": 1}], [{"value": "bcabca", "occurrences": 3}]],
    })
    found = [b.to_pylist() for b in leakage._standing_in(iter([batch, batch.slice(2)]))]
    c = [{"example_id": "c", "value": "bcabca", "occurrences": 3}]
    assert found == [[{"example_id": "a", "value": "abcabc", "occurrences": 2}], c, c]

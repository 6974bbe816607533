"""Examples written per split."""

from __future__ import annotations

import glob
import json
import time

import pyarrow as pa

from evalspark.plans import registry
from evalspark.sources import jsonl, sinks

CONF = "spark.sql.maxConcurrentOutputFileWriters"


def test_rows_are_written_as_they_come(spark, tmp_path):
    """Nothing gathers a task's rows before the first of them is written."""
    path = str(tmp_path / "out")

    def rows(batches):
        for _ in batches:
            for i in range(4):
                yield pa.RecordBatch.from_pydict({"split": ["a", "b"] * 50, "text": [str(i) * 5000] * 100})
            seen, until = False, time.time() + 10
            while not seen and time.time() < until:
                seen = bool(glob.glob(f"{path}/_temporary/**/split=a/part-*", recursive=True))
                time.sleep(0.05)
            yield pa.RecordBatch.from_pydict({"split": ["a"], "text": [f"seen {seen}"]})

    examples = spark.range(0, 1, 1, 1).mapInArrow(rows, "split string, text string")
    sinks.write_by_split(examples, path)
    found = spark.read.json(path)
    assert [r.text for r in found.filter("text like 'seen%'").collect()] == ["seen True"]
    assert sorted(map(tuple, found.groupBy("split").count().collect())) == [("a", 201), ("b", 200)]


def test_more_splits_than_open_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "WRITERS", 2)
    rows = spark.range(0, 60, 1, 2).selectExpr("id", "'s' || id % 7 AS split")
    for before in (None, "5"):
        if before is not None:
            spark.conf.set(CONF, before)
        path = str(tmp_path / f"out-{before}")
        try:
            sinks.write_by_split(rows, path)
            assert spark.conf.get(CONF, None) == before
        finally:
            spark.conf.unset(CONF)
        found = spark.read.json(path).collect()
        assert sorted((r.id, r.split) for r in found) == [(i, f"s{i % 7}") for i in range(60)]


def test_a_very_long_text_is_a_record(spark, tmp_path):
    text = "word " * 4_200_000
    line = json.dumps({"ord": 1, "text": text})
    (tmp_path / "long.jsonl").write_text(f'{line}\n{line[:-1]}\n')
    assert jsonl.bad_lines(spark, str(tmp_path), "ord bigint, text string").select("line").collect() == [(2,)]
    folder = tmp_path / "documents.parquet"
    spark.range(1).selectExpr("id AS doc_id", f"repeat('word ', {len(text) // 5}) AS text", "'en' AS lang", "'src1' AS source").write.parquet(str(folder))
    found = registry.QUERIES["split_files"](spark, str(tmp_path)).collect()
    assert [(r.split, r.n, r.chars) for r in found] == [("train", 1, len(text))]

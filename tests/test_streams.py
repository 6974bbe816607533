"""Streams over several deliveries: state instead of history, reruns, late copies, snapshots."""

from __future__ import annotations

import json
import os
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.streaming import changelog, intake


def _deliver(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def _candidate(example, index, raw, day):
    return {"example_id": example, "candidate_index": index, "raw_candidate_output": raw, "created_at": f"2024-01-{day:02}T00:00:00"}


def _take_in(spark, tmp_path, **options):
    stream = intake.stream_candidates(spark, str(tmp_path / "in"), files_per_trigger=1)
    return intake.intake_candidates(stream, str(tmp_path / "table"), str(tmp_path / "check"), **options)


def _taken(spark, tmp_path):
    rows = spark.read.parquet(str(tmp_path / "table")).collect()
    return sorted((r.example_id, r.candidate_index, r.raw_candidate_output) for r in rows)


def test_each_key_once_and_the_earliest_of_its_batch(spark, tmp_path):
    _deliver(tmp_path / "in", "1", [_candidate("a", 0, "late", 3), _candidate("a", 0, "early", 1), _candidate("b", 0, "b", 1), _candidate("a", 1, "other", 1)])
    _take_in(spark, tmp_path)
    _deliver(tmp_path / "in", "2", [_candidate("a", 0, "again", 1), _candidate("c", 0, "c", 2)])
    query = _take_in(spark, tmp_path)
    want = [("a", 0, "early"), ("a", 1, "other"), ("b", 0, "b"), ("c", 0, "c")]
    assert _taken(spark, tmp_path) == want
    # The batch reads its own files; what was taken in before is state, on disk.
    plan = query._jsq.explainInternal(False)
    assert "FlatMapGroupsInPandasWithState" in plan and "parquet" not in plan.lower().replace("parquetsink", "")
    progress = query.lastProgress["stateOperators"][0]
    assert progress["numRowsTotal"] == 4 and any("rocksdb" in k for k in progress["customMetrics"])
    # Nothing has arrived, and a rerun of all files after the last batch's commit is lost adds nothing.
    _take_in(spark, tmp_path)
    assert _taken(spark, tmp_path) == want
    last = max(int(c.name) for c in (tmp_path / "check" / "commits").iterdir() if c.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(tmp_path / "check" / "commits" / name)
    _take_in(spark, tmp_path)
    assert _taken(spark, tmp_path) == want


def test_late_copies_are_dropped(spark, tmp_path):
    _deliver(tmp_path / "in", "1", [_candidate("a", 0, "first", 1)])
    _take_in(spark, tmp_path, forget_after="5 days")
    _deliver(tmp_path / "in", "2", [_candidate("b", 0, "in time", 4), _candidate("a", 0, "copy", 2)])
    _take_in(spark, tmp_path, forget_after="5 days")
    _deliver(tmp_path / "in", "3", [_candidate("c", 0, "new", 28)])
    query = _take_in(spark, tmp_path, forget_after="5 days")
    # The first keys are forgotten now, and their copies are late.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1
    _deliver(tmp_path / "in", "4", [_candidate("a", 0, "too late", 3), _candidate("c", 0, "copy", 27)])
    _take_in(spark, tmp_path, forget_after="5 days")
    assert _taken(spark, tmp_path) == [("a", 0, "first"), ("b", 0, "in time"), ("c", 0, "new")]


def _folders(table, kind):
    folder = table / kind
    return sorted(int(p.name.partition("=")[2]) for p in folder.iterdir()) if folder.exists() else []


def test_snapshots_keep_the_change_log_short(spark, tmp_path):
    table, seen = tmp_path / "table", {}
    for number in range(40):
        rows = [(number % 7, number), (number % 3 + 10, -number)]
        seen.update(rows)
        batch = spark.createDataFrame(rows, "k int, v int").coalesce(1)
        changelog.write_change(batch, number, str(table), ["k"], every=5)
        assert len(_folders(table, "changes")) <= 10 and len(_folders(table, "snapshots")) <= 2
    found = changelog.latest(spark, str(table), ["k"])
    assert {r.k: r.v for r in found.collect()} == seen
    # One snapshot and nothing before it is read.
    read = {f.rsplit("/", 2)[-2] for f in found.inputFiles()}
    assert read == {"upto=39"}
    changelog.write_change(spark.createDataFrame([(0, 99)], "k int, v int"), 40, str(table), ["k"], every=5)
    found = changelog.latest(spark, str(table), ["k"])
    assert {f.rsplit("/", 2)[-2] for f in found.inputFiles()} == {"upto=39", "batch=40"}
    assert {r.k: r.v for r in found.collect()} == seen | {0: 99}


def test_unfinished_snapshots_do_not_count(spark, tmp_path):
    table = str(tmp_path / "table")
    for number in range(3):
        changelog.write_change(spark.createDataFrame([(1, number)], "k int, v int"), number, table, ["k"], every=3)
    assert changelog.latest(spark, table, ["k"]).first().v == 2
    # A snapshot that broke off before its marker was written, and one that is made again.
    shutil.copytree(tmp_path / "table/snapshots/upto=2", tmp_path / "table/snapshots/upto=9")
    os.remove(tmp_path / "table/snapshots/upto=9/_SUCCESS")
    assert changelog.latest(spark, table, ["k"]).first().v == 2
    changelog.compact(spark, table, ["k"], 2)
    # A batch that is run again once its rows are in a snapshot changes nothing.
    changelog.write_change(spark.createDataFrame([(1, 77)], "k int, v int"), 2, table, ["k"], every=3)
    assert changelog.latest(spark, table, ["k"]).first().v == 2
    with pytest.raises(ValueError, match="no batch"):
        changelog.latest(spark, str(tmp_path / "none"), ["k"])


def test_totals_over_many_batches(spark, tmp_path):
    for i in range(9):
        _deliver(tmp_path / "in", f"{i}", [{"generation_group_id": f"g{i % 2}", "reward": float(i)}, {"generation_group_id": "all", "reward": 1.0}])
    stream = intake.stream_samples(spark, str(tmp_path / "in"), files_per_trigger=1)
    intake.stream_group_totals(stream, str(tmp_path / "table"), str(tmp_path / "check"), snapshot_every=4)
    assert _folders(tmp_path / "table", "snapshots") == [3, 7]
    assert _folders(tmp_path / "table", "changes") == [4, 5, 6, 7, 8]
    got = intake.latest_totals(spark, str(tmp_path / "table"))
    want = intake.group_totals(spark.read.json(str(tmp_path / "in")))
    columns = ["generation_group_id", "n", F.round("reward_sum", 6), F.round("reward_std", 6)]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_a_single_record_is_taken_as_it_is():
    rows = pd.DataFrame({"created_at": ["2", "1", "1"], "raw_candidate_output": ["a", "c", "b"]})
    assert intake.earliest(rows).raw_candidate_output.tolist() == ["b"]
    single = rows.head(1)
    assert intake.earliest(single) is single

"""A table kept as a snapshot and the changes after it.

Each batch adds a folder of changed rows under its number. Every so many batches the rows are put
together in a snapshot, whose folder says up to which batch it goes. A snapshot counts from the
moment its success marker is there, which is written last; readers take the newest one that counts
and the changes behind it. The snapshot before it and the changes since then stay until the next
one, for readers that have begun with them; what is older is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Batches between two snapshots.
SNAPSHOT_EVERY = 20


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers N of the folders ``name``=N that are written to the end, in order."""
    system, folder = _folder(spark, path)
    if not system.exists(folder):
        return []
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for entry in system.listStatus(folder):
        kind, _, number = entry.getPath().getName().partition("=")
        if kind == name and system.exists(path_of(entry.getPath(), "_SUCCESS")):
            found.append(int(number))
    return sorted(found)


def _delete(spark: SparkSession, path: str) -> None:
    system, folder = _folder(spark, path)
    system.delete(folder, True)


def _change(table: str, number: int) -> str:
    return f"{table}/changes/batch={number}"


def _snapshot(table: str, number: int) -> str:
    return f"{table}/snapshots/upto={number}"


def write_change(batch: DataFrame, number: int, table: str, keys: list[str], every: int = SNAPSHOT_EVERY) -> None:
    """Add a batch's rows. A batch that is run again after a failure replaces what it had written."""
    spark = batch.sparkSession
    done = _numbers(spark, f"{table}/snapshots", "upto")
    if done and number <= done[-1]:
        return
    batch.write.mode("overwrite").parquet(_change(table, number))
    if (number + 1) % every == 0:
        compact(spark, table, keys, number)


def compact(spark: SparkSession, table: str, keys: list[str], upto: int) -> None:
    """Put the rows up to a batch together, then delete what no reader can have begun with."""
    before = _numbers(spark, f"{table}/snapshots", "upto")
    if upto not in before:
        latest(spark, table, keys, upto).write.mode("overwrite").parquet(_snapshot(table, upto))
    kept = max((n for n in before if n < upto), default=-1)
    for n in before:
        if n < kept:
            _delete(spark, _snapshot(table, n))
    for n in _numbers(spark, f"{table}/changes", "batch"):
        if n <= kept:
            _delete(spark, _change(table, n))


def latest(spark: SparkSession, table: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """The newest row of each key: one snapshot is read, and the changes after it."""
    snapshots = _numbers(spark, f"{table}/snapshots", "upto")
    changes = _numbers(spark, f"{table}/changes", "batch")
    if upto is not None:
        snapshots, changes = ([n for n in found if n <= upto] for found in (snapshots, changes))
    start = snapshots[-1] if snapshots else -1
    folders = [(_change(table, n), n) for n in changes if n > start]
    if snapshots:
        folders.append((_snapshot(table, start), start))
    if not folders:
        raise ValueError(f"{table} holds no batch yet")
    schema = spark.read.parquet(folders[0][0]).schema
    rows = spark.read.schema(schema).parquet(*[path for path, _ in folders])
    # A folder's name tells how new its rows are.
    newness = F.regexp_extract(F.col("_metadata.file_path"), r"(?:batch|upto)=(\d+)/[^/]*$", 1).cast("bigint")
    row = F.struct(*schema.names)
    return (
        rows.select(*keys, row.alias("_row"), newness.alias("_new"))
        .groupBy(*keys)
        .agg(F.max_by("_row", "_new").alias("_row"))
        .select("_row.*")
    )

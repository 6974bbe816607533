"""Taking in candidate and reward logs as their files arrive."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalspark.sources import schemas
from evalspark.streaming import changelog

KEYS = ["example_id", "candidate_index"]
_TIME = "_arrived"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_jsonl(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


@contextmanager
def disk_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, on disk rather than on the heap."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def earliest(rows: pd.DataFrame) -> pd.DataFrame:
    """The earliest record of a key; most keys have one in a batch, and nothing is sorted for it."""
    return rows if len(rows) == 1 else rows.sort_values(["created_at", "raw_candidate_output"]).head(1)


def first_of_keys(stream: DataFrame, forget_after: str | None = None) -> DataFrame:
    """One record per key, from the batch in which the key is first seen; there the earliest.

    What is known of a key is one flag in keyed state, so a batch reads no history. With
    ``forget_after``, such as "30 days", a key is forgotten once the newest ``created_at`` is so
    much later than the key's record; copies that come after that are older than the watermark
    and are dropped as late. Without it no key is forgotten and no record is late.
    """
    names = stream.columns
    if forget_after is None:
        timed, timeout = stream, GroupStateTimeout.NoTimeout
    else:
        # A record without a readable time counts as just arrived.
        when = F.coalesce(F.try_to_timestamp("created_at"), F.current_timestamp())
        timed = stream.withColumn(_TIME, when).withWatermark(_TIME, forget_after)
        timeout = GroupStateTimeout.EventTimeTimeout

    def first(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, newest, best = state.exists, None, None
        for rows in batches:
            if forget_after is not None:
                last = rows[_TIME].max()
                newest = last if newest is None else max(newest, last)
            if not known:
                best = earliest(rows if best is None else pd.concat([best, rows]))
        if forget_after is not None:
            # One millisecond past the newest record; the watermark adds the delay.
            state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if not known:
            state.update((True,))
            yield best[names]

    return timed.groupBy(*KEYS).applyInPandasWithState(first, stream.schema, "seen boolean", "append", timeout)


def intake_candidates(stream: DataFrame, table_path: str, checkpoint: str, forget_after: str | None = None):
    """Append each (example, index) once. Returns the finished query.

    Which files a batch has added is written with the batch, so one that is run again after a
    failure adds nothing it has added before; see ``first_of_keys`` for late copies.
    """
    with disk_state(stream.sparkSession):
        query = (
            first_of_keys(stream, forget_after)
            .writeStream.format("parquet")
            .outputMode("append")
            .option("path", table_path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return query


def group_totals(samples: DataFrame) -> DataFrame:
    """Running reward totals per generation group, on a stream or a table."""
    return samples.groupBy("generation_group_id").agg(
        F.count("*").alias("n"),
        F.sum("reward").alias("reward_sum"),
        F.stddev_pop("reward").alias("reward_std"),
    )


def stream_group_totals(
    stream: DataFrame, table_path: str, checkpoint: str, snapshot_every: int = changelog.SNAPSHOT_EVERY
):
    """Keep the totals current: each batch writes the groups it changed, now and then a snapshot."""

    def write(batch: DataFrame, number: int) -> None:
        changelog.write_change(batch, number, table_path, ["generation_group_id"], snapshot_every)

    with disk_state(stream.sparkSession):
        query = (
            group_totals(stream)
            .writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return query


def latest_totals(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest row of each group."""
    return changelog.latest(spark, table_path, ["generation_group_id"])


def stream_candidates(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return stream_jsonl(spark, path, schemas.CANDIDATE, files_per_trigger)


def stream_samples(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return stream_jsonl(spark, path, schemas.REWARD_SAMPLE, files_per_trigger)

"""Hashes of whole sets, and the map from old ids to stable ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.identity import fingerprint_number, sha256

_PRIME = 1_000_000_007
LEAF_DIGITS = 4  # 16**4 leaves, so that a leaf of 10**11 ids still fits a task


def set_fingerprint(df: DataFrame, key: str, group: list[str] | None = None) -> DataFrame:
    """Count, XOR and sum of the distinct keys' hashes: equal sets agree, in any order.

    Combined on the map side, so it works for sets of any size.
    """
    group = group or []
    number = fingerprint_number(F.col(key))
    return (
        df.select(*group, key)
        .distinct()
        .groupBy(*group)
        .agg(
            F.count("*").alias("n"),
            F.bit_xor(number).alias("xor_part"),
            F.sum(number % _PRIME).alias("sum_part"),
        )
    )


def set_tree_hash(df: DataFrame, key: str, group: list[str] | None = None) -> DataFrame:
    """Collision-safe hash of a set: sorted keys are hashed per bucket, then the buckets.

    Buckets are cut by hash, so none holds more than its even share of the distinct keys.
    """
    group = group or []
    bucket = F.substring(F.md5(key), 1, LEAF_DIGITS)
    leaves = (
        df.select(*group, key)
        .distinct()
        .groupBy(*group, bucket.alias("bucket"))
        .agg(sha256(F.array_join(F.array_sort(F.collect_list(key)), "\n")).alias("leaf"))
    )
    listed = F.array_sort(F.collect_list(F.struct("bucket", "leaf")))
    return leaves.groupBy(*group).agg(
        sha256(F.array_join(F.transform(listed, lambda x: x["leaf"]), "\n")).alias("ids_hash")
    )


def listed_set_hash(df: DataFrame, key: str) -> DataFrame:
    """The published manifests' form: one hash over all sorted ids.

    The form is one running hash, so one task reads the sorted ids as a stream and holds a
    batch at a time; the ids are made distinct before, in parallel. ``set_tree_hash`` is the
    form for sets whose hash should be spread out too. Null ids count but are not hashed.
    """
    ids = df.select(F.col(key).cast("string").alias("id")).distinct().repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, n, hashed = hashlib.sha256(), 0, False
        for batch in batches:
            n += batch.num_rows
            listed = [i for i in batch.column(0).to_pylist() if i is not None]
            if listed:
                running.update(("\n" * hashed + "\n".join(listed)).encode())
                hashed = True
        yield pa.RecordBatch.from_pydict({"ids_hash": [running.hexdigest()], "n": [n]})

    hashed = ids.sortWithinPartitions("id").mapInArrow(run, "ids_hash string, n bigint")
    return hashed.agg(
        F.coalesce(F.max("ids_hash"), F.sha2(F.lit(""), 256)).alias("ids_hash"),
        F.coalesce(F.max("n"), F.lit(0)).alias("n"),
    )


def schema_set_hash(entries: DataFrame) -> DataFrame:
    """One hash over the databases of a registry (``db_id, sha256, schema_hash``).

    A registry has one small row per database, which is what is listed here.
    """
    rows = F.array_sort(F.collect_list(F.struct("db_id", "schema_hash", "sha256")))
    return entries.agg(
        sha256(F.to_json(rows, {"ignoreNullFields": "false"})).alias("schema_set_hash"),
        F.count("*").alias("databases"),
    )


def id_migration(
    rows: DataFrame,
    engineering: DataFrame,
    formal: DataFrame,
    train: DataFrame,
    order: str,
    prefix: str,
) -> DataFrame:
    """Per source row its old id, taken from the first selection that has it, and its role.

    ``rows`` have ``signature``; the selections ``signature`` and the old ``example_id``.
    The three selections are one table with a column each, so rows are joined once.
    """
    tagged = (
        engineering.select("signature", "example_id", F.lit("eng").alias("of"))
        .unionAll(formal.select("signature", "example_id", F.lit("fv")))
        .unionAll(train.select("signature", "example_id", F.lit("train")))
    )
    old = tagged.groupBy("signature").agg(
        *[
            F.min(F.when(F.col("of") == name, F.col("example_id"))).alias(name)
            for name in ("eng", "fv", "train")
        ]
    )
    return rows.select(order, "signature").join(old, "signature", "left").select(
        order,
        "signature",
        F.concat(F.lit(prefix + "-"), "signature").alias("stable_id"),
        F.coalesce("eng", "fv", "train").alias("old_id"),
        F.when(F.col("eng").isNotNull(), "validation_tuning")
        .when(F.col("fv").isNotNull(), "formal_validation")
        .otherwise("train")
        .alias("role"),
    )

"""Databases, their tables and their schema text.

A catalog is a table with one row per table or view: ``db_id, type, name, ddl``. It is
metadata, so one database's rows are few; rows are made distinct before they are grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.sources.schemas import DB_ID_SHAPE


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    documents = spark.read.text(path, wholetext=True)
    return parse_registry(documents.withColumnRenamed("value", "document"))


def parse_registry(documents: DataFrame) -> DataFrame:
    """``db_id, path, valid`` from registry documents.

    Either a ``databases`` object or the object itself maps ids to paths. An entry is
    valid if the id is well formed and the path stays below the registry's folder.
    """
    wrapped = F.get_json_object("document", "$.databases")
    entries = F.from_json(F.coalesce(wrapped, F.col("document")), "map<string,string>")
    exploded = documents.select(F.explode(entries).alias("db_id", "path"))
    # Depth after each step must not fall below the registry's own folder.
    steps = F.filter(F.split("path", r"[/\\]+"), lambda s: ~s.isin("", "."))
    moves = F.transform(steps, lambda s: F.when(s == "..", -1).otherwise(1))
    lowest = F.aggregate(
        moves,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda acc, move: F.struct(
            (acc["depth"] + move).alias("depth"),
            F.least(acc["least"], acc["depth"] + move).alias("least"),
        ),
        lambda acc: acc["least"],
    )
    absolute = F.col("path").rlike(r"^([/\\]|[A-Za-z]:)")
    return exploded.withColumn(
        "valid", F.col("db_id").rlike(DB_ID_SHAPE) & ~absolute & (lowest >= 0)
    )


def schema_text(catalog: DataFrame) -> DataFrame:
    """Per database the DDL of its tables and views, in name order, one per line."""
    ddl = F.trim("ddl")
    return (
        catalog.filter(F.col("type").isin("table", "view") & (ddl != ""))
        .select("db_id", "name", ddl.alias("ddl"))
        .distinct()
        .groupBy("db_id")
        .agg(F.array_sort(F.collect_list(F.struct("name", "ddl"))).alias("parts"))
        .select("db_id", F.array_join("parts.ddl", "\n").alias("schema_text"))
    )


def table_names(catalog: DataFrame) -> DataFrame:
    return (
        catalog.filter(F.col("type") == "table")
        .groupBy("db_id")
        .agg(F.array_sort(F.collect_set("name")).alias("tables"))
    )


def catalog_of_views(spark: SparkSession, db_id: str) -> DataFrame:
    """A catalog of the session's temporary views, for workloads run by Spark itself."""
    rows = [
        (db_id, "table", t.name, f"CREATE TABLE {t.name} ({spark.table(t.name).schema.simpleString()})")
        for t in spark.catalog.listTables()
    ]
    return spark.createDataFrame(rows, "db_id string, type string, name string, ddl string")

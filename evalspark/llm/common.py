"""Helpers that the operators of this folder share."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# Words of the corpus rules: everything between the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, null texts as empty ones; other columns cannot clash."""
    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def schema_of(text: str) -> StructType:
    return _parse_datatype_string(text)


def map_columns(df: DataFrame, build: Callable[..., dict], schema: str) -> DataFrame:
    """Apply ``build`` to each Arrow batch: columns as lists in, a dict of lists out.

    ``build`` is called once per task with no arguments and returns the function of the
    batches, so models are loaded once per task.
    """
    spark_schema = schema_of(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = build()
        for batch in batches:
            got = work(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays(
                [pa.array(got[f.name], f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, spark_schema)


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file: a path as it is, or the name of an installed public one."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))

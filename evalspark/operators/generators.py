"""Candidate generation as a table function of SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from evalspark.operators.workflow import Generator

# What a generator may see, and nothing beside it.
INPUTS = ["example_id", "db_id", "split", "prompt"]
_OUTPUT = StructType(
    [
        StructField("example_id", StringType()),
        StructField("candidate_index", IntegerType()),
        StructField("raw_candidate_output", StringType()),
    ]
)
# Tables and their first columns, as the schema text of a prompt declares them.
_DECLARED = re.compile(r"(?i)create\s+table\s+(\w+)\s*\(\s*(\w+)")


def schema_generator(prompt: str, context: dict, count: int) -> list[str]:
    """A baseline that needs no model: plain queries over the tables the prompt declares.

    The tables whose names the rest of the prompt mentions come first, then the others as
    declared; each gives a count, then its rows by the first column.
    """
    declared = list(dict(_DECLARED.findall(prompt)).items())
    asked = set(re.findall(r"\w+", _DECLARED.sub(" ", prompt).lower()))
    ordered = sorted(declared, key=lambda t: t[0].lower() not in asked)
    queries = [f"SELECT COUNT(*) FROM {table}" for table, _ in ordered]
    queries += [f"SELECT {column} FROM {table} ORDER BY {column}" for table, column in ordered]
    return [f"<sql>\n{sql}\n</sql>" for sql in queries[:count]]


def register_generator(spark: SparkSession, name: str, generator: Generator) -> None:
    """Make a generator callable as ``SELECT * FROM name(TABLE(prompts), n)``.

    The table has the columns of ``INPUTS`` and no others, whatever their order; a query with
    more or fewer is refused when it is analysed. One row comes back per candidate.
    """

    class Generate:
        @staticmethod
        def analyze(prompts: AnalyzeArgument, count: AnalyzeArgument) -> AnalyzeResult:
            names = sorted(prompts.dataType.names) if prompts.isTable else []
            if names != sorted(INPUTS):
                raise ValueError(f"a generator may see exactly {INPUTS}, got {names}")
            return AnalyzeResult(_OUTPUT)

        def eval(self, prompts, count: int) -> Iterator[tuple]:
            context = {c: prompts[c] for c in INPUTS if c != "prompt"}
            for index, text in enumerate(generator(prompts["prompt"] or "", context, count)):
                yield context["example_id"], index, text

    spark.udtf.register(name, udtf(Generate))

"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from evalspark.plans import adapters


@dataclass(frozen=True)
class Tables:
    """The tables of one folder, read on first use as ``tables.orders`` and so on."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def adapted(self, name: str) -> DataFrame:
        """A frame in the shape of the data model, derived from the tables."""
        return adapters.frame(self, name)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a function of ``Tables``; ``uses`` names the adapters its SQL reads."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = adapters.with_ctes(uses.split(), sql)
        return build

    return register


def load() -> None:
    """Import the modules that register queries."""
    from evalspark.plans import (  # noqa: F401
        completion_queries,
        equivalence_queries,
        identity_queries,
        latency_queries,
        leakage_queries,
        row_queries,
        sampling_queries,
        scoring_queries,
        source_queries,
        stream_queries,
        validation_queries,
        workflow_queries,
        workload_queries,
    )

"""Percentiles from sketches that are stored once and merged later.

A sketch of a day and a database is a few kilobytes, whatever the number of its rows. Sketches of
many days or databases merge without the rows they were made from. For the exact percentiles see
``ranking.order_statistics``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The size parameter of the sketches.
SKETCH_K = 800


def rank_error(k: int = SKETCH_K) -> float:
    """How far a quantile's rank may be off, as a share of the rows, with 99 % confidence.

    The published error of KLL sketches of this size; sketches of few rows are exact.
    """
    return 2.296 / k**0.9723


def sketch(rows: DataFrame, by: list[str], column: str, k: int = SKETCH_K) -> DataFrame:
    """One row per group: ``by``, ``n`` and the ``sketch`` of a column, made on the map side.

    Nulls and NaN are left out; a group of nothing else has no row.
    """
    value = F.col(column).cast("double")
    kept = rows.filter(value.isNotNull() & ~F.isnan(value)).withColumn("_value", value)
    return kept.groupBy(*by).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double("_value", k).alias("sketch")
    )


def merge(sketches: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """The sketches of coarser groups; with an empty ``by`` one for all."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    ).filter("n > 0")


def quantiles(sketches: DataFrame, by: list[str], profile: dict[str, float]) -> DataFrame:
    """``by``, ``n``, ``name`` and ``value`` for each name and rank of the profile."""
    values = [
        F.struct(F.lit(name).alias("name"), F.kll_sketch_get_quantile_double("sketch", F.lit(rank)).alias("value"))
        for name, rank in profile.items()
    ]
    return sketches.select(*by, "n", F.inline(F.array(*values)))

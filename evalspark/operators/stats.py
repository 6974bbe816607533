"""Paired significance tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.aggregates import count_where
from evalspark.operators.validate import DataError

_CHUNK = 4096
_NEGLIGIBLE = 1e-20


def two_sided_binomial(k: int, n: int) -> float:
    """Exact two-sided tail of Binomial(n, 1/2) at ``k <= n/2``.

    Summed downwards from the largest term, found in log space, so it neither under- nor
    overflows and stops after the terms that matter, about sqrt(n) of them.
    """
    if n == 0:
        return 1.0
    log_top = (
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2.0)
    )
    total, term, start = 1.0, 1.0, k
    while start > 0 and term > _NEGLIGIBLE * total:
        i = np.arange(start, max(start - _CHUNK, 0), -1, dtype=float)
        terms = term * np.cumprod(i / (n - i + 1.0))
        total += float(terms.sum())
        term, start = float(terms[-1]), start - len(i)
    return min(1.0, 2.0 * math.exp(log_top + math.log(total)))


@F.pandas_udf(T.DoubleType())
def _p_value(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([two_sided_binomial(int(min(x, y)), int(x + y)) for x, y in zip(b, c)])


def mcnemar(arm_a: DataFrame, arm_b: DataFrame, key: str = "example_id") -> DataFrame:
    """One row: discordant counts and the exact p-value of two arms' ``correct`` flags.

    An example missing from one arm is an error, as the arms must be paired.
    """
    pairs = arm_a.select(key, F.col("correct").alias("a")).join(
        arm_b.select(key, F.col("correct").alias("b")), key, "full_outer"
    )
    return mcnemar_of_pairs(pairs)


def mcnemar_of_pairs(pairs: DataFrame) -> DataFrame:
    """As ``mcnemar`` for rows that hold both flags as ``a`` and ``b``."""
    unpaired = F.col("a").isNull() | F.col("b").isNull()
    checked = F.when(unpaired, F.raise_error(F.lit("arms are not paired")).cast("int")).otherwise(0)
    counts = pairs.agg(
        count_where("a and not b").alias("b"),
        count_where("b and not a").alias("c"),
        (F.count("*") + F.coalesce(F.sum(checked), F.lit(0))).alias("n"),
    )
    return counts.select(
        "b",
        "c",
        (F.col("b") + F.col("c")).alias("discordant"),
        "n",
        _p_value("b", "c").alias("p_value"),
    )


# The multipliers of the 32-bit integer hash of the draws.
_FIRST_FACTOR, _SECOND_FACTOR, _STEP = 0x7FEB352D, 0x846CA68B, 0x9E3779B9
_WORD = 0xFFFFFFFF
# Poisson counts further from their mean than this many standard deviations, and a few more, are left out.
_REACH, _FEW = 12, 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(_FIRST_FACTOR)) & np.uint64(_WORD)
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(_SECOND_FACTOR)) & np.uint64(_WORD)
    return x ^ (x >> np.uint64(16))


def uniform_draws(key: int, replicates: np.ndarray) -> np.ndarray:
    """The draw of each replicate for a 32-bit key, between 0 and 1: a hash, so any engine can repeat it."""
    spread = _mixed((replicates.astype(np.uint64) * np.uint64(_STEP)) & np.uint64(_WORD))
    return (_mixed(spread ^ np.uint64(key)).astype(float) + 0.5) / 2**32


def poisson_counts(n: int, uniforms: np.ndarray) -> np.ndarray:
    """The smallest k at which Poisson(n)'s distribution function reaches each uniform number."""
    reach = _REACH * math.sqrt(n) + _FEW
    first, last = max(0, math.floor(n - reach)), math.ceil(n + reach)
    steps = np.r_[0.0, np.cumsum(np.log(np.arange(first + 1, last + 1)))]
    logs = np.arange(first, last + 1) * math.log(n) - n - math.lgamma(first + 1) - steps
    return first + np.searchsorted(np.cumsum(np.exp(logs)), uniforms)


def _replicate_sums(batches: Iterator[pd.DataFrame], draw, n_bootstrap: int) -> pd.DataFrame:
    sums, sizes = np.zeros(n_bootstrap), np.zeros(n_bootstrap)
    for batch in batches:
        for value, n, key in zip(batch["value"], batch["n"], batch["key"]):
            taken = draw(int(n), int(key))
            sums += taken * value
            sizes += taken
    return pd.DataFrame({"rep": np.arange(n_bootstrap), "total": sums, "size": sizes})


_PARTIAL = "rep int, total double, size double"


def _poisson_sums(keyed: DataFrame, n_bootstrap: int) -> DataFrame:
    replicates = np.arange(n_bootstrap)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _replicate_sums(
            batches, lambda n, key: poisson_counts(n, uniform_draws(key, replicates)), n_bootstrap
        )

    return keyed.mapInPandas(draw, _PARTIAL)


# Parts the values are dealt to, each drawn in a task of its own.
_PARTS = 256


def _multinomial_sums(keyed: DataFrame, n_bootstrap: int, seed: int) -> DataFrame:
    """Resamples of exactly all rows, split binomially: among parts, then among a part's values.

    The driver learns how many rows each part has, ``_PARTS`` numbers. A task draws for itself
    what the parts before its own take, so all tasks agree on how a replicate is split.
    """
    dealt = keyed.withColumn("part", F.pmod("key", F.lit(_PARTS)).cast("int"))
    sizes = [0] * _PARTS
    for row in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect():
        sizes[row.part] = row.n

    def split(left: np.ndarray, n: int, of: int, *name: int) -> np.ndarray:
        return left.copy() if n >= of else np.random.default_rng([seed, *name]).binomial(left, n / of)

    def draw(key, rows: pd.DataFrame) -> pd.DataFrame:
        part, of = int(key[0]), sum(sizes)
        left = np.full(n_bootstrap, of)
        for i in range(part):
            left, of = left - split(left, sizes[i], of, i), of - sizes[i]
        left, of = split(left, sizes[part], of, part), sizes[part]

        def take(n: int, name: int) -> np.ndarray:
            nonlocal left, of
            taken = split(left, n, of, part, name)
            left, of = left - taken, of - n
            return taken

        return _replicate_sums(iter([rows.sort_values(["key", "value"])]), take, n_bootstrap)

    return dealt.groupBy("part").applyInPandas(draw, _PARTIAL)


def bootstrap_ci(
    differences: DataFrame,
    column: str = "difference",
    n_bootstrap: int = 2000,
    seed: int = 0,
    alpha: float = 0.05,
    method: str = "poisson",
) -> DataFrame:
    """One row: mean difference and its percentile bootstrap interval.

    Equal differences are counted first. A replicate draws how often each distinct value is
    taken: with ``poisson`` each value by itself, with the value's count as mean, from a hash of
    seed, value and replicate; with ``multinomial`` so that all replicates have as many rows as
    the data. Draws depend on values, not on tasks, so a lost task redraws the same. What leaves
    a task is one pair of sums per replicate, whatever the data's size.
    """
    if n_bootstrap < 100:
        raise DataError("n_bootstrap must be at least 100")
    if not 0 < alpha < 1:
        raise DataError("alpha must lie between 0 and 1")
    if method not in ("poisson", "multinomial"):
        raise DataError(f"no method {method}")
    counted = (
        differences.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("double").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    name = F.concat(F.lit(f"{seed}:"), F.col("value").cast("string"))
    keyed = counted.withColumn("key", F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint"))
    if method == "poisson":
        partial = _poisson_sums(keyed, n_bootstrap)
    else:
        partial = _multinomial_sums(keyed, n_bootstrap, seed)
    means = (
        partial.groupBy("rep")
        .agg((F.sum("total") / F.nullif(F.sum("size"), F.lit(0.0))).alias("mean"))
    )
    bounds = means.agg(
        F.percentile("mean", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("mean", F.lit(1 - alpha / 2)).alias("ci_high"),
    )
    observed = counted.agg(
        F.sum("n").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean")
    )
    zero = F.lit(0.0)
    return (
        observed.withColumn("_one", F.lit(1))
        .join(bounds.withColumn("_one", F.lit(1)), "_one")
        .select(
            F.coalesce("mean", zero).alias("mean_difference"),
            F.coalesce("ci_low", zero).alias("ci_low"),
            F.coalesce("ci_high", zero).alias("ci_high"),
            F.lit(n_bootstrap).alias("n_bootstrap"),
            F.lit(alpha).alias("alpha"),
            F.coalesce("n", F.lit(0)).alias("n_pairs"),
        )
    )

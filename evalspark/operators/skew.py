"""Joins on keys of which a few may hold a large part of all rows.

Adaptive execution splits skewed join partitions by itself, so most joins here are plain.
It does not where the next step builds on the join's partitioning, for then a split would
cost another shuffle; those joins are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with more rows than this is split. It also bounds what is broadcast: a table of
# N rows has at most N / HOT_ROWS such keys, and only their 8-byte hashes are sent.
HOT_ROWS = 1_000_000
SALTS = 64


def salted_join(
    rows: DataFrame,
    keyed: DataFrame,
    keys: list[str],
    salt_by: list[str],
    how: str = "inner",
    size: str | None = None,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``rows`` to ``keyed``, spreading the rows of hot keys over ``salts`` tasks.

    ``salt_by`` are columns of ``rows`` that differ between the rows of one key. ``size``
    names the column of ``keyed`` that tells how many rows a key has; without it they are
    counted first. Rows of ``keyed`` with a hot key are copied once per salt, all others
    stay single. Two keys with one hash are both treated as hot, which changes no result.
    """
    hashed = F.xxhash64(*keys)
    if size is None:
        sizes = rows.groupBy(hashed.alias("_h")).agg(F.count("*").alias("_n"))
    else:
        sizes = keyed.select(hashed.alias("_h"), F.col(size).alias("_n"))
    hot = sizes.filter(F.col("_n") > hot_rows).select("_h", F.lit(True).alias("_hot")).distinct()
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    left = (
        rows.withColumn("_h", hashed)
        .join(hot, "_h", "left")
        .withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0))
        .drop("_h", "_hot")
    )
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    right = (
        keyed.withColumn("_h", hashed)
        .join(hot, "_h", "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), copies).otherwise(F.array(F.lit(0)))))
        .drop("_h", "_hot")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")

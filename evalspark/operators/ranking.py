"""Ranks and order statistics that never sort one group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.identity import order_hash

BUCKET_DIGITS = 3  # 16**3 buckets per group
STEPS_PER_OCTAVE = 256
SLICES = 4096


def hash_rank(
    df: DataFrame, group: list[str], key: str, seed: int, quotas: DataFrame | None = None
) -> DataFrame:
    """Add ``rn``: each row's place within its group, in seeded hash order.

    The hash spreads every group evenly over buckets, so a group that holds a third of
    all rows is still ranked in many tasks: a bucket's first rank is the number of rows
    in the buckets before it. With ``quotas`` (the group columns and ``quota``) only
    ranks up to the quota are kept, and buckets that start beyond it are never sorted.
    """
    hashed = df.withColumn("_order", order_hash(seed, F.col(key))).withColumn(
        "_bucket", F.substring("_order", 1, BUCKET_DIGITS)
    )
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        hashed.groupBy(*group, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    if quotas is not None:
        offsets = offsets.join(quotas, group).filter("_offset < quota")
    within = Window.partitionBy(*group, "_bucket").orderBy("_order", key)
    ranked = hashed.join(offsets, [*group, "_bucket"]).withColumn(
        "rn", (F.col("_offset") + F.row_number().over(within)).cast("bigint")
    )
    if quotas is not None:
        ranked = ranked.filter("rn <= quota").drop("quota")
    return ranked.drop("_order", "_bucket", "_offset")


def value_bucket(value: Column) -> Column:
    """Monotone log-linear bucket of a number: about 0.3 % wide, few thousand in all."""
    size = F.floor(F.log2(F.lit(1.0) + F.abs(value)) * STEPS_PER_OCTAVE)
    return F.when(value < 0, -size - 1).otherwise(size).cast("int")


def count_values(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Each group's distinct values and how often they occur; ties collapse early."""
    return (
        values.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_bucket", value_bucket(F.col("_v")))
    )


def _find(counted: DataFrame, keys: list[str], cell: str, picks: DataFrame) -> DataFrame:
    """The cell each pick's rank falls in, with the rank within it and the cell's range.

    The window runs over a histogram, one row per cell, never over the values.
    """
    upto = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    histogram = counted.groupBy(*keys, cell).agg(
        F.sum("_n").alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    ends = histogram.withColumn("_end", F.sum("_size").over(upto))
    start = F.col("_end") - F.col("_size")
    return (
        ends.join(picks, keys)
        .filter((F.col("place") >= start) & (F.col("place") < F.col("_end")))
        .select(*keys, cell, "name", "rank", (F.col("place") - start).alias("place"), "_low", "_high")
    )


def order_statistics(counted: DataFrame, group: list[str], picks: DataFrame) -> DataFrame:
    """The values at given 0-based ranks of each group: ``name, rank, value``.

    ``counted`` comes from ``count_values``. ``picks`` has the group columns, ``name`` and
    ``rank``: a few rows per group. A histogram finds the bucket of each rank, a second
    one the slice within the bucket, and only those slices are ranked value by value.
    """
    first = _find(counted, group, "_bucket", picks.withColumn("place", F.col("rank")))
    ranges = first.select(*group, "_bucket", "_low", "_high").distinct()
    width = F.nullif(F.col("_high") - F.col("_low"), F.lit(0))
    share = (F.col("_v") - F.col("_low")) / width
    sliced = counted.join(ranges, [*group, "_bucket"]).select(
        *group,
        "_bucket",
        "_v",
        "_n",
        F.coalesce(F.floor(share * (SLICES - 1)), F.lit(0)).alias("_slice"),
    )
    keys = [*group, "_bucket"]
    second = _find(sliced, keys, "_slice", first.drop("_low", "_high")).drop("_low", "_high")
    keys = [*keys, "_slice"]
    within = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.join(second.select(*keys).distinct(), keys).withColumn(
        "_last", F.sum("_n").over(within)
    )
    hit = (F.col("place") < F.col("_last")) & (F.col("place") >= F.col("_last") - F.col("_n"))
    return ranked.join(second, keys).filter(hit).select(
        *group, "name", "rank", F.col("_v").alias("value")
    )


def _places(counted: DataFrame, group: list[str], fractions: dict[str, float]) -> DataFrame:
    """Per group and fraction the place ``p * (n - 1)`` among its ``n`` values."""
    sizes = counted.groupBy(*group).agg(F.sum("_n").alias("n"))
    table = F.array(
        *[F.struct(F.lit(k).alias("name"), F.lit(f).alias("p")) for k, f in fractions.items()]
    )
    return sizes.select(*group, "n", F.inline(table)).withColumn(
        "place", F.col("p") * (F.col("n") - 1)
    )


def _grouped(values: DataFrame, group: list[str]) -> tuple[DataFrame, list[str]]:
    return (values, group) if group else (values.withColumn("_all", F.lit(0)), ["_all"])


def percentiles_linear(
    values: DataFrame, group: list[str], value: str, fractions: dict[str, float]
) -> DataFrame:
    """Percentiles interpolated between the two closest ranks: ``group, name, value``."""
    values, keys = _grouped(values, group)
    counted = count_values(values, keys, value)
    places = _places(counted, keys, fractions)
    low = F.floor("place").cast("bigint")
    ranks = F.array_distinct(F.array(low, F.least(low + 1, F.col("n") - 1)))
    share = (F.col("place") - F.floor("place")).alias("share")
    picks = places.select(
        *keys, F.struct("name", share).alias("name"), F.explode(ranks).alias("rank")
    )
    ends = order_statistics(counted, keys, picks).groupBy(*keys, "name").agg(
        F.min("value").alias("_low"), F.max("value").alias("_high")
    )
    return ends.select(
        *group,
        F.col("name.name").alias("name"),
        (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("name.share")).alias("value"),
    )


def percentiles_nearest(
    values: DataFrame, group: list[str], value: str, fractions: dict[str, float]
) -> DataFrame:
    """Percentiles at the closest rank, halves to the even one: ``group, name, value``."""
    values, keys = _grouped(values, group)
    counted = count_values(values, keys, value)
    picks = _places(counted, keys, fractions).select(
        *keys, "name", F.bround("place").cast("bigint").alias("rank")
    )
    return order_statistics(counted, keys, picks).select(*group, "name", "value")

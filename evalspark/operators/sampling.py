"""Stratified samples, splits and source intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.text import strip
from evalspark.operators.leakage import digest
from evalspark.operators.ranking import hash_rank
from evalspark.operators.validate import DataError

TURN_BLOCK = 4096  # turns that are summed up together


def round_robin_quotas(df: DataFrame, stratum: str, size: int, cover_all: bool = False) -> DataFrame:
    """How many rows each stratum gives when strata take turns, in name order.

    Every stratum gives ``level`` rows or all it has; the rest goes, one row each, to the
    first strata that have more. The level is read off the sorted stratum sizes, so the
    windows run over one row per stratum and never over the data. ``cover_all`` grants
    each stratum one row even where that exceeds ``size``.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    everything = Window.partitionBy()
    by_size = Window.orderBy("_size", stratum)
    wanted = F.lit(size).cast("bigint")
    if cover_all:
        wanted = F.greatest(wanted, F.count("*").over(everything))
    # If the level were this stratum's size: the smaller ones give all, the others the level.
    taken = F.sum("_size").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    remaining = F.count("*").over(everything) - F.row_number().over(by_size) + 1
    at_level = (
        sizes.withColumn("_wanted", wanted)
        .withColumn("_remaining", remaining)
        .withColumn("_taken", F.coalesce(taken, F.lit(0)))
        .withColumn("_total", F.col("_taken") + F.col("_size") * F.col("_remaining"))
    )
    # Strata that fit the budget are used up; the first that does not sets the level.
    open_level = F.min_by(
        F.expr("(_wanted - _taken) div _remaining"),
        F.when(F.col("_total") > F.col("_wanted"), F.struct("_size", stratum)),
    ).over(everything)
    level = F.coalesce(open_level, F.max("_size").over(everything))
    leveled = at_level.withColumn("_level", level).withColumn(
        "_base", F.least("_size", F.col("_level"))
    )
    more = F.col("_size") > F.col("_level")
    place = F.row_number().over(Window.partitionBy(more).orderBy(stratum))
    rest = F.col("_wanted") - F.sum("_base").over(everything)
    return (
        leveled.withColumn("_extra", F.when(more & (place <= rest), 1).otherwise(0))
        .select(stratum, (F.col("_base") + F.col("_extra")).alias("quota"))
        .filter("quota > 0")
    )


def round_robin_sample(
    df: DataFrame, stratum: str, key: str, size: int, seed: int, cover_all: bool = False
) -> DataFrame:
    """``size`` rows taken in turns from the strata; ``rn`` is the turn."""
    quotas = round_robin_quotas(df, stratum, size, cover_all)
    return hash_rank(df, [stratum], key, seed, quotas)


def with_selection_order(sample: DataFrame, stratum: str) -> DataFrame:
    """Number a round-robin sample turn by turn, strata in name order within a turn.

    Turns are summed up in blocks, so that no task passes over every turn.
    """
    block = F.floor(F.col("rn") / TURN_BLOCK).alias("_block")
    turns = sample.groupBy("rn").agg(F.count("*").alias("_n")).select("rn", "_n", block)

    def before(window) -> Column:
        earlier = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(earlier), F.lit(0))

    blocks = turns.groupBy("_block").agg(F.sum("_n").alias("_n"))
    starts = blocks.select("_block", before(Window.orderBy("_block")).alias("_start"))
    inside = turns.withColumn("_inside", before(Window.partitionBy("_block").orderBy("rn")))
    offsets = inside.join(starts, "_block").select(
        "rn", (F.col("_start") + F.col("_inside")).alias("_offset")
    )
    place = F.row_number().over(Window.partitionBy("rn").orderBy(stratum))
    return (
        sample.withColumn("_place", place)
        .join(offsets, "rn")
        .withColumn("selection_order", F.col("_offset") + F.col("_place"))
        .drop("_place", "_offset")
    )


def train_validation_split(
    examples: DataFrame, size: int, seed: int, stratum: str = "db_id", key: str = "example_id"
) -> DataFrame:
    """Training rows with ``split`` either ``train`` or ``validation_tuning``."""
    train = examples.filter(F.col("split") == "train")
    if train.limit(size + 1).count() <= size:
        raise DataError(f"need more than {size} training rows")
    chosen = round_robin_sample(train.select(stratum, key), stratum, key, size, seed)
    label = chosen.select(key).distinct().withColumn("_split", F.lit("validation_tuning"))
    return (
        train.join(label, key, "left")
        .withColumn("split", F.coalesce("_split", "split"))
        .select(*examples.columns)
    )


def select_for_collection(
    examples: DataFrame, used: DataFrame, size: int, seed: int
) -> DataFrame:
    """Round-robin selection among rows not used before: ``example_id, db_id, selection_order``."""
    pool = examples.select("example_id", "db_id").join(used.select("example_id"), "example_id", "left_anti")
    sample = round_robin_sample(pool, "db_id", "example_id", size, seed)
    return with_selection_order(sample, "db_id").select("example_id", "db_id", "selection_order")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first rows in source order, which an ordinal column must carry."""
    return df.orderBy(order).limit(n)


def select_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("example_id").distinct(), "example_id", "left_semi")


def identity_key() -> Column:
    """All that makes a source row itself: database, raw question, evidence, SQL."""
    empty = F.lit("")
    return digest(
        F.col("db_id"),
        F.col("question"),
        strip(F.coalesce(F.col("evidence"), empty)),
        strip(F.coalesce(F.col("gold_sql"), empty)),
    )


def split_by_identity(
    rows: DataFrame, engineering: DataFrame, formal: DataFrame
) -> DataFrame:
    """Three-way split: the rows of two frozen selections, and training for the rest."""
    selections = (
        engineering.select(identity_key().alias("_key"), F.lit("validation_tuning").alias("_role"))
        .unionAll(formal.select(identity_key(), F.lit("formal_validation")))
        .groupBy("_key")
        .agg(F.max("_role").alias("_role"))  # engineering wins
    )
    keyed = rows.withColumn("_key", identity_key())
    joined = keyed.join(selections, "_key", "left")
    return joined.withColumn("split", F.coalesce("_role", F.lit("train"))).drop("_key", "_role")


def adapt_source(raw: DataFrame, schemas: DataFrame) -> DataFrame:
    """Raw records beside their schema text, with the reason why a row is skipped.

    ``gold_ok`` tells whether the row's gold SQL ran.
    """
    joined = raw.join(schemas, "db_id", "left")
    empty = F.lit("")
    unusable = (
        (F.coalesce("schema_text", empty) == "")
        | (strip(F.coalesce("question", empty)) == "")
        | (strip(F.coalesce("gold_sql", empty)) == "")
    )
    return joined.withColumn(
        "skip_reason",
        F.when(unusable, "missing_db").when(
            ~F.coalesce("gold_ok", F.lit(False)), "gold_failure"
        ),
    )


def intake(adapted: DataFrame, order: str, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, at most ``cap``, and the outcome counts.

    With a cap, records behind the last accepted one count as never seen.
    """
    accepted = adapted.filter(F.col("skip_reason").isNull())
    seen = adapted
    if cap is not None:
        accepted = accepted.orderBy(order).limit(cap)
        last = accepted.agg(
            F.when(F.count("*") == cap, F.max(order)).otherwise(F.lit(2**62)).alias("last")
        )
        seen = adapted.filter(F.col(order) <= last.scalar())
    counts = seen.groupBy(F.coalesce("skip_reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("n")
    )
    return accepted.drop("skip_reason"), counts

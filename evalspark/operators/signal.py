"""Whether rewards differ within groups, as policy training needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.aggregates import count_where

STD_FLOOR = 1e-9  # fixed value: below it a group's rewards count as equal
SEMANTIC_FLAGS = ["parse_ok", "safe", "execution_success", "strict_equivalent"]

# What a run must show. The strong gate asks for both lists.
STRICT_MINIMUMS = {
    "generation_group_count": 8,
    "nonzero_reward_std_group_count": 3,
    "nonzero_grad_step_count": 2,
    "parse_valid_completion_count": 1,
    "execution_success_count": 1,
    "semantic_variance_group_count": 1,
}
STRONG_MINIMUMS = {
    "generation_group_count": 10,
    "nonzero_reward_std_group_count": 5,
    "nonzero_grad_step_count": 3,
    "semantic_variance_group_count": 2,
    "execution_success_count": 2,
}


def _varies(flag: str) -> Column:
    """More than one value in the group, null being a value of its own."""
    seen = [
        F.max(F.col(flag).eqNullSafe(value).cast("int")) for value in (True, False, None)
    ]
    return (seen[0] + seen[1] + seen[2]) > 1


def group_stats(samples: DataFrame, group: str = "generation_group_id") -> DataFrame:
    """Per group its reward deviation and whether any outcome flag varies.

    All aggregates combine on the map side, so a group of any size is a few numbers.
    """
    spread = F.coalesce(F.stddev_pop("reward"), F.lit(0.0))
    varies = _varies(SEMANTIC_FLAGS[0])
    for flag in SEMANTIC_FLAGS[1:]:
        varies = varies | _varies(flag)
    return samples.groupBy(group).agg(
        F.count("*").alias("n"), spread.alias("reward_std"), varies.alias("varies")
    )


def signal_stats(samples: DataFrame, group: str = "generation_group_id") -> DataFrame:
    """One row of counts over groups and completions."""
    finite = F.col("reward").isNotNull() & ~F.isnan("reward") & (F.abs("reward") < float("inf"))
    flags = samples.groupBy(group).agg(
        count_where("parse_ok").alias("parsed"),
        count_where("execution_success").alias("ran"),
        count_where("strict_equivalent").alias("strict"),
        F.bool_and(finite).alias("finite"),
        F.coalesce(F.stddev_pop("reward"), F.lit(0.0)).alias("reward_std"),
        *[_varies(f).alias(f"v_{f}") for f in SEMANTIC_FLAGS],
    )
    moved = F.col("reward_std") > STD_FLOOR
    varies = F.expr(" or ".join(f"v_{f}" for f in SEMANTIC_FLAGS))
    total = flags.agg(
        F.count("*").alias("generation_group_count"),
        count_where(moved).alias("nonzero_reward_std_group_count"),
        count_where(moved & varies).alias("semantic_variance_group_count"),
        F.coalesce(F.sum("parsed"), F.lit(0)).alias("parse_valid_completion_count"),
        F.coalesce(F.sum("ran"), F.lit(0)).alias("execution_success_count"),
        F.coalesce(F.sum("strict"), F.lit(0)).alias("strict_correct_count"),
        F.coalesce(F.bool_and("finite"), F.lit(False)).alias("all_rewards_finite"),
    )
    groups, nonzero = F.col("generation_group_count"), F.col("nonzero_reward_std_group_count")
    return total.withColumn(
        "zero_std_group_fraction", F.when(groups > 0, F.round((groups - nonzero) / groups, 4))
    )


def reward_histogram(samples: DataFrame, reward: str = "total_reward") -> DataFrame:
    """``bucket, n`` by the lower bound of tenths; missing rewards are under ``None``.

    The floor is taken on decimals, so 0.3 lands in 0.30 and not in the bucket below.
    """
    tenth = F.floor(F.col(reward).cast("decimal(20,9)") * 10) / F.lit(10)
    bucket = F.when(F.col(reward).isNull(), "None").otherwise(
        F.format_string("%.2f", tenth.cast("double"))
    )
    return samples.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def signal_gates(evidence: DataFrame) -> DataFrame:
    """Add the two gate columns to an evidence row."""

    def at_least(minimums: dict[str, int]) -> Column:
        ok = F.lit(True)
        for name, least in minimums.items():
            ok = ok & (F.coalesce(F.col(name), F.lit(0)) >= least)
        return ok

    changed = (
        F.coalesce("trainable_param_sha256_changed", F.lit(False))
        & (F.coalesce("parameter_delta_l2", F.lit(0.0)) > 0)
        & (F.coalesce("changed_parameter_tensor_count", F.lit(0)) > 0)
        & F.coalesce("all_rewards_finite", F.lit(False))
    )
    strict = at_least(STRICT_MINIMUMS) & changed
    return evidence.withColumn("strict_gate", strict).withColumn(
        "strong_gate", strict & at_least(STRONG_MINIMUMS)
    )

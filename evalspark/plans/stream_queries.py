"""Streams, drained to the end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.plans.registry import Tables, query
from evalspark.session import scratch_path
from evalspark.streaming import intake


@query(
    "stream_intake",
    """SELECT example_id, candidate_index, 'early' || length(text) AS raw_candidate_output, created_at
    FROM (SELECT *, raw_candidate_output AS text FROM candidates)""",
    "candidates",
)
def stream_intake(t: Tables):
    """Candidates that arrive twice, in two deliveries, are taken in once."""
    path = scratch_path(t.spark, "arrivals")
    base = t.adapted("candidates").select("example_id", "candidate_index", "created_at", "n_chars")

    def delivery(word: str, time: str):
        return base.select(
            "example_id",
            "candidate_index",
            F.concat(F.lit(word), "n_chars").alias("raw_candidate_output"),
            F.concat("created_at", F.lit(time)).alias("created_at"),
        )

    table, checkpoint = scratch_path(t.spark, "table"), scratch_path(t.spark, "checkpoint")
    delivery("early", "").unionAll(delivery("later", "Z")).write.mode("append").json(path)
    intake.intake_candidates(intake.stream_candidates(t.spark, path), table, checkpoint)
    delivery("again", "").write.mode("append").json(path)
    intake.intake_candidates(intake.stream_candidates(t.spark, path), table, checkpoint)
    return t.spark.read.parquet(table).select(
        "example_id", "candidate_index", "raw_candidate_output", "created_at"
    )


@query(
    "stream_totals",
    """SELECT generation_group_id, 2 * count(*) AS n, round(2 * sum(reward), 4) AS reward_sum,
      round(stddev_pop(reward), 4) AS reward_std FROM samples GROUP BY 1""",
    "samples",
)
def stream_totals(t: Tables):
    """Reward totals per group, kept current over two deliveries of the log."""
    path = scratch_path(t.spark, "rewards")
    table, checkpoint = scratch_path(t.spark, "totals"), scratch_path(t.spark, "checkpoint")
    samples = t.adapted("samples").select("generation_group_id", "reward")
    for _ in range(2):
        samples.write.mode("append").json(path)
        intake.stream_group_totals(intake.stream_samples(t.spark, path), table, checkpoint)
    return intake.latest_totals(t.spark, table).withColumns(
        {"reward_sum": F.round("reward_sum", 4), "reward_std": F.round("reward_std", 4)}
    )

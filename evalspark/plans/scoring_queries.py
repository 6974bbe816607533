"""Rewards, group signal and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import metrics, scoring, signal
from evalspark.plans.completion_queries import EXPECTED
from evalspark.plans.registry import Tables, query

_OUTCOME = """turn % 4 <> 3 AS success, turn % 4 <> 3 AND conv_id % 3 = 0 AS strict,
      turn % 4 <> 3 AND conv_id % 3 <> 0 AND conv_id % 5 = 0 AS partial"""
SCORED = f"""{EXPECTED},
    o AS (SELECT *, error_type = 'none' AS safe, coalesce(error_type = 'none', false) AS ran, {_OUTCOME} FROM s),
    r AS (SELECT *, CASE WHEN format_ok THEN 0.05 WHEN protocol = 'fence' THEN 0.0 ELSE -0.4 END::DOUBLE AS format_reward,
      CASE WHEN ran THEN 0.05 ELSE -0.4 END::DOUBLE AS parse_reward,
      CASE WHEN safe THEN 0.05 WHEN NOT safe THEN -1.0 ELSE 0.0 END::DOUBLE AS safety_reward,
      CASE WHEN ran AND success THEN 0.1 ELSE 0.0 END::DOUBLE AS execution_reward,
      CASE WHEN ran AND strict THEN 1.0 WHEN ran AND partial THEN 0.25 ELSE 0.0 END::DOUBLE AS correctness_reward FROM o),
    w AS (SELECT *, CASE WHEN NOT safe THEN -1.0 ELSE greatest(-1.0, round(format_reward + parse_reward + safety_reward
      + execution_reward + correctness_reward, 6)) END::DOUBLE AS total_reward FROM r)"""


def _scored(t: Tables):
    completions = t.adapted("completions")
    success = F.col("turn") % 4 != 3
    strict = success & (F.col("conv_id") % 3 == 0)
    outcomes = completions.select(
        "conv_id",
        "turn",
        success.alias("success"),
        strict.alias("strict_equivalent"),
        (success & ~strict & (F.col("conv_id") % 5 == 0)).alias("partial_credit"),
        F.when(strict, "unordered_rows").otherwise("not_equivalent").alias("error_type"),
        F.col("turn").alias("candidate_row_count"),
    )
    return scoring.score(scoring.scorable(completions, "raw"), outcomes, ["conv_id", "turn"])


_PARTS = ["format_reward", "parse_reward", "safety_reward", "execution_reward", "correctness_reward"]


@query(
    "reward_components",
    f"{SCORED} SELECT example_id, turn, {', '.join(_PARTS)}, total_reward FROM w",
    "completions",
)
def reward_components(t: Tables):
    """Reward components and total of every completion."""
    return _scored(t).select("example_id", "turn", *_PARTS, "total_reward")


@query(
    "reward_samples",
    f"""{SCORED} SELECT 'run-1' AS run_id, group_id AS generation_group_id, CAST(turn AS INTEGER) AS completion_index,
      CASE WHEN ends_with(rtrim(raw, chr(10) || ' '), '</sql>') THEN 'sql_close' ELSE 'max_tokens_or_eos' END AS stop_reason,
      CAST((length(lower(raw)) - length(replace(lower(raw), '<sql>', ''))) // 5 AS INTEGER) AS sql_block_count,
      total_reward AS reward, {', '.join(_PARTS)}, format_ok AS parse_ok, safe,
      CASE WHEN ran THEN success END AS execution_success, CASE WHEN ran THEN strict END AS strict_equivalent,
      CASE WHEN ran THEN partial END AS partial_credit, NULL::VARCHAR AS timestamp, NULL::BIGINT AS optimizer_step,
      length(raw) AS completion_tokens, example_id, db_id,
      CASE WHEN ran THEN CASE WHEN strict THEN 'unordered_rows' ELSE 'not_equivalent' END END AS error_type,
      CASE WHEN ran THEN turn END AS candidate_row_count, NULL::BIGINT AS gold_row_count FROM w""",
    "completions",
)
def reward_samples(t: Tables):
    """The flat reward log."""
    scored = _scored(t).withColumns(
        {
            "generation_group_id": F.col("group_id"),
            "completion_index": F.col("turn").cast("int"),
            "completion_tokens": F.length("raw"),
        }
    )
    return scoring.reward_samples(scored, "run-1", "raw")


@query(
    "reward_histogram",
    """SELECT CASE WHEN reward IS NULL THEN 'None' ELSE printf('%.2f', floor(CAST(reward AS DECIMAL(20, 9)) * 10) / 10.0)
      END AS bucket, count(*) AS n FROM samples GROUP BY 1""",
    "samples",
)
def reward_histogram(t: Tables):
    """Rewards by tenths."""
    return signal.reward_histogram(t.adapted("samples"), "reward")


_GROUPS = """, g AS (SELECT generation_group_id, count(*) AS n, coalesce(stddev_pop(reward), 0.0) AS std,
      count(DISTINCT coalesce(CAST(parse_ok AS VARCHAR), 'null')) > 1
        OR count(DISTINCT coalesce(CAST(safe AS VARCHAR), 'null')) > 1
        OR count(DISTINCT coalesce(CAST(execution_success AS VARCHAR), 'null')) > 1
        OR count(DISTINCT coalesce(CAST(strict_equivalent AS VARCHAR), 'null')) > 1 AS varies
      FROM samples GROUP BY 1)"""


@query(
    "group_stats",
    f"{_GROUPS} SELECT generation_group_id, n, round(std, 6) AS reward_std, varies FROM g",
    "samples",
)
def group_stats(t: Tables):
    """Reward spread and outcome variety of each group."""
    return signal.group_stats(t.adapted("samples")).withColumn(
        "reward_std", F.round("reward_std", 6)
    )


_SIGNAL = f"""{_GROUPS}, x AS (SELECT count(*) AS generation_group_count,
      count(*) FILTER (std > 1e-9) AS nonzero_reward_std_group_count,
      count(*) FILTER (std > 1e-9 AND varies) AS semantic_variance_group_count FROM g),
    y AS (SELECT count(*) FILTER (parse_ok) AS parse_valid_completion_count,
      count(*) FILTER (execution_success) AS execution_success_count,
      count(*) FILTER (strict_equivalent) AS strict_correct_count, bool_and(reward IS NOT NULL) AS all_rewards_finite FROM samples)"""


@query(
    "signal_stats",
    f"""{_SIGNAL} SELECT *, round((generation_group_count - nonzero_reward_std_group_count) / generation_group_count, 4)
      AS zero_std_group_fraction FROM x, y""",
    "samples",
)
def signal_stats(t: Tables):
    """Counts over groups and completions."""
    return signal.signal_stats(t.adapted("samples"))


@query(
    "signal_gates",
    f"""{_SIGNAL} SELECT generation_group_count >= 8 AND nonzero_reward_std_group_count >= 3
        AND parse_valid_completion_count >= 1 AND execution_success_count >= 1 AND semantic_variance_group_count >= 1
        AND all_rewards_finite AS strict_gate,
      generation_group_count >= 10 AND nonzero_reward_std_group_count >= 5 AND semantic_variance_group_count >= 2
        AND execution_success_count >= 2 AND parse_valid_completion_count >= 1 AND all_rewards_finite AS strong_gate FROM x, y""".replace(
        "FROM samples)", "FROM samples WHERE reward IS NOT NULL)"
    ).replace("FROM samples GROUP", "FROM samples WHERE reward IS NOT NULL GROUP"),
    "samples",
)
def signal_gates(t: Tables):
    """Whether the rewarded samples show enough signal to train on."""
    stats = signal.signal_stats(t.adapted("samples").filter("reward is not null"))
    evidence = stats.withColumns(
        {
            "nonzero_grad_step_count": F.lit(3),
            "trainable_param_sha256_changed": F.lit(True),
            "parameter_delta_l2": F.lit(0.5),
            "changed_parameter_tensor_count": F.lit(2),
        }
    )
    return signal.signal_gates(evidence).select("strict_gate", "strong_gate")


_VERDICT = f"""{SCORED}, z AS (SELECT *, CASE WHEN sql IS NULL THEN 'format_error' WHEN v = 12 THEN 'syntax_error'
      WHEN v IN (8, 9) THEN 'unsafe_sql' WHEN NOT success AND conv_id % 2 = 0 THEN 'timeout'
      WHEN NOT success THEN 'wrong_table' WHEN NOT strict THEN 'wrong_result' ELSE 'none' END AS error_bucket,
      sql IS NOT NULL AND error_type = 'none' AS exec FROM w)"""


def _records(t: Tables):
    completions = t.adapted("completions").withColumns(
        {
            "candidate_index": F.col("turn"),
            "split": F.when(F.col("conv_id") % 2 == 0, "dev").otherwise("test"),
            "latency_ms": F.length("raw") / 8,
        }
    )
    success = F.col("turn") % 4 != 3
    strict = success & (F.col("conv_id") % 3 == 0)
    late = ~success & (F.col("conv_id") % 2 == 0)
    verdicts = completions.select(
        "example_id",
        "candidate_index",
        success.alias("success"),
        late.alias("timed_out"),
        F.when(late, "timeout").when(~success, "sqlite_error").otherwise("none").alias("error_type"),
        F.when(~success, "no such table: x").otherwise("").alias("error_message"),
        strict.alias("equivalent"),
        (success & ~strict & (F.col("conv_id") % 5 == 0)).alias("partial_credit"),
        F.when(strict, "unordered_rows").otherwise("not_equivalent").alias("kind"),
        F.lit(3).alias("candidate_row_count"),
        F.lit(4).alias("gold_row_count"),
    )
    return scoring.evaluation_records(scoring.parsed(completions, "raw"), verdicts)


@query(
    "evaluation_records",
    f"""{_VERDICT} SELECT example_id, turn AS candidate_index, CASE WHEN conv_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split,
      db_id, sql, format_ok, sql IS NOT NULL AND v <> 12 AS sql_parse_ok, sql IS NOT NULL AS parse_ok, exec AS safe,
      exec AND success AS execution_success, exec AND strict AS execution_equivalent,
      exec AND partial AS verification_partial,
      CASE WHEN NOT exec THEN 'none' WHEN strict THEN 'unordered_rows' ELSE 'not_equivalent' END AS verification_kind,
      error_bucket, round(length(raw) / 8, 2) AS latency_ms, v = 0 AS exact_match,
      CASE WHEN sql IS NULL THEN 'none' ELSE error_type END AS safety_error_type,
      CASE WHEN exec AND error_bucket = 'timeout' THEN 'timeout' WHEN exec AND NOT success THEN 'sqlite_error' ELSE 'none' END
        AS execution_error_type, CASE WHEN exec THEN 3 ELSE 0 END AS row_count, CASE WHEN exec THEN 4 ELSE 0 END AS gold_row_count
    FROM z""",
    "completions",
)
def evaluation_records(t: Tables):
    """One evaluation record per completion."""
    return _records(t)


_RATES = """count(*) AS num_examples, avg(execution_equivalent::INT) AS execution_accuracy,
      avg(format_ok::INT) AS format_valid_rate, avg(sql_parse_ok::INT) AS sql_parse_valid_rate,
      avg(sql_parse_ok::INT) AS valid_sql_rate, avg(execution_success::INT) AS execution_success_rate,
      avg((error_bucket = 'unsafe_sql')::INT) AS unsafe_sql_rate, avg(exact_match::INT) AS exact_match_secondary,
      avg(verification_partial::INT) AS partial_equivalence_rate, round(avg(latency_ms), 6) AS mean_latency_ms"""


@query(
    "eval_rollup",
    f"""SELECT CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS split, {_RATES}
    FROM records GROUP BY ROLLUP (split)""",
    "records",
)
def eval_rollup(t: Tables):
    """All rates, overall and per split."""
    return metrics.evaluation_metrics(t.adapted("records")).withColumn(
        "mean_latency_ms", F.round("mean_latency_ms", 6)
    )


@query("error_buckets", "SELECT error_bucket, count(*) AS n FROM records GROUP BY 1", "records")
def error_buckets(t: Tables):
    """Records per error bucket."""
    return metrics.bucket_counts(t.adapted("records"))


@query(
    "prediction_accuracy",
    """SELECT count(quality) AS num_examples, count(*) FILTER (quality = 1) AS correct,
      count(*) FILTER (quality IS NULL) AS missing, count(*) FILTER (quality = 1) / count(quality) AS execution_accuracy
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def prediction_accuracy(t: Tables):
    """Accuracy over the documents that have a label, and how many have none."""
    judged = t.labels.select(
        F.concat(F.lit("doc-"), "doc_id").alias("example_id"),
        (F.col("quality") == 1).alias("strict_equivalent"),
    )
    return metrics.prediction_accuracy(t.adapted("examples"), judged)


@query(
    "prediction_errors",
    """SELECT 'doc-' || doc_id AS example_id, CASE WHEN quality IS NULL THEN 'missing_prediction'
      WHEN toxic = 1 THEN 'truncated_unverified' ELSE 'not_equivalent' END AS error
    FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1""",
)
def prediction_errors(t: Tables):
    """Every prediction that is missing or wrong, and how."""
    judged = t.labels.select(
        F.concat(F.lit("doc-"), "doc_id").alias("example_id"),
        (F.col("quality") == 1).alias("strict_equivalent"),
        F.when(F.col("toxic") == 1, "truncated_unverified").otherwise("not_equivalent").alias("kind"),
    )
    return metrics.prediction_errors(t.adapted("examples"), judged)


@query(
    "mode_rates",
    """SELECT CASE WHEN grouping(mode) = 1 THEN 'ALL' ELSE mode END AS mode, count(*) AS records,
      round(avg(format_valid::INT), 4) AS format_valid_rate, round(avg(sql_parse_valid::INT), 4) AS parse_valid_rate,
      round(avg(safe::INT), 4) AS safe_rate, round(avg(execution_success::INT), 4) AS execution_success_rate,
      round(avg(strict_equivalent::INT), 4) AS strict_execution_accuracy,
      round(avg((stop_reason = 'sql_close')::INT), 4) AS stop_at_sql_close_rate,
      round(avg((stop_reason = 'max_new_tokens')::INT), 4) AS truncation_rate,
      round(avg((len(regexp_extract_all(lower(raw_completion), '<sql>')) > 1)::INT), 4) AS multiple_sql_block_rate,
      round(avg(coalesce(completion_token_count, 0)), 2) AS mean_completion_tokens FROM records GROUP BY ROLLUP (mode)""",
    "records",
)
def mode_rates(t: Tables):
    """Rates overall and per generation mode."""
    return metrics.mode_rates(t.adapted("records"))


@query(
    "teacher_metrics",
    """, k AS (SELECT * FROM candidates WHERE example_id IN (SELECT example_id FROM conversation_examples WHERE ord % 5 <> 0)),
    n AS (SELECT count(*) AS n FROM conversation_examples WHERE ord % 5 <> 0)
    SELECT (SELECT n FROM n) AS requested_count, count(DISTINCT example_id) AS teacher_examples,
      count(*) AS generated_candidates, round(count(*) / count(DISTINCT example_id), 4) AS mean_candidates_per_example,
      round(count(*) FILTER (parse_valid) / count(*), 4) AS parse_valid_rate,
      round(count(*) FILTER (safe) / count(*), 4) AS safe_sql_rate,
      round(count(*) FILTER (execution_success) / count(*), 4) AS execution_success_rate,
      round(count(*) FILTER (execution_equivalent) / count(*), 4) AS strict_verified_rate,
      count(DISTINCT example_id) FILTER (execution_equivalent) AS verified_example_count,
      round(count(DISTINCT example_id) FILTER (execution_equivalent) / (SELECT n FROM n), 4) AS verified_example_coverage FROM k""",
    "candidates conversation_examples",
)
def teacher_metrics(t: Tables):
    """Rates over the candidates of the requested examples."""
    requested = t.adapted("conversation_examples").filter("ord % 5 <> 0")
    return metrics.teacher_metrics(t.adapted("candidates"), requested)


@query(
    "attempt_metrics",
    """, a AS (SELECT *, attempt_index = 0 AS one, sha256(lower(trim(candidate_sql))) AS h FROM candidates),
    e AS (SELECT example_id, bool_or(one AND execution_equivalent) AS early, bool_or(execution_equivalent) AS ever FROM a GROUP BY 1),
    q AS (SELECT count(*) AS n FROM conversation_examples),
    d AS (SELECT count(*) AS n FROM a r JOIN a f ON r.example_id = f.example_id AND f.one AND NOT r.one
      AND r.candidate_sql = f.candidate_sql),
    c AS (SELECT count(*) AS n, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n2,
      count(*) FILTER (one AND parse_valid) AS p1, count(*) FILTER (one AND safe) AS s1,
      count(*) FILTER (one AND execution_success) AS x1, count(*) FILTER (NOT one AND parse_valid) AS p2,
      count(*) FILTER (NOT one AND execution_success) AS x2, count(DISTINCT h) AS u FROM a),
    v AS (SELECT count(*) FILTER (early) AS early, count(*) FILTER (ever AND NOT coalesce(early, false)) AS gained,
      count(*) FILTER (ever) AS ever FROM e)
    SELECT q.n AS requested_examples, n1 AS attempt1_generated, n2 AS retry_generated,
      round(p1 / n1, 4) AS attempt1_parse_valid_rate, round(s1 / n1, 4) AS attempt1_safe_rate,
      round(x1 / n1, 4) AS attempt1_execution_success_rate, early AS attempt1_verified_example_count,
      round(early / q.n, 4) AS attempt1_verified_example_coverage, round(p2 / n2, 4) AS retry_parse_valid_rate,
      round(x2 / n2, 4) AS retry_execution_success_rate, gained AS retry_incremental_verified_examples,
      round(gained / q.n, 4) AS retry_incremental_coverage, d.n AS duplicate_retry_count,
      round(d.n / n2, 4) AS duplicate_retry_rate, round(u / c.n, 4) AS unique_candidate_sql_ratio,
      ever AS final_verified_example_count, round(ever / q.n, 4) AS final_verified_example_coverage FROM c, v, d, q""",
    "candidates conversation_examples",
)
def attempt_metrics(t: Tables):
    """First attempts against retries."""
    hashed = t.adapted("candidates").withColumn(
        "normalized_sql_hash", F.sha2(F.lower("candidate_sql"), 256)
    )
    return metrics.attempt_metrics(hashed, t.adapted("conversation_examples"))


@query(
    "failure_buckets",
    """SELECT CASE WHEN NOT parse_valid THEN 'parse_failed' WHEN NOT safe THEN 'unsafe_or_multiple_statements'
      WHEN NOT execution_success THEN 'execution_failed' WHEN NOT execution_equivalent THEN 'wrong_result'
      ELSE 'verified' END AS reason, count(*) AS n FROM candidates GROUP BY 1""",
    "candidates",
)
def failure_buckets(t: Tables):
    """Why candidates failed."""
    return metrics.failure_counts(t.adapted("candidates"))


@query(
    "generation_metrics",
    f"""{SCORED}, g AS (SELECT group_id, stddev_pop(total_reward) AS std FROM w GROUP BY 1)
    SELECT count(*) AS completions, 0::BIGINT AS reward_none_count,
      round(avg(format_ok::INT), 4) AS format_valid_rate, round(avg((sql IS NOT NULL)::INT), 4) AS parse_valid_rate,
      round(avg(ran::INT), 4) AS safe_rate, round(avg((ran AND success)::INT), 4) AS execution_success_rate,
      round(avg((ran AND strict)::INT), 4) AS strict_correct_rate,
      round(avg(ends_with(rtrim(raw, chr(10) || ' '), '</sql>')::INT), 4) AS stop_at_sql_close_rate,
      0.0::DOUBLE AS truncation_rate, round(avg(length(raw)), 2) AS mean_completion_tokens,
      round(avg((length(lower(raw)) - length(replace(lower(raw), '<sql>', '')) > 5)::INT), 4) AS multiple_sql_block_rate,
      round(count(*) FILTER (NOT format_ok AND fallback IS NOT NULL) / count(*) FILTER (NOT format_ok), 4)
        AS format_invalid_but_sql_extractable_rate,
      (SELECT count(*) FROM g) AS "groups", (SELECT count(*) FROM g WHERE std > 1e-9) AS nonzero_reward_std_group_count,
      round(count(DISTINCT raw) / count(*), 4) AS raw_completion_unique_ratio,
      round((count(DISTINCT run_sql) + max((run_sql IS NULL)::INT)) / count(*), 4) AS normalized_sql_unique_ratio,
      round((SELECT count(*) FILTER (std > 1e-9) / count(*) FROM g), 4) AS nonzero_reward_std_group_fraction FROM w""",
    "completions",
)
def generation_metrics(t: Tables):
    """Uniqueness, validity and reward spread of diagnostic completions."""
    ran = F.coalesce("safety.safe", F.lit(False))
    samples = _scored(t).select(
        "group_id",
        F.col("raw").alias("raw_completion"),
        F.col("parse.format_ok").alias("strict_format_valid"),
        F.col("parse.sql").alias("strict_parsed_sql"),
        F.col("fallback_sql").alias("diagnostic_fallback_sql"),
        F.col("fallback_sql").isNotNull().alias("fallback_parse_valid"),
        ran.alias("safe"),
        (ran & F.col("success")).alias("execution_success"),
        (ran & F.col("strict_equivalent")).alias("strict_equivalent"),
        "total_reward",
        scoring.stop_reason(F.col("raw")).alias("stop_reason"),
        F.length("raw").alias("completion_tokens"),
    )
    return metrics.generation_metrics(samples)

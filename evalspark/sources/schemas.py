"""Record schemas."""

from __future__ import annotations

# The split names and id shapes of the data model.
SPLITS = ["calibration", "dev", "formal_validation", "test", "train", "validation_tuning"]
TRAINING_SPLITS = ["train"]
CALIBRATION_SPLITS = ["train", "calibration"]
EVALUATION_SPLITS = ["dev", "test", "validation_tuning", "formal_validation"]
FORBIDDEN_TRAINING_SPLITS = ["validation_tuning", "formal_validation"]
DB_ID_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"
EXAMPLE_ID_SHAPE = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"

EXAMPLE = (
    "example_id string, db_id string, question string, schema_text string, gold_sql string, "
    "split string, source string, source_version string, evidence string"
)
CANDIDATE = (
    "example_id string, teacher_model string, teacher_model_revision string, "
    "teacher_prompt_version string, candidate_index int, raw_candidate_output string, "
    "candidate_sql string, candidate_plan string, parse_valid boolean, safe boolean, "
    "execution_success boolean, execution_equivalent boolean, "
    "generation_config map<string,string>, created_at string, attempt_index int, "
    "generation_seed decimal(20,0), normalized_sql_hash string, safety_error_type string, "
    "execution_error_type string, execution_error_message_sanitized string, "
    "verification_kind string, retry_reason string"
)
RESULT = (
    "example_id string, candidate_index int, success boolean, rows array<array<variant>>, "
    "columns array<string>, error_type string, error_message string, duration_ms double, "
    "timed_out boolean, row_count int, truncated boolean"
)
RAW_SOURCE = (
    "db_id string, question string, evidence string, SQL string, gold_sql string, "
    "question_id string, difficulty string"
)
REWARD_SAMPLE = (
    "timestamp string, run_id string, optimizer_step bigint, generation_group_id string, "
    "completion_index int, example_id string, db_id string, reward double, "
    "format_reward double, parse_reward double, safety_reward double, "
    "execution_reward double, correctness_reward double, parse_ok boolean, safe boolean, "
    "execution_success boolean, strict_equivalent boolean, partial_credit boolean, "
    "error_type string, candidate_row_count bigint, gold_row_count bigint"
)

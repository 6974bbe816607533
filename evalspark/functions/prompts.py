"""Prompt and training-target text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions import outline
from evalspark.functions.binding import bind
from evalspark.functions.screening import drop_comments, source_tables

# The protocol texts models were trained on.
PROTOCOL_PLAN = """Answer in the following format only.

<plan>
tables: ...
joins: ...
filters: ...
grouping: ...
ordering: ...
</plan>
<sql>
SELECT ...
</sql>"""
PROTOCOL_SQL = """Answer in the following format only.

<sql>
SELECT ...
</sql>"""
PROTOCOL_STRICT = """Target dialect is SQLite.

Return exactly ONE read-only SQL statement.
Only SELECT or WITH ... SELECT.

Return exactly the columns requested by the question.
Do not add extra result/debug columns.
Use the supplied Evidence as authoritative schema/value guidance.
Do not invent tables or columns.

For SQLite date handling:
avoid EXTRACT().
Use SQLite-compatible expressions such as
strftime() / substr() when appropriate.

Never output multiple SQL statements.

Output exactly:

<sql>
...
</sql>"""
STRICT_VERSION = "bird-v2"
SCHEMA_PLACEHOLDER = "(schema truncated to fit budget)"

# What a retry prompt says about the failed attempt.
FEEDBACK_UNSAFE = (
    "Previous answer violated the single read-only SQLite statement constraint. "
    "Return exactly one SELECT/CTE."
)
FEEDBACK_PARSE = (
    "The previous answer did not contain a parseable <sql> block. "
    "Return exactly one SQL statement inside <sql>...</sql>."
)
FEEDBACK_WRONG = (
    "The previous query executed successfully but did not match the expected result. "
    "Re-check the requested columns, Evidence, joins, filters, grouping and aggregation."
)


def protocol_text(include_plan: bool, version: str = "bird-v1") -> str:
    if version == STRICT_VERSION:
        return PROTOCOL_STRICT
    return PROTOCOL_PLAN if include_plan else PROTOCOL_SQL


def build_prompt(
    question: Column,
    schema_text: Column,
    db_id: Column,
    evidence: Column,
    include_plan: bool = True,
    version: str = "bird-v1",
    dialect: str = "SQLite",
) -> Column:
    header = F.concat(
        F.lit(f"Translate the following question into one {dialect} SQL query for the database '"),
        db_id,
        F.lit("'."),
    )
    return F.concat_ws(
        "\n\n",
        header,
        F.concat(F.lit("Database schema:\n"), schema_text),
        F.concat(F.lit("Question: "), question),
        F.when(evidence != "", F.concat(F.lit("Evidence: "), evidence)),
        F.lit(protocol_text(include_plan, version)),
    )


def failure_reason(
    parse_valid: Column, sql: Column, safe: Column, success: Column, equivalent: Column
) -> Column:
    def missing(flag: Column) -> Column:
        return ~F.coalesce(flag, F.lit(False))

    return (
        F.when(missing(parse_valid) | (F.coalesce(sql, F.lit("")) == ""), "parse_failed")
        .when(missing(safe), "unsafe_or_multiple_statements")
        .when(missing(success), "execution_failed")
        .when(missing(equivalent), "wrong_result")
        .otherwise("verified")
    )


def retry_feedback(reason: Column, error_message: Column, error_type: Column) -> Column:
    category = F.coalesce(
        F.when(error_message != "", error_message), F.when(error_type != "", error_type)
    )
    told = F.concat(
        F.lit("Previous query failed with SQLite error category: "), category, F.lit(".")
    )
    return (
        F.when(reason == "unsafe_or_multiple_statements", FEEDBACK_UNSAFE)
        .when(reason == "execution_failed", F.coalesce(told, F.lit(FEEDBACK_PARSE)))
        .when(reason == "parse_failed", FEEDBACK_PARSE)
        .otherwise(FEEDBACK_WRONG)
    )


def retry_prompt(prompt: Column, feedback: Column) -> Column:
    return F.concat_ws("\n\n", prompt, F.when(feedback != "", feedback))


def sql_features(sql: Column) -> Column:
    """What a query uses, read off its tokens: tables, joins and clause texts.

    A clause's text ends at its own depth, so subqueries, calls and lists inside it are kept
    whole. Of nested clauses of one kind the outermost counts, of equal ones the first; joins
    count at every depth. Literals are kept as they are, comments are not, other white space is one
    space.
    """

    def features(tokens: Column) -> Column:
        return F.struct(
            source_tables(sql).alias("tables"),
            outline.joins(tokens).alias("joins"),
            outline.filters(tokens).alias("filters"),
            outline.grouping(tokens).alias("grouping"),
            outline.ordering(tokens).alias("ordering"),
        )

    return bind(outline.outline(drop_comments(sql)), features)


# How much of each clause a plan shows.
_JOIN_CHARS, _FILTER_CHARS, _GROUP_CHARS, _ORDER_CHARS = 80, 120, 80, 80


def plan_text(sql: Column) -> Column:
    """The plan block's lines; clauses the query lacks are left out."""
    parts = sql_features(sql)

    def line(name: str, value: Column, limit: int) -> Column:
        return F.concat(F.lit(f"{name}: "), F.substring(value, 1, limit))

    joins = F.array_join(
        F.transform(parts["joins"], lambda j: F.substring(j, 1, _JOIN_CHARS)), " | "
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("tables: "), F.array_join(parts["tables"], ", ")),
        F.when(joins != "", F.concat(F.lit("joins: "), joins)),
        line("filters", parts["filters"], _FILTER_CHARS),
        line("grouping", parts["grouping"], _GROUP_CHARS),
        line("ordering", parts["ordering"], _ORDER_CHARS),
    )


def target_text(sql: Column, include_plan: bool = False) -> Column:
    block = F.concat(F.lit("<sql>\n"), sql, F.lit("\n</sql>"))
    if not include_plan:
        return block
    return F.concat(F.lit("<plan>\n"), plan_text(sql), F.lit("\n</plan>\n"), block)

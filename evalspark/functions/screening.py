"""Classifying SQL text.

These are token-level rules over text whose literals and comments are blanked. They
are weaker than a parse: of the syntax errors they find a bad first keyword, an open quote, a
statement that stops after a clause keyword, and words out of place at any depth of
parentheses (``outline.misplaced``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions import outline
from evalspark.functions.binding import bind
from evalspark.functions.text import strip

_LITERAL = r"'[^']*'"
_COMMENT = r"--[^\n]*|/\*[\s\S]*?\*/"
_QUOTED_NAME = r'"[^"]*"|`[^`]*`|\[[^\]]*\]'

# Statements that change or administer a database.
WRITE_VERBS = [
    "alter", "analyze", "attach", "begin", "call", "commit", "copy", "create", "delete",
    "describe", "detach", "drop", "end", "exec", "execute", "explain", "grant", "insert",
    "load", "merge", "pragma", "reindex", "release", "replace", "revoke", "rollback",
    "savepoint", "set", "show", "truncate", "update", "use", "vacuum", "values",
]
_WRITE_INSIDE = (
    r"\b(insert\s+(or\s+\w+\s+)?into|replace\s+into|delete\s+from|update\s+\w+\s+set|merge\s+into)\b"
)
# Calls that run code outside the query.
_LOADS = r"\b(load_extension|java_method|reflect|try_reflect)\s*\("
# Script transformations, and files named as tables; literals and quoted names are ``_`` here.
_SCRIPT = r"\b(transform|map|reduce)\b[^;]*\busing\s+_"
_FILE = r"\b(from|join)\s+(text|csv|json|parquet|orc|avro|xml|binaryfile)\s*\.\s*_"
_CTE_HEAD = r"^with\s+(recursive\s+)?\w+\s*(\([^)]*\)\s*)?as\s+((not\s+)?materialized\s+)?\("
_DANGLING = r"\b(select|from|where|join|on|and|or|by|having|limit|union|all|in)\s*$|,\s*$"
_TAG_LEFT = r"<\s*/|<\s*(sql|plan)\s*>"
_PART = r"(?:\w+|\"[^\"]+\"|`[^`]+`|\[[^\]]+\])"
_NAME = rf"{_PART}(?:\s*\.\s*{_PART})*"
_ALIAS = (
    r"(?:(?:\s+as)?\s+(?!(?:join|on|using|where|group|order|having|limit|union|left|right|full"
    r"|inner|cross|natural)\b)\w+)?"
)
_ITEM = _NAME + _ALIAS
_TABLE_REF = rf"(?i)\b(?:from|join)\s+({_ITEM}(?:\s*,\s*{_ITEM})*)"


def drop_comments(sql: Column) -> Column:
    """One space for each comment; what is quoted stays as it is."""
    quoted = f"({_QUOTED_NAME}|{_LITERAL})"
    marked = F.regexp_replace(sql, f"{quoted}|{_COMMENT}", "$1\u0001")
    return F.replace(F.regexp_replace(marked, f"{quoted}\u0001", "$1"), F.lit("\u0001"), F.lit(" "))


def blank_literals(sql: Column) -> Column:
    """Drop string literals and comments, keep quoted names."""
    return F.regexp_replace(sql, f"({_QUOTED_NAME})|{_LITERAL}|{_COMMENT}", " $1 ")


def blank_all(sql: Column) -> Column:
    """Drop comments and put ``_`` for literals and quoted names."""
    return F.regexp_replace(drop_comments(sql), f"{_QUOTED_NAME}|{_LITERAL}", " _ ")


def _statements(blanked: Column) -> Column:
    return F.filter(F.split(blanked, ";"), lambda part: F.trim(part).rlike(r"\S"))


def screen(sql: Column) -> Column:
    """The safety class of SQL text; null where there is no SQL.

    A struct of ``safe``, ``error_type``, ``statement_count``, ``top_level_key`` and
    ``forbidden``.
    """
    return F.when(sql.isNotNull(), bind(strip(sql), _screen_text))


def _bad_syntax(statement: Column) -> Column:
    return (
        statement.contains("'")
        | statement.rlike(_DANGLING)
        | statement.rlike(_TAG_LEFT)
        | outline.misplaced(statement)
    )


def _screen_text(text: Column) -> Column:
    def cut(blanked: Column) -> Column:
        statement = F.regexp_replace(blanked, r"^[\s;]+|[\s;]+$", "")
        return F.struct(
            (text == "").alias("empty"),
            F.size(_statements(blanked)).alias("count"),
            statement.alias("statement"),
        )

    def tokens(parts: Column) -> Column:
        statement = parts["statement"]
        # A parenthesised query counts as the query.
        opened = F.regexp_replace(statement, r"^[\s(]+", "")
        verb = F.regexp_extract(opened, r"^([a-z]+)", 1)
        return F.struct(
            parts["empty"].alias("empty"),
            parts["count"].alias("count"),
            verb.alias("verb"),
            ((verb == "select") | opened.rlike(_CTE_HEAD)).alias("reads"),
            statement.rlike(_WRITE_INSIDE).alias("writes"),
            F.regexp_extract(statement, _LOADS, 1).alias("call"),
            (statement.rlike(_SCRIPT) | statement.rlike(_FILE)).alias("outside"),
            statement.alias("statement"),
        )

    def classify(t: Column) -> Column:
        known = t["reads"] | t["verb"].isin(WRITE_VERBS)
        error = (
            F.when(t["empty"], "format_error")
            .when((t["count"] == 0) | ~known, "syntax_error")
            .when((t["count"] > 1) | ~t["reads"] | t["writes"] | t["outside"], "unsafe_sql")
            .when(_bad_syntax(t["statement"]), "syntax_error")
            .when(t["call"] != "", "unsafe_sql")
            .otherwise("none")
        )
        return F.struct(error.alias("error"), t.alias("t"))

    def decide(c: Column) -> Column:
        error, t = c["error"], c["t"]
        forbidden = F.array_compact(
            F.array(
                F.when(~t["reads"], t["verb"]),
                F.when(t["call"] != "", F.concat(F.lit("function:"), t["call"])),
                F.when(t["outside"], "outside"),
                F.when(t["reads"] & t["writes"], "write"),
            )
        )
        none = F.array().cast("array<string>")
        single = t["count"] == 1
        return F.struct(
            (error == "none").alias("safe"),
            error.alias("error_type"),
            F.when(error == "syntax_error", -1).otherwise(t["count"]).alias("statement_count"),
            F.when(single, t["verb"]).otherwise("").alias("top_level_key"),
            F.when((error == "unsafe_sql") & single, forbidden).otherwise(none).alias("forbidden"),
        )

    parts = bind(F.lower(blank_all(text)), cut)
    return bind(bind(bind(parts, tokens), classify), decide)


def has_order_by(sql: Column) -> Column:
    """ORDER BY anywhere, so also inside a subquery or a window."""
    found = F.lower(blank_all(sql)).rlike(r"\border\s+by\b")
    return F.coalesce(found, F.lit(False))


def outer_order_by(sql: Column) -> Column:
    """ORDER BY of the outermost query only: outside all parentheses, however deep."""
    tokens = F.regexp_extract_all(F.lower(blank_all(sql)), F.lit(r"[()]|[^()]+"), F.lit(0))

    def step(seen: Column, token: Column) -> Column:
        depth, text = seen["depth"], seen["text"]
        opened = F.when(token == "(", depth + 1).when(token == ")", F.greatest(depth - 1, F.lit(0)))
        outside = (depth == 0) & ~token.isin("(", ")")
        return F.struct(
            opened.otherwise(depth).alias("depth"),
            F.when(outside, F.concat(text, F.lit(" "), token)).otherwise(text).alias("text"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("text"))
    text = F.aggregate(tokens, start, step, lambda seen: seen["text"])
    return F.coalesce(text.rlike(r"\border\s+by\b"), F.lit(False))


def source_tables(sql: Column) -> Column:
    """Distinct names after FROM or JOIN, sorted; empty when there is none."""
    lists = F.regexp_extract_all(blank_literals(F.coalesce(sql, F.lit(""))), F.lit(_TABLE_REF), 1)
    items = F.flatten(F.transform(lists, lambda refs: F.split(refs, r"\s*,\s*")))
    # Of a qualified name the last part is the table.
    last = rf"^(?:{_PART}\s*\.\s*)*({_PART})"
    names = F.transform(
        items,
        lambda ref: F.regexp_replace(F.regexp_extract(F.trim(ref), last, 1), r'["`\[\]]', ""),
    )
    return F.array_sort(F.array_distinct(names))


# The message parts a sanitized error is reduced to, in this order.
ERROR_CATEGORIES = [
    "no such column",
    "no such table",
    "no such function",
    "ambiguous column",
    "no such database",
    "syntax error",
    "misuse",
    "table has no column",
]


def sanitize_error(message: Column, length: int = 160) -> Column:
    """The message's category, or without one its first ``length`` characters."""
    text = F.coalesce(message, F.lit(""))
    lowered = F.lower(text)
    found = F.coalesce(*[F.when(lowered.contains(c), F.lit(c)) for c in ERROR_CATEGORIES])
    return F.coalesce(found, F.substring(strip(text), 1, length))


# Error message keyword and the bucket it stands for, first match wins.
ERROR_KEYWORDS = [
    ("no such table", "wrong_table"),
    ("no such column", "wrong_column"),
    ("misuse of aggregate", "aggregation_error"),
    ("group by", "group_by_error"),
    ("order by", "order_error"),
    ("ambiguous", "join_error"),
    ("join", "join_error"),
    ("where", "filter_error"),
]


def message_bucket(message: Column) -> Column:
    lowered = F.lower(F.coalesce(message, F.lit("")))
    hits = [F.when(lowered.contains(word), F.lit(bucket)) for word, bucket in ERROR_KEYWORDS]
    return F.coalesce(*hits, F.lit("schema_error"))

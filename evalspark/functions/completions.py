"""Extracting the SQL block from a model's completion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.binding import bind
from evalspark.functions.screening import screen
from evalspark.functions.text import strip

_SQL_OPEN = r"(?i)<\s*sql\b[^>]*>"
_SQL_CLOSE = r"(?i)<\s*/\s*sql\s*>"
_PLAN_OPEN = r"(?i)<\s*plan\b[^>]*>"
_PLAN_CLOSE = r"(?i)<\s*/\s*plan\s*>"
_SQL_BLOCK = r"(?is)<\s*sql\b[^>]*>(.*?)<\s*/\s*sql\s*>"
_PLAN_BLOCK = r"(?is)<\s*plan\b[^>]*>(.*?)<\s*/\s*plan\s*>"
_BARE_BLOCK = r"(?is)<\s*sql\s*>(.*?)<\s*/\s*sql\s*>"
_FENCE = r"(?ismd)^[ \t]*```(?:sql)?[ \t]*\n(.*?)^[ \t]*```[ \t]*$"
_SQL_START = r"(?isU)\b(?:select|with)\b.*$"
_WRAPPED = r"(?is)^```(?:sql)?[ \t]*\n(.*)```$"


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def parse_completion(text: Column, require_plan: bool = False) -> Column:
    """A struct of ``sql``, ``plan``, ``format_ok``, ``parse_error``, ``warnings``, ``protocol``.

    A second or unbalanced block counts as an attempt to hide SQL and yields none.
    """

    def find(raw: Column) -> Column:
        return F.struct(
            raw.alias("raw"),
            _count(raw, _SQL_OPEN).alias("sql_open"),
            _count(raw, _SQL_CLOSE).alias("sql_close"),
            _count(raw, _PLAN_OPEN).alias("plan_open"),
            _count(raw, _PLAN_CLOSE).alias("plan_close"),
            strip(F.regexp_extract(raw, _PLAN_BLOCK, 1)).alias("plan"),
            F.regexp_extract(raw, _SQL_BLOCK, 1).alias("inside"),
        )

    def unwrap(f: Column) -> Column:
        tagged = (f["sql_open"] + f["sql_close"]) > 0
        return F.struct(
            f.alias("f"),
            tagged.alias("tagged"),
            strip(f["inside"]).alias("inner"),
            F.when(~tagged, F.regexp_extract_all(f["raw"], F.lit(_FENCE), 1)).alias("fences"),
        )

    def judge(u: Column) -> Column:
        f, inner, fences = u["f"], u["inner"], u["fences"]
        wrapped = inner.rlike(_WRAPPED)
        block = F.when(wrapped, strip(F.regexp_extract(inner, _WRAPPED, 1))).otherwise(inner)
        bad = (
            F.when(u["tagged"] & (f["sql_open"] != f["sql_close"]), "unbalanced <sql> tags")
            .when(u["tagged"] & (f["plan_open"] != f["plan_close"]), "unbalanced <plan> tags")
            .when(u["tagged"] & (f["sql_open"] > 1), "duplicate <sql> tags")
            .when(u["tagged"] & (f["inside"] == ""), "empty or inverted <sql> block")
            .when(u["tagged"] & (block == ""), "<sql> block is empty")
            .when(F.size(fences) > 1, "multiple SQL fences")
            .when(F.size(fences) == 0, "no <sql> block and no SQL fence")
        )
        sql = F.when(u["tagged"], block).otherwise(strip(F.get(fences, F.lit(0))))
        return F.struct(
            u.alias("u"),
            bad.alias("bad"),
            F.when(sql != "", sql).alias("sql"),
            wrapped.alias("wrapped"),
            F.when(f["plan_open"] > 0, f["plan"]).alias("plan"),
            (strip(F.regexp_replace(f["raw"], _SQL_BLOCK, "")) != "").alias("prose"),
        )

    def assemble(j: Column) -> Column:
        tagged, usable = j["u"]["tagged"], j["bad"].isNull()
        no_plan = F.lit(require_plan) & (F.coalesce(j["plan"], F.lit("")) == "")
        error = F.coalesce(
            j["bad"],
            F.when(~tagged, "missing <sql> tags, SQL taken from a fence"),
            F.when(no_plan, "<plan> is required but missing"),
        )
        good = usable & tagged & ~no_plan
        plans = j["u"]["f"]["plan_open"]
        warnings = F.array_compact(
            F.array(
                F.when(tagged & usable & j["wrapped"], "fence inside the <sql> block"),
                F.when(tagged & usable & (plans > 1), "duplicate <plan> blocks"),
                F.when(good & j["prose"], "text outside the <sql> block"),
                F.when(~tagged & usable, "fence instead of <sql> tags"),
            )
        )
        return F.struct(
            F.when(usable, j["sql"]).alias("sql"),
            F.when(good, j["plan"]).alias("plan"),
            good.alias("format_ok"),
            error.alias("parse_error"),
            warnings.alias("warnings"),
            F.when(tagged, "tags")
            .when(F.size(j["u"]["fences"]) > 0, "fence")
            .otherwise("none")
            .alias("protocol"),
        )

    found = bind(unix_newlines(text), find)
    return bind(bind(bind(found, unwrap), judge), assemble)


def _single_select(sql: Column) -> Column:
    """The text if it is exactly one SELECT or WITH statement, whatever it calls."""

    def keep(s: Column) -> Column:
        def check(kind: Column) -> Column:
            single = (kind["statement_count"] == 1) & kind["top_level_key"].isin("select", "with")
            written = F.array_contains(kind["forbidden"], "write")
            return F.when(kind["safe"] | (single & ~written), s)

        return bind(screen(s), check)

    return bind(strip(sql), keep)


def _no_second_statement(sql: Column) -> Column:
    return F.when((sql != "") & ~sql.rlike(r";\s*\S"), sql)


def fallback_sql(text: Column) -> Column:
    """One read-only statement of a completion that broke the protocol, else null.

    Tried in turn: the whole text, its only complete block, its tail from the first
    SELECT or WITH.
    """

    def only_block(blocks: Column) -> Column:
        return F.when(F.size(blocks) == 1, _no_second_statement(strip(F.get(blocks, F.lit(0)))))

    blocks = F.regexp_extract_all(text, F.lit(_BARE_BLOCK), 1)
    tail = bind(strip(F.regexp_extract(text, _SQL_START, 0)), _no_second_statement)
    return F.coalesce(
        _single_select(text), _single_select(bind(blocks, only_block)), _single_select(tail)
    )


def stop_reason(text: Column) -> Column:
    """Whether the completion ends with the closing tag."""
    closed = F.regexp_replace(text, r"\s+$", "").endswith("</sql>")
    return F.when(closed, "sql_close").otherwise("max_tokens_or_eos")


def sql_block_count(text: Column) -> Column:
    lowered = F.lower(text)
    return F.regexp_count(lowered, F.lit("<sql>"))

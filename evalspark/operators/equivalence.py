"""Deciding whether two query results are the same, for a whole batch at once.

Runs (one row per executed query): ``example_id, candidate_index, sql, success, columns,
error_type, error_message, row_count, truncated``. Gold runs lack ``candidate_index``.
Rows (one per result row): ``example_id, candidate_index, row_idx, cells`` where a cell is
``struct<tag, num, str>``; gold rows again lack ``candidate_index``.

Two tolerances exist on purpose. Unordered results are compared as multisets of rows with
numbers rounded to an absolute step. Ordered results are compared row by row with a
tolerance relative to the larger number. NaN equals NaN and infinity itself in both.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.screening import has_order_by, source_tables
from evalspark.session import materialize

TOLERANCE = 1e-6

_NUMERIC = (T.NumericType,)


def cell(value: Column, data_type: T.DataType) -> Column:
    """One value as a cell; ``data_type`` is its static type."""
    text = value.cast("string")
    if isinstance(data_type, T.BooleanType):
        tag, num = "bool", F.lit(None).cast("double")
    elif isinstance(data_type, _NUMERIC):
        tag, num = "num", value.cast("double")
    elif isinstance(data_type, T.BinaryType):
        # Bytes that are no UTF-8 text are compared as bytes.
        num, valid = F.lit(None).cast("double"), F.is_valid_utf8(text)
        tag, text = F.when(valid, "str").otherwise("bytes"), F.when(valid, text).otherwise(F.hex(value))
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        tag, num, text = "other", F.lit(None).cast("double"), F.to_json(value)
    else:
        tag, num = "str", F.lit(None).cast("double")
    return F.struct(
        F.when(value.isNull(), "null").otherwise(tag).alias("tag"),
        num.alias("num"),
        text.alias("str"),
    )


def cells(df: DataFrame, columns: list[str]) -> Column:
    """All result columns of a frame as one array of cells."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.array(*[cell(F.col(f"`{c}`"), types[c]) for c in columns])


def cell_from_variant(value: Column) -> Column:
    """A cell from a JSON value of a result log."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    tag = (
        F.when(value.isNull() | (kind == "VOID"), "null")
        .when(kind == "BOOLEAN", "bool")
        .when(numeric, "num")
        .when(kind == "STRING", "str")
        .otherwise("other")
    )
    return F.struct(
        tag.alias("tag"),
        F.when(numeric, F.try_variant_get(value, "$", "double")).alias("num"),
        F.when(tag == "other", F.to_json(value)).otherwise(text).alias("str"),
    )


def rows_from_results(results: DataFrame) -> DataFrame:
    """Long result rows from logged results with ``rows array<array<variant>>``."""
    keys = [c for c in ("example_id", "candidate_index") if c in results.columns]
    exploded = results.select(*keys, F.posexplode("rows").alias("row_idx", "_row"))
    return exploded.select(
        *keys,
        F.col("row_idx").cast("bigint").alias("row_idx"),
        F.transform("_row", cell_from_variant).alias("cells"),
    )


def _digits(tolerance: float) -> int | None:
    """Decimal places numbers are rounded to; none at tolerance zero."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    return -Decimal(str(tolerance)).as_tuple().exponent if tolerance > 0 else None


# Below this many steps a double's product is off by far less than _TIE_GAP from a tie.
_SAFE_STEPS = float(2**44)
_TIE_GAP = 0.49
# A double from here on is a whole number.
_WHOLE = float(2**53)
_PLAIN = r"^(-?\d+)(?:\.(\d+))?$"
# The most decimal places that are looked at.
_PLACES = 18


def _number_text(c: Column, tolerance: float) -> Column:
    """A number as a count of tolerance steps, halves going to the even one.

    Rounding is defined on the number's decimal text. Where the double is clearly not
    half-way between two steps it gives the same count, and decimals can be spared.
    """
    digits = _digits(tolerance)
    as_double = c["num"].cast("string")
    # Numbers with more integer digits than a decimal of many places holds keep their own text.
    long_double = F.when(F.abs(c["num"]) >= _WHOLE, c["str"].try_cast("decimal(38,0)"))
    plain = F.when(c["str"].rlike(_PLAIN), c["str"]).otherwise(long_double.cast("string"))
    whole = F.regexp_extract(plain, _PLAIN, 1)
    part = F.regexp_replace(F.regexp_extract(plain, _PLAIN, 2), "0+$", "")
    if digits is None:
        exact = c["str"].try_cast(f"decimal(38,{_PLACES})").cast("string")
        own = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
        return F.coalesce(exact, own, as_double)
    steps = c["num"] * float(10**digits)
    nearest = F.rint(steps)
    clear = (F.abs(steps) < _SAFE_STEPS) & (F.abs(steps - nearest) < _TIE_GAP)
    # Without more places than a step has there is nothing to round. Otherwise the largest
    # scale that holds the number's integer digits holds its places too.
    short = F.when(F.length(part) <= digits, F.concat(whole, F.rpad(part, digits, "0")))
    rounded = [
        F.bround(c["str"].try_cast(f"decimal(38,{scale})"), digits).cast(f"decimal(38,{digits})")
        for scale in range(_PLACES, digits, -1) or [_PLACES]
    ]
    texts = [F.replace(r.cast("string"), F.lit(".")) for r in rounded]
    counted = F.regexp_replace(F.coalesce(short, *texts), r"^(-?)0+(?=\d)", "$1")
    # For NaN, the infinities and what no decimal holds the double itself decides.
    return F.when(clear, nearest.cast("bigint").cast("string")).otherwise(
        F.coalesce(counted, as_double)
    )


def normalize_cell(c: Column, tolerance: float = TOLERANCE) -> Column:
    """Text that is equal for two cells exactly if they count as the same value."""
    value = F.when(c["tag"] == "num", _number_text(c, tolerance)).otherwise(c["str"])
    return F.when(c["tag"] == "null", F.lit("null")).otherwise(F.concat(c["tag"], F.lit(":"), value))


def _row_digest(row: Column, tolerance: float) -> Column:
    """Hexadecimal digest of a normalized row. Lengths keep the cells' texts apart."""
    parts = F.transform(row, lambda c: normalize_cell(c, tolerance))
    framed = F.transform(parts, lambda p: F.concat(F.length(p).cast("string"), F.lit(":"), p))
    return F.sha2(F.array_join(framed, ""), 256)


def values_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """The ordered comparison of two cells."""
    _digits(tolerance)
    x, y = a["num"], b["num"]
    scale = F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
    # "=" holds for NaN with NaN and for equal infinities; scale would be NaN or infinite.
    close = (x == y) | (
        (F.abs(x) < float("inf"))
        & (F.abs(y) < float("inf"))
        & (F.abs(x - y) <= F.lit(tolerance) * scale)
    )
    both_null = (a["tag"] == "null") & (b["tag"] == "null")
    numbers = (a["tag"] == "num") & (b["tag"] == "num")
    same = (a["tag"] == b["tag"]) & (a["str"] == b["str"])
    return F.when(both_null, True).when(numbers, close).otherwise(F.coalesce(same, F.lit(False)))


# Hashes of a row's digest, and the two 24-bit parts of each that are added up: sums of
# 144 bits in all, which 2^39 rows do not overflow.
_HASHES = 3
_PART_BITS = 24


def _summaries(rows: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """One line per result: its ``size`` and a digest of ``sums`` over its rows, equal for equal multisets.

    All of it is added up on the map side, so a long result costs no more than a short one
    in the shuffle, and no key is hot. The digest takes 16 bytes when lines meet gold's.
    """
    digests = rows.select(*keys, _row_digest(F.col("cells"), tolerance).alias("_digest"))
    hashes = digests.select(
        *keys, *[F.xxhash64("_digest", F.lit(i)).alias(f"_h{i}") for i in range(_HASHES)]
    )
    mask = F.lit(2**_PART_BITS - 1)
    parts = [
        F.sum(F.shiftright(f"_h{i}", shift).bitwiseAND(mask))
        for i in range(_HASHES)
        for shift in (0, _PART_BITS)
    ]
    sums = F.sha2(F.concat_ws(",", *[p.cast("string") for p in parts]), 256)
    return hashes.groupBy(*keys).agg(
        F.count("*").alias("size"), F.substring(F.unhex(sums), 1, 16).alias("sums")
    )


def unordered_matches(
    candidate_rows: DataFrame, gold_rows: DataFrame, tolerance: float = TOLERANCE
) -> DataFrame:
    """``example_id, candidate_index, rows_match`` by comparing multisets of rows."""
    mine = _summaries(candidate_rows, ["example_id", "candidate_index"], tolerance)
    gold = _summaries(gold_rows, ["example_id"], tolerance).select(
        "example_id", F.col("size").alias("_gold_size"), F.col("sums").alias("_gold_sums")
    )
    same = (F.col("size") == F.col("_gold_size")) & (F.col("sums") == F.col("_gold_sums"))
    return mine.join(gold, "example_id", "left").select(
        "example_id", "candidate_index", F.coalesce(same, F.lit(False)).alias("rows_match")
    )


def ordered_mismatches(
    candidate_rows: DataFrame, gold_rows: DataFrame, tolerance: float = TOLERANCE
) -> DataFrame:
    """Per candidate its first cell that differs from gold: ``bad_row, bad_col``, or nulls.

    Row counts must agree already; a row without counterpart differs at column 0. Rows are
    numbered from 0 without gaps, so a place is met by one row per candidate. Rows that lie
    together by example stay there; others are moved by example and row number, once.
    """
    # Under names of their own the ids are the same column of both sides to Spark, and what lies
    # together by them stays so in the union.
    keys = [F.col("example_id").alias("_example"), F.col("row_idx").alias("_row")]
    # Null keys meet none. They are no filter, with which gold's read would be another than for other uses.
    has_place = F.col("example_id").isNotNull() & F.col("row_idx").isNotNull()
    of_gold = gold_rows.select(
        *keys, F.lit(None).alias("candidate_index"), "cells", has_place.alias("_is_gold"), F.lit(False).alias("_is_mine")
    )
    mine = candidate_rows.select(
        *keys, "candidate_index", "cells", F.lit(False).alias("_is_gold"), F.lit(True).alias("_is_mine")
    )
    there = F.collect_list(F.when(F.col("_is_gold"), F.struct("cells"))).over(Window.partitionBy("_example", "_row"))
    met = mine.unionByName(of_gold).withColumn("_gold", there).filter("_is_mine")

    def first_difference(gold: Column) -> Column:
        equal = F.zip_with("cells", gold, lambda a, b: values_equal(a, b, tolerance))
        return F.when(gold.isNull(), F.lit(1)).otherwise(F.array_position(equal, False)).cast("bigint")

    # One gold row as a rule; if there are several, the candidate's row must equal all of them.
    differences = F.filter(F.transform("_gold", lambda g: first_difference(g["cells"])), lambda p: p > 0)
    place = F.when(F.size("_gold") == 0, F.lit(1)).otherwise(F.array_min(differences))
    found = met.select("_example", "candidate_index", "_row", place.cast("bigint").alias("_place"))
    bad = F.when(F.col("_place") > 0, F.col("_row"))
    return found.groupBy(F.col("_example").alias("example_id"), "candidate_index").agg(
        F.min(bad).alias("bad_row"), F.min_by(F.col("_place") - 1, bad).alias("bad_col")
    )


def _empty_problems(candidate_sql: Column, tables: Column, gold: Column, known: Column) -> Column:
    """Why two empty results prove nothing; an empty array if the tables make sense."""
    none = F.size(tables) == 0
    foreign = (F.size(gold) > 0) & (F.size(F.array_except(tables, gold)) > 0)
    unknown = F.coalesce(F.size(F.array_except(tables, known)) > 0, F.lit(False)) & ~none
    return F.array_compact(
        F.array(
            F.when(F.coalesce(candidate_sql, F.lit("")) == "", "no candidate SQL"),
            F.when(none, "no source table"),
            F.when(foreign, "tables beyond gold's"),
            F.when(unknown, "unknown tables"),
        )
    )


# Runs whose keys are sent to every task, so that rows of other runs are not hashed.
RUNS_SENT = 200_000


def _rows_of(rows: DataFrame, runs: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The rows of these ``count`` runs; of all runs, if there are too many to send their keys around.

    Rows are summed up before they are shuffled. A join that shuffles them first would cost more
    than to sum up what is not needed.
    """
    if count > RUNS_SENT:
        return rows
    return rows.join(F.broadcast(runs.select(*keys).distinct()), keys, "left_semi")


def _rows_of_examples(rows: DataFrame, runs: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The rows of these ``count`` runs and, if they are many, of other runs of their examples.

    Rows that lie together by example stay where they are. They are not sorted either: the ids
    alone are held, and met by the rows as these are read.
    """
    if count <= RUNS_SENT:
        return _rows_of(rows, runs, keys, count)
    named = runs.select("example_id").distinct()
    return rows.join(named.hint("shuffle_hash"), "example_id", "left_semi")


def verdicts(
    candidate_runs: DataFrame,
    gold_runs: DataFrame,
    candidate_rows: DataFrame,
    gold_rows: DataFrame,
    tolerance: float = TOLERANCE,
    order_rule=has_order_by,
    by_example: bool = False,
) -> DataFrame:
    """One verdict row per candidate run.

    ``gold_runs`` may carry ``schema_tables``, the table names of the example's database.
    ``order_rule`` tells from gold SQL whether order matters; ``has_order_by`` looks
    anywhere in the text, ``screening.outer_order_by`` only at the outermost query.
    ``by_example`` says that all rows and runs come partitioned by ``example_id``. Then no rows
    are moved, and rows of examples that wait for no comparison are dropped before they are
    summed up. It changes no result, but an example's rows are one task's.
    """
    known = (
        F.col("schema_tables")
        if "schema_tables" in gold_runs.columns
        else F.lit(None).cast("array<string>")
    )
    gold = gold_runs.select(
        "example_id",
        F.col("sql").alias("gold_sql"),
        F.col("success").alias("gold_success"),
        F.col("columns").alias("gold_columns"),
        F.col("row_count").alias("gold_row_count"),
        F.col("truncated").alias("gold_truncated"),
        known.alias("schema_tables"),
        order_rule(F.col("sql")).alias("ordered"),
        source_tables(F.col("sql")).alias("gold_tables"),
    )
    gated = candidate_runs.join(gold, "example_id").withColumn(
        "gate",
        F.when(~F.col("gold_success"), "gold_failed")
        .when(~F.col("success"), "candidate_failed")
        .when(F.col("truncated") | F.col("gold_truncated"), "truncated")
        .when(F.size("columns") != F.size("gold_columns"), "column_count")
        .when((F.col("row_count") == 0) & (F.col("gold_row_count") == 0), "both_empty")
        .when(F.col("row_count") != F.col("gold_row_count"), "row_count")
        .when(F.col("ordered"), "ordered")
        .otherwise("unordered"),
    )
    problems = _empty_problems(
        F.col("sql"), source_tables(F.col("sql")), F.col("gold_tables"), F.col("schema_tables")
    )
    keys = ["example_id", "candidate_index"]
    told = gated.select(
        *keys,
        "gate",
        "ordered",
        "error_type",
        "row_count",
        "gold_row_count",
        F.coalesce(F.col("columns") == F.col("gold_columns"), F.lit(False)).alias("column_match"),
        (F.size("columns") == F.size("gold_columns")).alias("column_count_match"),
        F.when(F.col("gate") == "both_empty", problems)
        .otherwise(F.array().cast("array<string>"))
        .alias("problems"),
    )
    # One line per run, needed in three places below; the texts and lists have been read by then.
    runs = materialize(told, "gated-runs")
    # Rows without an example are no run's. Said of all rows, so that all four uses can share one read.
    candidate_rows, gold_rows = (rows.filter("example_id is not null") for rows in (candidate_rows, gold_rows))
    waiting = {r["gate"]: r["n"] for r in runs.groupBy("gate").agg(F.count("*").alias("n")).collect()}
    # Unordered results shrink to one line each before they are shuffled. Ordered ones move
    # their rows, so only those of examples that pass the gates go on; adaptive execution may
    # split these joins, as the comparison shuffles by row anew.
    pending, count = runs.filter(F.col("gate") == "ordered"), waiting.get("ordered", 0)
    places = ordered_mismatches(
        _rows_of_examples(candidate_rows, pending, keys, count),
        _rows_of_examples(gold_rows, pending, ["example_id"], count),
        tolerance,
    ).withColumn("_rows_seen", F.lit(True))
    listed, count = runs.filter(F.col("gate") == "unordered"), waiting.get("unordered", 0)
    chosen = _rows_of_examples if by_example else _rows_of
    # Only matches meet the runs; what is not among them does not match.
    bags = unordered_matches(
        chosen(candidate_rows, listed, keys, count), chosen(gold_rows, listed, ["example_id"], count), tolerance
    ).filter("rows_match")
    # Each run meets the one result that decides it, and takes along what no gate says.
    short = [*keys, "row_count", "gold_row_count", "column_match", "column_count_match"]
    decided = runs.filter(~F.col("gate").isin("ordered", "unordered"))
    in_places = pending.select(*short).join(places, keys, "left").withColumns({"gate": F.lit("ordered"), "ordered": F.lit(True)})
    in_bags = listed.select(*short).join(bags, keys, "left").withColumns({"gate": F.lit("unordered"), "ordered": F.lit(False)})
    judged = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [decided, in_places, in_bags]
    ).withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))
    problems, gate = F.col("problems"), F.col("gate")
    in_order = F.col("_rows_seen") & F.col("bad_row").isNull()
    match = F.coalesce(F.when(gate == "ordered", in_order).otherwise(F.col("rows_match")), F.lit(False))
    strict = gate.isin("ordered", "unordered") & match
    partial = (gate == "both_empty") & (F.size(problems) == 0)
    kind = (
        F.when(gate == "truncated", "truncated_unverified")
        .when(partial, "empty_structural_partial")
        .when(gate == "both_empty", "empty_unverified")
        .when(strict & (gate == "ordered"), "ordered_rows")
        .when(strict, "unordered_rows")
        .otherwise("not_equivalent")
    )
    ordered_run = F.col("ordered") & ~gate.isin(
        "gold_failed", "candidate_failed", "truncated", "column_count"
    )
    reason = (
        F.when(gate == "gold_failed", "gold query failed")
        .when(gate == "candidate_failed", F.concat(F.lit("candidate failed: "), "error_type"))
        .when(gate == "truncated", "a result is truncated")
        .when(gate == "column_count", "column counts differ")
        .when(gate == "both_empty", F.concat(F.lit("both empty; "), F.array_join(problems, "; ")))
        .when((gate == "row_count") & F.col("ordered"), "row counts differ")
        .when(gate == "row_count", "row multisets differ")
        .when(strict, "rows match")
        .when(
            gate == "ordered",
            F.concat_ws(
                " ", F.lit("ordered mismatch at row"), "bad_row", F.lit("column"), "bad_col"
            ),
        )
        .otherwise("row multisets differ")
    )
    return judged.select(
        *keys,
        strict.alias("equivalent"),
        strict.alias("strict_equivalent"),
        partial.alias("partial_credit"),
        kind.alias("kind"),
        reason.alias("reason"),
        F.col("row_count").alias("candidate_row_count"),
        "gold_row_count",
        "column_match",
        "column_count_match",
        ordered_run.alias("order_sensitive"),
        "problems",
    )


def apply_row_cap(rows: DataFrame, keys: list[str], max_rows: int) -> tuple[DataFrame, DataFrame]:
    """Result rows up to the cap, and per result its ``row_count`` and ``truncated``."""
    kept = rows.filter(F.col("row_idx") < max_rows)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return kept, sizes.select(
        *keys,
        F.least(F.col("_n"), F.lit(max_rows)).alias("row_count"),
        (F.col("_n") > max_rows).alias("truncated"),
    )


def cache_key(
    dataset_hash: Column, db_fingerprint: Column, db_id: Column, example_id: Column, sql: Column
) -> Column:
    """Names a gold result by all that decides it; a change of any part is another key."""
    return F.concat_ws(
        "/",
        F.substring(dataset_hash, 1, 16),
        F.substring(F.coalesce(db_fingerprint, F.lit("unknown")), 1, 16),
        F.concat_ws(
            "_",
            F.regexp_replace(db_id, r"[^\p{L}\p{N}_-]", ""),
            F.regexp_replace(example_id, r"[^\p{L}\p{N}._-]", ""),
            F.substring(F.sha2(sql, 256), 1, 16),
        ),
    )


def cache_lookup(wanted: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the wanted keys, those with a readable cached result and those still to run."""
    readable = cached.filter(F.col("success").isNotNull()).select("cache_key").distinct()
    return (
        wanted.join(readable, "cache_key", "left_semi"),
        wanted.join(readable, "cache_key", "left_anti"),
    )

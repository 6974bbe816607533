"""Finding the same content on both sides of a split, and gold data inside prompts.

Texts are compared through 256-bit digests, so what is shuffled per row is an id, a
split and 32 bytes, whatever the text's length. Splits are few, which bounds the arrays
collected per key; rows of a key with very many copies are salted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.aggregates import count_where
from evalspark.functions.text import normalize_question, normalize_sql, strip
from evalspark.operators.membership import likely_members
from evalspark.operators.skew import salted_join
from evalspark.operators.validate import DataError, require_empty
from evalspark.session import materialize
from evalspark.sources.schemas import SPLITS

MIN_LEAK_LENGTH = 6  # fixed value: shorter result strings are too common to count


def digest(*columns: Column) -> Column:
    """Digest of a tuple; lengths keep ('a', 'bc') and ('ab', 'c') apart.

    Declared never null, as it is, so that a join on it adds no null check, which would
    compute the digest a second time.
    """
    parts = [F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in columns]
    return F.coalesce(F.unhex(F.sha2(F.concat(*parts), 256)), F.lit(b""))


def _known_splits() -> Column:
    return F.array(*[F.lit(s) for s in SPLITS])


def _split_bit() -> Column:
    """The split as one bit, so that a key's splits are a number and not a list."""
    place = F.array_position(_known_splits(), F.col("split")).cast("int")
    unknown = F.raise_error(F.concat(F.lit("unknown split "), "split")).cast("bigint")
    bits = F.element_at(F.array(*[F.lit(2**i).cast("bigint") for i in range(len(SPLITS))]), place)
    return F.when(place > 0, bits).otherwise(unknown)


def _split_names(bits: str) -> Column:
    return F.filter(_known_splits(), lambda _, i: F.getbit(F.col(bits), i) == 1)


def _pairs(splits: Column) -> Column:
    """All (left, right) with left before right, of an array of distinct splits."""
    return F.flatten(
        F.transform(
            splits,
            lambda a: F.transform(
                F.filter(splits, lambda b: b > a),
                lambda b: F.struct(a.alias("left_split"), b.alias("right_split")),
            ),
        )
    )


def _shared_keys(keyed: DataFrame, *key: str) -> DataFrame:
    """Keys found in more than one split, with those splits and the key's row count."""
    return (
        keyed.groupBy(*key)
        .agg(F.bit_or(_split_bit()).alias("bits"), F.count("*").alias("n"))
        .filter(F.bit_count("bits") > 1)
        .select(*key, "n", _split_names("bits").alias("splits"))
    )


def id_overlap(examples: DataFrame) -> DataFrame:
    """``left_split, right_split, example_id`` for ids found in more than one split."""
    shared = _shared_keys(examples.select("example_id", "split"), "example_id")
    return shared.select("example_id", F.inline(_pairs(F.col("splits"))))


def question_overlap(examples: DataFrame) -> DataFrame:
    """One row per left row, rule and later split that holds the row's question too.

    An exact overlap is reported under both rules. The digests are written down once, so
    the texts are read and normalized a single time.
    """
    question = F.col("question")
    rules = {
        "question_overlap_exact": question,
        "question_overlap_normalized": normalize_question(question),
    }
    table = F.array(
        *[F.struct(F.lit(r).alias("rule"), digest(k).alias("_key")) for r, k in rules.items()]
    )
    keyed = materialize(examples.select("example_id", "split", F.inline(table)), "overlap-keys")
    shared = _shared_keys(keyed, "rule", "_key")
    return salted_join(keyed, shared, ["rule", "_key"], ["example_id"], size="n").select(
        "example_id",
        F.col("split").alias("left_split"),
        F.explode(F.expr("filter(splits, s -> s > split)")).alias("right_split"),
        "rule",
    )


def prompt_leakage(prompts: DataFrame) -> DataFrame:
    """Rows of ``example_id, prompt, gold_sql`` whose prompt holds the gold SQL."""
    checked = prompts.select(
        "example_id",
        normalize_sql(F.col("prompt")).contains(normalize_sql(F.col("gold_sql"))).alias("_norm"),
        F.col("prompt").contains(strip(F.col("gold_sql"))).alias("_raw"),
    )
    rules = F.array_compact(
        F.array(
            F.when(F.col("_norm"), F.lit("prompt_leakage_gold_sql")),
            F.when(F.col("_raw"), F.lit("prompt_leakage_gold_sql_raw")),
        )
    )
    return checked.select("example_id", F.explode(rules).alias("rule"))


# Values that one automaton looks for; an example with more has several.
VALUES_AT_ONCE = 10_000


def _standing_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of each row that stand in its prompt, in one pass over the prompt."""
    import ahocorasick

    for batch in batches:
        ids, prompts, lists = (batch.column(c) for c in ("example_id", "prompt", "values"))
        # Of a batch only one row's texts are in Python at a time.
        for i in range(batch.num_rows):
            entries = lists[i].values
            values, counts = entries.field("value"), entries.field("occurrences")
            automaton = ahocorasick.Automaton()
            for k, value in enumerate(values):
                automaton.add_word(value.as_py(), k)
            automaton.make_automaton()
            kept = pa.array(sorted({k for _, k in automaton.iter(prompts[i].as_py())}), pa.int64())
            if len(kept):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([i] * len(kept), pa.int64())), values.take(kept), counts.take(kept)],
                    names=["example_id", "value", "occurrences"],
                )


def result_leakage(prompts: DataFrame, result_strings: DataFrame) -> DataFrame:
    """Gold result strings (``example_id, value``) that stand in the example's prompt.

    ``occurrences`` counts the result cells with that value. The values of an example travel
    together, so a prompt is moved and read once for ``VALUES_AT_ONCE`` of them.
    """
    values = materialize(
        result_strings.filter(F.length("value") >= MIN_LEAK_LENGTH)
        .groupBy("example_id", "value")
        .agg(F.count("*").alias("occurrences")),
        "leak-values",
    )
    many = values.groupBy("example_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > VALUES_AT_ONCE)
    portions = F.coalesce(F.ceil(F.col("_n") / VALUES_AT_ONCE), F.lit(1))
    lists = (
        values.join(many, "example_id", "left")
        .groupBy("example_id", F.pmod(F.xxhash64("value"), portions).alias("_portion"))
        .agg(F.collect_list(F.struct("value", "occurrences")).alias("values"))
    )
    given = prompts.filter(F.col("prompt").isNotNull()).select("example_id", "prompt")
    joined = lists.join(given, "example_id").select("example_id", "prompt", "values")
    kind = joined.schema["example_id"].dataType.simpleString()
    return joined.mapInArrow(_standing_in, f"example_id {kind}, value string, occurrences bigint")


def candidates_from_test(examples: DataFrame, candidates: DataFrame) -> DataFrame:
    test_ids = examples.filter(F.col("split") == "test").select("example_id")
    return candidates.select("example_id").distinct().join(test_ids, "example_id", "left_semi")


def audit_examples(
    examples: DataFrame,
    prompts: DataFrame | None = None,
    result_strings: DataFrame | None = None,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """All violations as ``rule, example_id``; clean means no rows."""

    def rows(found: DataFrame, rule: str | None = None) -> DataFrame:
        name = F.lit(rule) if rule else F.col("rule")
        return found.select(name.alias("rule"), "example_id")

    parts = [rows(id_overlap(examples), "id_overlap"), rows(question_overlap(examples))]
    if prompts is not None:
        parts.append(rows(prompt_leakage(prompts)))
        if result_strings is not None:
            parts.append(
                rows(result_leakage(prompts, result_strings), "prompt_leakage_gold_result")
            )
    if candidates is not None:
        parts.append(rows(candidates_from_test(examples, candidates), "distillation_from_test"))
    return reduce(DataFrame.unionByName, parts)


class LeakageError(DataError):
    """Content on both sides of a split, or gold data in a prompt."""


def assert_clean(examples: DataFrame, **more: DataFrame) -> None:
    """Run ``audit_examples`` and raise if any rule is broken."""
    found = audit_examples(examples, **more)
    named = found.select(F.concat_ws(":", "rule", "example_id").alias("violation"))
    require_empty(named, "violation", "leakage", LeakageError)


CONTENT_RULES = ("id", "normalized_question", "question_evidence", "question_sql")


def _content_keys(df: DataFrame, *extra: str) -> DataFrame:
    """Each row's four identity keys as ``rule, key``."""
    question = F.col("question")
    keys = {
        "id": F.col("example_id"),
        "normalized_question": normalize_question(question),
        "question_evidence": F.concat_ws("|", "db_id", question, "evidence"),
        "question_sql": F.concat_ws("|", "db_id", question, "gold_sql"),
    }
    table = F.array(
        *[F.struct(F.lit(k).alias("rule"), digest(v).alias("key")) for k, v in keys.items()]
    )
    return df.select(*extra, F.inline(table))


# Held-out keys that are sent to every task, 32 bytes each, and as a Bloom filter, two bytes each.
KEYS_SENT = 1_000_000
KEYS_FILTERED = 64_000_000


def heldout_overlap(examples: DataFrame, heldout: DataFrame) -> DataFrame:
    """Per rule, how many distinct keys of a split the held-out set shares, summed.

    Up to ``KEYS_SENT`` held-out keys meet the corpus where it is read, so that only keys that
    match are shuffled. Up to ``KEYS_FILTERED`` a Bloom filter of them does, and what passes it
    meets the keys themselves; still more of them meet the corpus's distinct keys.
    """
    keys = _content_keys(examples, "split")
    held = materialize(_content_keys(heldout).distinct(), "heldout-keys")
    name = ["rule", "key"]
    count = held.count()
    if count <= KEYS_SENT:
        shared = keys.join(F.broadcast(held), name, "left_semi").distinct()
    else:
        likely = likely_members(keys, held, name, count) if count <= KEYS_FILTERED else keys
        shared = likely.distinct().join(held, name, "left_semi")
    counts = shared.groupBy("rule").agg(F.count("*").alias("overlap"))
    rules = keys.sparkSession.createDataFrame([(r,) for r in CONTENT_RULES], "rule string")
    return rules.join(counts, "rule", "left").fillna(0, ["overlap"])


def content_key() -> Column:
    return digest(F.col("db_id"), strip(F.col("question")))


def content_overlap_pairs(examples: DataFrame) -> DataFrame:
    """Per pair of splits, the distinct (database, question) keys they share."""
    shared = _shared_keys(examples.select("split", content_key().alias("_key")), "_key")
    return (
        shared.select(F.inline(_pairs(F.col("splits"))))
        .groupBy("left_split", "right_split")
        .agg(F.count("*").alias("overlap"))
    )


def duplicate_counts(examples: DataFrame) -> DataFrame:
    """Rows beyond the first of their key, exact and normalized."""
    normalized = digest(F.col("db_id"), normalize_question(F.col("question")))
    keyed = examples.select(content_key().alias("_exact"), normalized.alias("_normalized"))
    return keyed.agg(
        (F.count("*") - F.count_distinct("_exact")).alias("duplicate_exact"),
        (F.count("*") - F.count_distinct("_normalized")).alias("duplicate_normalized"),
    )


def duplicate_detail(examples: DataFrame, order: str) -> DataFrame:
    """Each later row of a key beside the key's first row, and whether they agree.

    ``order`` is a numeric source index. Keys that occur once drop out before any row
    meets another.
    """
    rows = examples.select(
        order, "example_id", "db_id", "gold_sql", "evidence", content_key().alias("_key")
    )
    repeated = (
        rows.groupBy("_key")
        .agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
        .filter("_n > 1")
    )
    copies = salted_join(rows, repeated, ["_key"], [order], size="_n")
    firsts = copies.filter(F.col(order) == F.col("_first")).select(
        "_key",
        F.col("_n").alias("_copies"),
        F.col("example_id").alias("first_id"),
        F.col("gold_sql").alias("first_sql"),
        F.col("evidence").alias("first_evidence"),
    )
    later = copies.filter(F.col(order) > F.col("_first")).drop("_n", "_first")
    return salted_join(later, firsts, ["_key"], [order], size="_copies").select(
        "db_id",
        "first_id",
        F.col("example_id").alias("later_id"),
        "first_sql",
        F.col("gold_sql").alias("later_sql"),
        (F.col("first_sql") == F.col("gold_sql")).alias("same_sql"),
        (F.col("first_evidence") == F.col("evidence")).alias("same_evidence"),
    )


def exposure(exposed: DataFrame, evaluated: DataFrame) -> DataFrame:
    """How the ids a model has seen relate to those it is judged on."""
    both = exposed.select("example_id", F.lit(1).alias("e"), F.lit(0).alias("v")).unionAll(
        evaluated.select("example_id", F.lit(0), F.lit(1))
    )
    per_id = both.groupBy("example_id").agg(F.max("e").alias("e"), F.max("v").alias("v"))
    return per_id.agg(
        count_where("e = 1").alias("exposed"),
        count_where("v = 1").alias("evaluated"),
        count_where("e = 1 and v = 1").alias("intersection"),
        count_where("e = 0 and v = 1").alias("unexposed"),
        (count_where("e = 1 and v = 0") == 0).alias("is_subset"),
    )


def split_proof(examples: DataFrame) -> DataFrame:
    """Sizes that prove the splits partition the ids: ``metric, value``."""
    per_id = examples.groupBy("example_id").agg(
        F.bit_or(_split_bit()).alias("bits"), F.count("*").alias("n")
    )
    per_id = per_id.withColumn("splits", _split_names("bits"))
    sizes = per_id.select(F.explode("splits").alias("split")).groupBy("split").agg(
        F.count("*").alias("value")
    )
    pairs = (
        per_id.select(F.inline(_pairs(F.col("splits"))))
        .groupBy("left_split", "right_split")
        .agg(F.count("*").alias("value"))
    )
    totals = per_id.agg(
        F.count("*").alias("union_size"),
        F.sum(F.size("splits")).alias("sum_of_sizes"),
        F.sum("n").alias("rows"),
    )
    return (
        sizes.select(F.concat(F.lit("size:"), "split").alias("metric"), "value")
        .unionAll(
            pairs.select(F.concat(F.lit("overlap:"), "left_split", F.lit("/"), "right_split"), "value")
        )
        .unionAll(totals.unpivot([], ["union_size", "sum_of_sizes", "rows"], "metric", "value"))
    )

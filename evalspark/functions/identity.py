"""Ids, content hashes and seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import casefold, strip

# Control characters whose JSON escape has a letter digit; the published ids spell
# these escapes in lower case.
_LETTERED_ESCAPES = ["0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"]


def _lower_case_escapes(json: Column) -> Column:
    fixed = json
    for digits in _LETTERED_ESCAPES:
        # An even number of backslashes before it means a real escape.
        fixed = F.regexp_replace(
            fixed, rf"(?<!\\)((?:\\\\)*)\\u00{digits}", rf"$1\\u00{digits.lower()}"
        )
    return F.when(json.rlike(r"\\u00[01][A-F]"), fixed).otherwise(json)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON object with keys in sorted order and nulls kept."""
    struct = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return _lower_case_escapes(F.to_json(struct, {"ignoreNullFields": "false"}))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def content_signature(
    db_id: Column, question: Column, evidence: Column, gold_sql: Column
) -> Column:
    """Hash of what identifies an example; the question keeps its outer blanks."""
    empty = F.lit("")
    return sha256(
        canonical_json(
            db_id=db_id,
            question=question,
            evidence=strip(F.coalesce(evidence, empty)),
            gold_sql=strip(F.coalesce(gold_sql, empty)),
        )
    )


def canonical_id(prefix: str, question_id: Column, signature: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.coalesce(question_id.cast("string"), signature))


def short_id_piped(prefix: str, db_id: Column, question: Column) -> Column:
    """First legacy spelling: hash of ``db|question``."""
    digest = F.substring(sha256(F.concat(db_id, F.lit("|"), question)), 1, 8)
    return F.concat(F.lit(prefix + "-"), db_id, F.lit("-"), digest)


def short_id_joined(prefix: str, db_id: Column, question: Column) -> Column:
    """Second legacy spelling: hash of ``db`` and ``question`` without separator."""
    digest = F.substring(sha256(F.concat(db_id, question)), 1, 8)
    return F.concat(F.lit(prefix + "-"), db_id, F.lit("-"), digest)


def normalized_sql_hash(sql: Column) -> Column:
    return F.when(sql != "", sha256(casefold(strip(sql))))


def generation_seed(global_seed: int, example_id: Column, attempt: Column) -> Column:
    """First 64 bits of a hash; unsigned, hence a decimal."""
    text = F.concat(F.lit(f"{global_seed}:"), example_id, F.lit(":"), attempt.cast("string"))
    return F.conv(F.substring(sha256(text), 1, 16), 16, 10).cast("decimal(20,0)")


def order_hash(seed: int, key: Column) -> Column:
    """Uniform, reproducible sort key that stands in for a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def fingerprint_number(text: Column) -> Column:
    """60 bits of a hash as a long, for order-free set fingerprints."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")

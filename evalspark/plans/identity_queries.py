"""Ids, normalization and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import identity, text
from evalspark.operators import fingerprints
from evalspark.operators.equivalence import cache_key
from evalspark.operators.workflow import run_fingerprint
from evalspark.plans.registry import Tables, query

SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
FOLD = "replace(lower({0}), 'ß', 'ss')"
NORM_QUESTION = (
    "trim(regexp_replace(" + FOLD + r", '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
)
NORM_SQL = f"trim(regexp_replace({FOLD}, '{SPACES.replace('{', '{{').replace('}', '}}')}', ' ', 'g'))"
SIGNATURE = (
    "sha256('{\"db_id\":' || to_json(db_id) || ',\"evidence\":' || to_json(trim(evidence)) || "
    "',\"gold_sql\":' || to_json(trim(gold_sql)) || ',\"question\":' || to_json(question) || '}')"
)


@query(
    "canonical_id",
    f"""SELECT example_id, {SIGNATURE} AS signature, 'train-' || {SIGNATURE} AS content_id,
      'dev-' || CASE WHEN ord % 2 = 0 THEN CAST(ord AS VARCHAR) ELSE {SIGNATURE} END AS mixed_id
    FROM examples""",
    "examples",
)
def canonical_id(t: Tables):
    """Canonical ids: the source's own id where there is one, else the content hash."""
    signature = identity.content_signature(
        *[F.col(c) for c in ("db_id", "question", "evidence", "gold_sql")]
    )
    own_id = F.when(F.col("ord") % 2 == 0, F.col("ord"))
    return (
        t.adapted("examples")
        .withColumn("signature", signature)
        .select(
            "example_id",
            "signature",
            identity.canonical_id("train", F.lit(None), F.col("signature")).alias("content_id"),
            identity.canonical_id("dev", own_id, F.col("signature")).alias("mixed_id"),
        )
    )


@query(
    "legacy_ids",
    """SELECT example_id, 'train-' || db_id || '-' || substr(sha256(db_id || '|' || question), 1, 8) AS piped,
      'train-' || db_id || '-' || substr(sha256(db_id || question), 1, 8) AS joined FROM examples""",
    "examples",
)
def legacy_ids(t: Tables):
    """Both old short-id spellings."""
    db_id, question = F.col("db_id"), F.col("question")
    return t.adapted("examples").select(
        "example_id",
        identity.short_id_piped("train", db_id, question).alias("piped"),
        identity.short_id_joined("train", db_id, question).alias("joined"),
    )


@query(
    "id_migration",
    f""", keyed AS (SELECT *, {SIGNATURE} AS signature FROM examples),
    eng AS (SELECT signature, min(example_id) AS old FROM keyed WHERE split = 'validation_tuning' GROUP BY 1),
    fv AS (SELECT signature, min(example_id) AS old FROM keyed WHERE split = 'formal_validation' GROUP BY 1),
    tr AS (SELECT signature, min('train-' || db_id || '-' || substr(sha256(db_id || '|' || question), 1, 8)) AS old
      FROM keyed WHERE split = 'train' GROUP BY 1)
    SELECT k.ord, k.signature, 'train-' || k.signature AS stable_id, coalesce(eng.old, fv.old, tr.old) AS old_id,
      CASE WHEN eng.old IS NOT NULL THEN 'validation_tuning' WHEN fv.old IS NOT NULL THEN 'formal_validation'
        ELSE 'train' END AS role
    FROM keyed k LEFT JOIN eng USING (signature) LEFT JOIN fv USING (signature) LEFT JOIN tr USING (signature)""",
    "examples",
)
def id_migration(t: Tables):
    """Old id, stable id and role of every source row."""
    examples = t.adapted("examples").withColumn(
        "signature",
        identity.content_signature(
            *[F.col(c) for c in ("db_id", "question", "evidence", "gold_sql")]
        ),
    )
    old = {
        split: examples.filter(F.col("split") == split).select("signature", "example_id")
        for split in ("validation_tuning", "formal_validation")
    }
    short = identity.short_id_piped("train", F.col("db_id"), F.col("question"))
    train = examples.filter("split = 'train'").select("signature", short.alias("example_id"))
    return fingerprints.id_migration(
        examples, old["validation_tuning"], old["formal_validation"], train, "ord", "train"
    )


@query(
    "question_normalization",
    f"SELECT example_id, md5({NORM_QUESTION.format('question')}) AS normalized FROM examples",
    "examples",
)
def question_normalization(t: Tables):
    """Digest of every question's normalized form."""
    return t.adapted("examples").select(
        "example_id", F.md5(text.normalize_question(F.col("question"))).alias("normalized")
    )


@query(
    "sql_normalization",
    f"""SELECT example_id, md5({NORM_SQL.format('question')}) AS whole_text,
      {NORM_SQL.format('gold_sql')} AS gold,
      md5({NORM_SQL.format("schema_text")}) AS exact_match FROM examples""",
    "examples",
)
def sql_normalization(t: Tables):
    """The containment key of SQL and the exact-match key, over whole texts."""
    return t.adapted("examples").select(
        "example_id",
        F.md5(text.normalize_sql(F.col("question"))).alias("whole_text"),
        text.normalize_sql(F.col("gold_sql")).alias("gold"),
        F.md5(text.normalize_sql_exact_match(F.col("schema_text"))).alias("exact_match"),
    )


@query(
    "sql_hash",
    """SELECT example_id, candidate_index, sha256(lower(trim(candidate_sql))) AS sql_hash,
      sha256(raw_candidate_output) AS completion_hash FROM candidates""",
    "candidates",
)
def sql_hash(t: Tables):
    """Normalized SQL hash and completion hash per candidate."""
    return t.adapted("candidates").select(
        "example_id",
        "candidate_index",
        identity.normalized_sql_hash(F.col("candidate_sql")).alias("sql_hash"),
        identity.sha256(F.col("raw_candidate_output")).alias("completion_hash"),
    )


_NUM = "('0x' || substr(md5(example_id), 1, 15))::BIGINT"


@query(
    "idset_fingerprint",
    f"""SELECT split, count(*) AS n, bit_xor({_NUM}) AS xor_part,
      CAST(sum({_NUM} % 1000000007) AS BIGINT) AS sum_part
    FROM (SELECT DISTINCT split, example_id FROM lines) GROUP BY split""",
    "lines",
)
def idset_fingerprint(t: Tables):
    """Order-free fingerprint of each split's id set."""
    return fingerprints.set_fingerprint(t.adapted("lines"), "example_id", ["split"])


@query(
    "idset_tree_hash",
    """, ids AS (SELECT DISTINCT split, example_id, substr(md5(example_id), 1, 4) AS bucket FROM lines),
    leaves AS (SELECT split, bucket, sha256(string_agg(example_id, chr(10) ORDER BY example_id)) AS h
      FROM ids GROUP BY 1, 2)
    SELECT split, sha256(string_agg(h, chr(10) ORDER BY bucket)) AS ids_hash FROM leaves GROUP BY split""",
    "lines",
)
def idset_tree_hash(t: Tables):
    """Hash of each split's sorted ids, bucket by bucket."""
    return fingerprints.set_tree_hash(t.adapted("lines"), "example_id", ["split"])


@query(
    "schema_set_hash",
    """, texts AS (SELECT db_id, string_agg(trim(ddl), chr(10) ORDER BY name) AS schema_text
      FROM catalog WHERE type IN ('table', 'view') GROUP BY db_id)
    SELECT sha256('[' || string_agg('{"db_id":"' || db_id || '","schema_hash":"' || sha256(schema_text)
      || '","sha256":null}', ',' ORDER BY db_id) || ']') AS schema_set_hash, count(*) AS databases FROM texts""",
    "catalog",
)
def schema_set_hash(t: Tables):
    """One hash over every database's schema hash."""
    from evalspark.sources.catalog import schema_text

    entries = schema_text(t.adapted("catalog")).select(
        "db_id",
        F.lit(None).cast("string").alias("sha256"),
        identity.sha256(F.col("schema_text")).alias("schema_hash"),
    )
    return fingerprints.schema_set_hash(entries)


_RUN = {"dataset": "abc", "teacher_model": "teacher-1", "prompt_version": "v2", "num_candidates": "4"}


@query(
    "run_fingerprint",
    """SELECT CASE WHEN teacher_prompt_version = 'v2' THEN
        sha256('{"dataset":"abc","num_candidates":"4","prompt_version":"v2","teacher_model":"teacher-1"}') END AS stored,
      teacher_prompt_version = 'v2' AS same_run, count(*) AS n FROM candidates GROUP BY 1, 2""",
    "candidates",
)
def run_fingerprint_check(t: Tables):
    """Which records stem from the current run, by the fingerprint kept on them."""
    current = run_fingerprint(_RUN)
    stored = F.when(F.col("teacher_prompt_version") == "v2", current)
    rows = t.adapted("candidates").withColumn("stored", stored)
    return rows.groupBy("stored", F.col("stored").eqNullSafe(current).alias("same_run")).agg(
        F.count("*").alias("n")
    )


@query(
    "generation_seed",
    """SELECT example_id, candidate_index, CAST(CAST(('0x' || substr(sha256('3407:' || example_id || ':'
      || candidate_index), 1, 16)) AS UBIGINT) AS VARCHAR) AS seed FROM candidates""",
    "candidates",
)
def generation_seed(t: Tables):
    """The unsigned 64-bit seed of every attempt."""
    seed = identity.generation_seed(3407, F.col("example_id"), F.col("candidate_index"))
    return t.adapted("candidates").select(
        "example_id", "candidate_index", seed.cast("string").alias("seed")
    )


@query(
    "cache_key",
    """SELECT example_id, 'd41d8cd98f00b204/' || substr(sha256(db_id), 1, 16) || '/' || db_id || '_' || example_id
      || '_' || substr(sha256(gold_sql), 1, 16) AS cache_key FROM examples""",
    "examples",
)
def result_cache_key(t: Tables):
    """The key a gold result is kept under."""
    dataset = F.lit("d41d8cd98f00b204e9800998ecf8427e")
    db_id, sql = F.col("db_id"), F.col("gold_sql")
    key = cache_key(dataset, F.sha2(db_id, 256), db_id, F.col("example_id"), sql)
    return t.adapted("examples").select("example_id", key.alias("cache_key"))

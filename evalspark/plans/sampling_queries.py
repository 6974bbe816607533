"""Stratified samples, splits and source intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import sampling
from evalspark.plans.registry import Tables, query

SEED, SIZE = 3407, 300
_RANKED = """, r AS (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY md5('{1}:' || example_id), example_id) AS rn
      FROM {2})"""


@query(
    "round_robin_sample",
    f"""{_RANKED.format('db_id', SEED, 'lines')}
    SELECT example_id, db_id, rn FROM r ORDER BY rn, db_id LIMIT {SIZE}""",
    "lines",
)
def round_robin_sample(t: Tables):
    """A fixed number of rows, the strata taking turns."""
    sample = sampling.round_robin_sample(t.adapted("lines"), "db_id", "example_id", SIZE, SEED)
    return sample.select("example_id", "db_id", "rn")


_TRAIN = "(SELECT * FROM examples WHERE split = 'train') x"


@query(
    "train_validation_split",
    f"""{_RANKED.format('db_id', SEED, _TRAIN)}, v AS (SELECT example_id FROM r ORDER BY rn, db_id LIMIT 45)
    SELECT example_id, CASE WHEN example_id IN (SELECT example_id FROM v) THEN 'validation_tuning' ELSE split END AS split
    FROM examples WHERE split = 'train'""",
    "examples",
)
def train_validation_split(t: Tables):
    """Training rows, a stratified part of them relabelled for validation."""
    both = sampling.train_validation_split(t.adapted("examples"), 45, SEED)
    return both.select("example_id", "split")


@query(
    "collection_selection",
    """, pool AS (SELECT * FROM examples WHERE example_id NOT IN (SELECT 'doc-' || doc_id FROM labels WHERE toxic = 1)),
    r AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY md5('20260817:' || example_id), example_id) AS rn FROM pool)
    SELECT example_id, db_id, row_number() OVER (ORDER BY rn, db_id) AS selection_order FROM r
    ORDER BY rn, db_id LIMIT 128""",
    "examples",
)
def collection_selection(t: Tables):
    """The next examples to ask about, in order, without those used before."""
    used = t.labels.filter("toxic = 1").select(
        F.concat(F.lit("doc-"), "doc_id").alias("example_id")
    )
    return sampling.select_for_collection(t.adapted("examples"), used, 128, 20260817)


@query(
    "coverage_first_sample",
    """, s AS (SELECT doc_id, source || '-' || lang AS db_id, 'doc-' || doc_id AS example_id FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY md5('7:' || example_id), example_id) AS rn FROM s),
    n AS (SELECT greatest(12, count(DISTINCT db_id)) AS n FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY rn, db_id) AS place FROM r)
    SELECT example_id, db_id, rn FROM o, n WHERE place <= n.n""",
    "examples",
)
def coverage_first_sample(t: Tables):
    """One row of every stratum, even when that is more than was asked for."""
    rows = t.documents.select(
        F.concat("source", F.lit("-"), "lang").alias("db_id"),
        F.concat(F.lit("doc-"), "doc_id").alias("example_id"),
    )
    return sampling.round_robin_sample(rows, "db_id", "example_id", 12, 7, cover_all=True)


@query(
    "identity_split",
    """, k AS (SELECT *, db_id || '|' || question || '|' || trim(evidence) || '|' || trim(gold_sql) AS key FROM lines),
    e AS (SELECT DISTINCT key FROM k WHERE split = 'dev'), f AS (SELECT DISTINCT key FROM k WHERE split = 'test')
    SELECT example_id, CASE WHEN key IN (SELECT key FROM e) THEN 'validation_tuning'
      WHEN key IN (SELECT key FROM f) THEN 'formal_validation' ELSE 'train' END AS split FROM k""",
    "lines",
)
def identity_split(t: Tables):
    """Three-way split by content: all copies of a selected row go with it."""
    lines = t.adapted("lines")
    split = sampling.split_by_identity(
        lines, lines.filter("split = 'dev'"), lines.filter("split = 'test'")
    )
    return split.select("example_id", "split")


@query(
    "stratum_distribution", "SELECT db_id, count(*) AS n FROM lines GROUP BY db_id", "lines"
)
def stratum_distribution(t: Tables):
    """Rows per stratum."""
    return sampling.distribution(t.adapted("lines"), "db_id")


@query(
    "first_n",
    "SELECT example_id, ord FROM lines ORDER BY ord LIMIT 100",
    "lines",
)
def first_rows(t: Tables):
    """The first rows in source order, which is what the cap means."""
    return sampling.first_n(t.adapted("lines").select("example_id", "ord"), "ord", 100)


@query(
    "id_selection",
    "SELECT example_id, db_id FROM examples WHERE example_id IN (SELECT 'doc-' || doc_id FROM labels WHERE quality = 1)",
    "examples",
)
def id_selection(t: Tables):
    """Rows named by an id list."""
    ids = t.labels.filter("quality = 1").select(
        F.concat(F.lit("doc-"), "doc_id").alias("example_id")
    )
    return sampling.select_ids(t.adapted("examples"), ids).select("example_id", "db_id")


_RAW = """, raw AS (SELECT *, db_id <> 'src3' AS known, ord % 7 <> 2 AS gold_ok,
      CASE WHEN ord % 29 = 0 THEN '  ' ELSE question END AS q FROM examples),
    a AS (SELECT *, CASE WHEN NOT known OR trim(q) = '' THEN 'missing_db' WHEN NOT gold_ok THEN 'gold_failure' END
      AS reason FROM raw)"""


def _adapted_source(t: Tables):
    examples = t.adapted("examples")
    schemas = (
        t.adapted("catalog")
        .filter("db_id <> 'src3' and type = 'table'")
        .groupBy("db_id")
        .agg(F.min("ddl").alias("schema_text"))
    )
    raw = examples.drop("schema_text").withColumns(
        {
            "question": F.when(F.col("ord") % 29 == 0, "  ").otherwise(F.col("question")),
            "gold_ok": F.col("ord") % 7 != 2,
        }
    )
    return sampling.adapt_source(raw, schemas)


@query(
    "source_adapter",
    f"""{_RAW} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM a GROUP BY 1""",
    "examples",
)
def source_adapter(t: Tables):
    """Raw records taken in, and why the others were not."""
    _, counts = sampling.intake(_adapted_source(t), "ord")
    return counts


@query(
    "source_adapter_capped",
    f"""{_RAW}, l AS (SELECT max(ord) AS last FROM (SELECT ord FROM a WHERE reason IS NULL ORDER BY ord LIMIT 50))
    SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM a, l WHERE ord <= last GROUP BY 1""",
    "examples",
)
def source_adapter_capped(t: Tables):
    """As before with a cap: records behind the last accepted one are not counted."""
    _, counts = sampling.intake(_adapted_source(t), "ord", cap=50)
    return counts

"""The registered queries over the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.llm import (
    contamination,
    language,
    licenses,
    near,
    outliers,
    periods,
    personal,
    pieces,
    ranking,
    repeats,
    tokens,
    toxicity,
    wrappers,
)
from evalspark.llm.common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def _query(name):
    def register(build):
        QUERIES[name] = build
        return build

    return register


@_query("op5_personal_data")
def op5(spark, folder):
    return personal.span_digests(personal.find_personal_data(table(spark, folder, "documents")))


@_query("op7_token_counts")
def op7(spark, folder):
    return tokens.count_tokens(table(spark, folder, "documents"))


@_query("op2_quality_rules")
def op2(spark, folder):
    return outliers.quality(table(spark, folder, "documents"))


@_query("op4_decontamination")
def op4(spark, folder):
    return contamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_query("op8_toxicity")
def op8(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query("op9_ngram_jaccard_join")
def op9(spark, folder):
    return near.similar_groups(table(spark, folder, "documents"))


@_query("op1_sentencepiece")
def op1(spark, folder):
    return pieces.encode_and_check(table(spark, folder, "documents"))


@_query("op3_html_extraction")
def op3(spark, folder):
    return wrappers.extract(table(spark, folder, "pages"))


@_query("op6_license_scan")
def op6(spark, folder):
    return licenses.license_report(table(spark, folder, "documents"))


@_query("op10_suffix_dedup")
def op10(spark, folder):
    return repeats.remove_repeats(table(spark, folder, "documents"))


@_query("op13_periodic_runs")
def op13(spark, folder):
    return periods.run_digests(periods.find_runs(periods.with_repeats(table(spark, folder, "documents"))))


@_query("op11_ranked_search")
def op11(spark, folder):
    return ranking.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op11_ranked_search"] = """
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS row, text FROM documents
  UNION ALL SELECT 'i', item_id, 0, text FROM benchmark),
terms AS (
  SELECT kind, id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM texts),
counts AS (SELECT id AS doc_id, row, term, count(*) AS tf FROM terms WHERE kind = 'd' GROUP BY ALL),
sizes AS (SELECT row, sum(tf)::BIGINT AS n FROM counts GROUP BY row),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
weights AS (
  SELECT term, floor(1000 * ln((2.0 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, totals GROUP BY term),
scores AS (
  SELECT i.id AS item_id, c.doc_id, c.row,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM (SELECT DISTINCT id, term FROM terms WHERE kind = 'i') i JOIN counts c USING (term)
    JOIN weights USING (term) JOIN sizes USING (row), totals
  GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) AS rank
  FROM scores WHERE score > 0) WHERE rank <= 10
"""


@_query("op12_language_scores")
def op12(spark, folder):
    scored = language.language_scores(table(spark, folder, "documents"), ~language.held_out())
    return scored.withColumn("held_out", ~F.col("learned")).drop("learned")

"""Normalization against Python's own."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

from pyspark.sql import functions as F

from evalspark.functions import identity, text

SAMPLES = [
    "  Hello,   WORLD! ", "ＡＢＣ", "Straße_42", "ﬁne ① ½", "İstanbul", "Ça va? ÉTÉ", "a b c",
    "a\x1cb\x85c", " x　", "é combining", "ΑΣ Σ", "", "___", "ÀÖØÞßàöøÿ×÷", "१२३ ⅷ", "日本語テキスト",
    "tab\there\nnext", "ǅ ʼn", "a​b", "ſ K",
]


def _column(spark, values):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, s string").coalesce(1)


def _run(spark, fn):
    return [r[0] for r in _column(spark, SAMPLES).orderBy("i").select(fn(F.col("s"))).collect()]


def test_question(spark):
    def python(s):
        s = unicodedata.normalize("NFKC", s).casefold()
        return re.sub(r"\s+", " ", re.sub(r"[\W_]+", " ", s)).strip()

    assert _run(spark, text.normalize_question) == [python(s) for s in SAMPLES]


def test_sql(spark):
    def python(s):
        return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s)).strip().casefold()

    assert _run(spark, text.normalize_sql) == [python(s) for s in SAMPLES]


def test_exact_match(spark):
    def python(s):
        return re.sub(r"\s+", " ", s).strip().casefold()

    assert _run(spark, text.normalize_sql_exact_match) == [python(s) for s in SAMPLES]


def test_strip(spark):
    assert _run(spark, text.strip) == [s.strip() for s in SAMPLES]


def test_every_plain_letter_folds_as_in_python(spark):
    letters = [chr(c) for c in [*range(0x80), *range(0xC0, 0x100)]]
    frame = _column(spark, letters).orderBy("i").select(text.nfkc_casefold(F.col("s")))
    assert [r[0] for r in frame.collect()] == [
        unicodedata.normalize("NFKC", c).casefold() for c in letters
    ]


def test_signature_with_every_control_character(spark):
    questions = [chr(c) + " q" for c in range(32)] + ['say "x" \\u001F \\', "é/ü", "\\\\u001F\x1f"]
    rows = [(i, "db", q, " ev ", "SELECT 1 ") for i, q in enumerate(questions)]
    frame = spark.createDataFrame(rows, "i int, d string, q string, e string, s string").orderBy("i")
    got = frame.select(identity.content_signature(*[F.col(c) for c in "dqes"])).collect()
    want = [
        hashlib.sha256(
            json.dumps(
                {"db_id": "db", "question": q, "evidence": "ev", "gold_sql": "SELECT 1"},
                sort_keys=True,
                ensure_ascii=False,
                separators=(",", ":"),
            ).encode()
        ).hexdigest()
        for q in questions
    ]
    assert [r[0] for r in got] == want


def test_seed(spark):
    frame = _column(spark, ["ex-1", "x"]).orderBy("i")
    got = frame.select(identity.generation_seed(3407, F.col("s"), F.col("i"))).collect()
    want = [
        int(hashlib.sha256(f"3407:{s}:{i}".encode()).hexdigest()[:16], 16)
        for i, s in enumerate(["ex-1", "x"])
    ]
    assert [int(r[0]) for r in got] == want

"""Periodic runs against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from evalspark.llm import periods
from evalspark.llm.common import WORD, table
from evalspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every period by itself: stretches of equal words at that distance; the smallest period counts."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda x: (x[0], x[2]))


def _texts(rng):
    """Random sequences in which stretches are repeated at chance, inside one another too."""
    for _ in range(800):
        letters = rng.choice([1, 2, 3, 8, 1000])
        words = []
        while len(words) < rng.choice([0, 20, 60, 200, 400]):
            piece = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
            words += piece * rng.choice([1, 1, 3, 4, 9]) + piece[: rng.randrange(len(piece) + 1)]
        yield words


def test_runs_equal_a_plain_search():
    rng = random.Random(3)
    some = 0
    for words in _texts(rng):
        want = plain_runs(words)
        assert periods.runs_of(words) == want, words
        some += len(want)
        ids = np.array(words, np.int64)
        kept = periods.echo_stretches(ids, np.zeros(len(ids), np.int64))
        for s, e, _ in want:
            assert any(a <= s and e <= b for a, b in kept.tolist())
    assert some > 500


def test_grammar_spells_the_text():
    rng = random.Random(5)
    for words in _texts(rng):
        root, rules, base = periods.re_pair(words)

        def spell(symbol):
            return [symbol] if symbol < base else [w for part in rules[symbol - base] for w in spell(part)]

        assert [w for symbol in root for w in spell(symbol)] == words
        pairs = [p for p in zip(root, root[1:]) if p[0] != p[1]]
        assert len(pairs) == len(set(pairs))


def test_odd_rows(spark):
    tune = "la li lu " * 9 + "end " + "x " * 30
    rows = [(1, tune, 1), (1, tune, 1), (2, None, 2), (3, "", 3), (4, " \t\n", 4), (None, "a " * 24, 5), (5, "a " * 23, 6)]
    rows.append((6, " ".join(f"w{i}" for i in range(70_000)) + " again" * 50, 7))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int")
    found = periods.find_runs(docs).collect()
    by = {r.doc_id: r for r in found}
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    assert [tuple(r) for r in by[1].runs] == [(0, 27, 3), (28, 30, 1)]
    assert by[1].collapsed == "la li lu end x" and by[None].collapsed == "a"
    assert all(by[i].runs == [] and by[i].n_words == 0 and by[i].collapsed == "" for i in (2, 3, 4))
    assert by[5].runs == [] and by[5].n_words == 23
    assert [tuple(r) for r in by[6].runs] == [(70_000, 50, 1)]
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert periods.run_digests(periods.find_runs(periods.with_repeats(none))).count() == 0
    keyed = spark.createDataFrame([("k", tune)], "name string, body string")
    assert periods.find_runs(keyed, "name", "body").first().name == "k"


def test_query_equals_a_plain_search(spark):
    found = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    docs = table(spark, FOLDER, "documents").collect()
    assert len(found) == len(docs)
    with_runs = 0
    for d in docs:
        words = WORD.findall(d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        with_runs += bool(runs)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in runs)]
        best = min(runs, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
        row = found[d.doc_id]
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == ((best[0], best[1] - best[0], best[2]) if best else (None,) * 3)
        assert row.exponent_milli == (1000 * row.length // row.period if best else None)
        listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        assert row.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert with_runs > 10


def test_strongest_of_equal_ratios(spark):
    rows = [([(5, 48, 2), (9, 24, 1)],), ([(0, 30, 3), (40, 40, 4)],), ([],)]
    frame = spark.createDataFrame(rows, "runs array<struct<start: bigint, length: bigint, period: bigint>>")
    best = [r[0] for r in frame.select(periods.strongest(F.col("runs"))).collect()]
    assert [b and tuple(b) for b in best] == [(5, 48, 2), (0, 30, 3), None]

"""Language-model scores against exact counts, and the filter by itself."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import language
from evalspark.llm.common import WORD, table
from evalspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [*WORD.findall((text or "").translate(FOLD)), None]


def plain_model(texts):
    singles, pairs = collections.Counter(), collections.Counter()
    for t in texts:
        tokens = tokens_of(t)
        singles.update(tokens)
        pairs.update(zip(["start", *tokens[:-1]], tokens))
    return singles, pairs


def plain_scores(texts, singles, pairs):
    """n_tokens, n_known, base and smoothed log10 probability, without a filter and its errors."""
    n, v = sum(singles.values()), len(singles)
    betas = np.linspace(0, 1, 101)
    sums = np.log([sum(c**b for c in singles.values()) for b in betas]) if v else None
    beta = np.interp(math.log(len(pairs)), sums, betas) if v else 0
    for t in texts:
        tokens, base, score = tokens_of(t), 0.0, 0.0
        for h, w in zip(["start", *tokens[:-1]], tokens):
            p = (singles[w] + 0.1) / (n + 0.1 * (v + 1))
            c = singles[None] if h == "start" else singles[h]
            level = 1 + int(math.floor(math.log(pairs[h, w]) / math.log(1.5) + 1e-9)) if pairs[h, w] else 0
            members = [k for k in range(1, 4 * pairs[h, w] + 2) if level and 1.5 ** (level - 1) <= k < 1.5**level]
            read = min(sum(members) / len(members), c, singles[w]) if members else 0
            follow = c**beta if c else 1.0
            base += math.log10(p)
            score += math.log10((read + follow * p) / (c + follow))
        yield len(tokens), sum(singles[w] > 0 for w in tokens), base, score


def test_filter_forgets_nothing_and_errs_rarely():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 40_000).astype(np.uint64))
    counts = np.maximum(1, rng.pareto(1, len(keys)) * 2).astype(np.int64)
    known, unknown = keys[::2], keys[1::2]
    bits = language.filter_bits(known, counts[::2])
    held = language.Held([b"", b"", b"", b"", bits.tobytes()], np.array([8 * len(bits)], np.uint64))
    levels, want = held.levels(known), language.levels_of(counts[::2])
    assert (levels >= want).all() and (levels > want).mean() < 0.05
    wrong = held.levels(unknown) > 0
    assert 0.02 < wrong.mean() < 0.045


def test_levels():
    counts = np.arange(1, 5000)
    levels = language.levels_of(counts)
    assert (1.5 ** (levels - 1) <= counts).all() and (counts < 1.5**levels).all()
    for level in np.unique(levels)[:-1]:
        assert language.LEVEL_VALUES[level] == counts[levels == level].mean()


def test_equal_keys_are_told_apart_by_tags():
    keys = np.array([5, 5, 7, 5], np.uint64)
    tags = np.array([2, 1, 1, 2], np.uint32)
    got = language.summed(keys, tags, np.array([1, 10, 100, 1000], np.uint32))
    assert [g.tolist() for g in got] == [[5, 5, 7], [1, 2, 1], [10, 1001, 100]]
    asked = np.array([5, 5, 5, 7, 8, 0], np.uint64), np.array([2, 1, 3, 1, 1, 1], np.uint32)
    assert language.picked(got[2], language.locate(*got[:2], *asked)).tolist() == [1001, 10, 0, 100, 0, 0]


def test_query_against_exact_counts(spark):
    found = {r.doc_id: r for r in QUERIES["op12_language_scores"](spark, FOLDER).collect()}
    docs = table(spark, FOLDER, "documents").collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 10 == 0 for d in docs}
    singles, pairs = plain_model([d.text for d in docs if not held[d.doc_id]])
    assert len(found) == len(docs)
    gaps = []
    for d, (n, known, base, score) in zip(docs, plain_scores([d.text for d in docs], singles, pairs)):
        row = found[d.doc_id]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[d.doc_id], n, known, sum(singles.values()))
        assert row.base_score == pytest.approx(base, rel=1e-9)
        # A pair that the filter takes for one it holds, or for one more frequent, raises its probability.
        assert row.score >= score - 1e-6 * abs(score)
        gaps.append((row.score - score) / n)
    assert 0 <= np.mean(gaps) < 0.03
    # The model says more of texts it has not seen than counts of single tokens do.
    unseen = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_both_ways_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(language, "SHARD_BYTES", 40_000)
    monkeypatch.setattr(language, "CHUNK_BYTES", 10_000)
    docs = table(spark, FOLDER, "documents").select("doc_id", "text")
    twice = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None), (None, "a B")], docs.schema))
    rows = [
        language.language_scores(twice, ~language.held_out(), broadcast_bytes=limit).collect() for limit in (1 << 30, -1)
    ]
    one, other = (sorted(map(tuple, r), key=str) for r in rows)
    assert len(one) == docs.count() + 7 and one == other


def test_probabilities_of_followers_sum_to_one():
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdefgh", [9, 7, 5, 3, 1, 1, 1, 1], k=30)) for _ in range(40)]
    singles, pairs = plain_model(texts)
    n, v, beta = sum(singles.values()), len(singles), 0.6
    for h in "ah":
        c = singles[h]
        mass = sum((pairs[h, w] + c**beta * (singles[w] + 0.1) / (n + 0.1 * (v + 1))) / (c + c**beta) for w in singles)
        assert mass == pytest.approx(1, abs=0.01) and mass < 1


def test_odd_rows(spark):
    long = "alpha beta " * 300_000
    rows = [(1, "A b a", 1), (1, "A b a", 2), (2, None, 3), (3, "", 4), (4, " \t ", 5), (None, "é 中 a", 6), (5, long, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, keys int")
    for limit in (1 << 30, -1):
        got = language.language_scores(docs, F.col("doc_id") < 5, broadcast_bytes=limit).collect()
        by = {r.doc_id: r for r in got}
        assert len(got) == len(rows) and by[1].train_tokens == 11 and by[1].n_known == 4
        assert all((by[i].n_tokens, by[i].n_known) == (1, 1) for i in (2, 3, 4))
        assert (by[None].n_tokens, by[None].n_known, by[None].learned) == (4, 2, False)
        assert (by[5].n_tokens, by[5].n_known) == (600_001, 1)
        none = language.language_scores(docs, F.lit(None).cast("boolean"), broadcast_bytes=limit).collect()
        assert all(r.score == r.base_score == 0 and r.n_known == r.train_tokens == 0 for r in none)
        assert language.language_scores(docs.limit(0), F.lit(True), broadcast_bytes=limit).count() == 0
    assert re.fullmatch("bigint", dict(language.language_scores(docs, F.lit(True)).dtypes)["doc_id"])

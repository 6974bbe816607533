"""Ranked search against a plain scoring of all documents."""

from __future__ import annotations

import collections
import math
import random
import re

import oracle
import pytest
from pyspark.sql import functions as F

from evalspark.llm import ranking
from evalspark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=10):
    """(item, rank, doc, score) by scoring every document for every item."""
    counted = [(i, collections.Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall((t or "").translate(FOLD)))
    rows = []
    for item, terms in wanted.items():
        scores = []
        for doc, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms
                if t in c
            )
            if score:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort(key=lambda s: s[:3])
        rows += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(scores[:top])]
    return sorted(rows, key=str)


def _random_case(rng):
    words = [f"w{i}" for i in range(60)] + ["É", "中文", "ABc", "abC", "x1", "_", "!"]
    weights = [60 / (i + 1) for i in range(len(words))]
    texts = [rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=rng.randrange(0, 30))) for _ in range(150)]
    texts += [texts[3]] * 25 + [None, "", " ?! \x7f"]
    rng.shuffle(texts)
    ids = rng.sample(range(1000), len(texts))
    ids[0] = None
    return list(zip(ids, texts)), [(i, " ".join(rng.choices(words, weights, k=9))) for i in range(20)] + [(20, None), (None, "w1 w9"), (3, "w40"), (21, "absent")]


def test_blocks_and_bundles_do_not_change_results(spark, monkeypatch):
    rng = random.Random(2)
    # Few documents a block and few items a bundle, so that accumulators pass many blocks and are let go.
    monkeypatch.setattr(ranking, "BLOCK_DOCS", 20)
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 100)
    monkeypatch.setattr(ranking, "BUNDLE_ITEMS", 6)
    docs, items = _random_case(rng)
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id bigint, text string, slot int, term string")
    i = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id bigint, text string, block int")
    for top, shares in ((3, ranking.OWNER_SHARES), (10, ()), (40, (0.1, 0.1, 0.9))):
        got = ranking.search(d, i, top=top, shares=shares).collect()
        assert sorted(map(tuple, got), key=str) == plain(docs, items, top)


def test_default_sizes(spark):
    docs, items = _random_case(random.Random(4))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, ranking.search(d, i).collect()), key=str) == plain(docs, items)


def test_repeated_keys_are_documents_of_their_own(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a c"), (2, "c"), (3, "d"), (None, "a")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    i = spark.createDataFrame([("k", "A b")], "item_id string, text string")
    got = ranking.search(d, i).orderBy("rank").collect()
    assert [r.doc_id for r in got][:2] == [1, 1] and got[0].score == got[1].score
    assert [r["rank"] for r in got] == [1, 2, 3, 4] and {r.item_id for r in got} == {"k"}
    assert sorted(map(tuple, got), key=str) == plain(rows, [("k", "A b")])


@pytest.mark.parametrize("side", ["docs", "items", "both"])
def test_empty_tables(spark, side):
    d = spark.createDataFrame([(1, "a")] if side == "items" else [], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "a")] if side == "docs" else [], "item_id bigint, text string")
    assert ranking.search(d, i).count() == 0


def test_very_long_text(spark):
    d = spark.createDataFrame([(1, "long " * 400_000 + "needle"), (2, "needle"), (3, "hay")], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, "needle")], "item_id bigint, text string")
    assert [r.doc_id for r in ranking.search(d, i).orderBy("rank").collect()] == [2, 1]


def test_query_equals_its_sql(spark):
    frame = QUERIES["op11_ranked_search"](spark, FOLDER)
    assert oracle.difference(frame, oracle.connect(FOLDER), ORACLES["op11_ranked_search"]) is None
    assert frame.agg(F.countDistinct("item_id")).first()[0] > 30

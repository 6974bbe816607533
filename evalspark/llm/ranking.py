"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners by the share of documents that hold them, rare terms first. Bundles of
items pass from owner to owner; what they carry is, per item and block of documents, a sparse
accumulator of integer scores. An owner adds the contributions of its own terms and sends the
bundle on; after the last owner the best documents of each block are left and the best of all are
taken. A block holds a bounded number of documents, so no stage gathers a term or an item whole.

An accumulator is let go only when it cannot come among the best of its block any more: when its
score and the most that later owners can add stay below the block's current k-th score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from evalspark.session import materialize

TOP = 10
# Owner i holds the terms that stand in at most this share of the documents, the last one the rest.
OWNER_SHARES = (1 / 64, 1 / 16, 1 / 4)
# Documents of a block, and terms after which a block is closed before that.
BLOCK_DOCS, BLOCK_TERMS = 4096, 1_000_000
# Items of a bundle, on average.
BUNDLE_ITEMS = 256
_ROWS = 65_536

# A term is a longest stretch of characters other than ASCII ones that are no letter or digit.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if chr(b).isalnum() and b < 0x80 or b >= 0x80 else 0x20
    for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, A to Z lower-cased."""
    return text.translate(_FOLD).split()


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct terms of each item: ``key``, ``term``."""
    schema = T.StructType([items.schema[key], T.StructField("term", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, terms = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = sorted(set(terms_of(t or b"")))
                keys += [k] * len(mine)
                terms += mine
            columns = [pa.array(keys, arrow.field(0).type), pa.array(terms, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return items.select(key, F.col(text).cast("binary")).mapInArrow(run, schema).distinct()


_POSTING = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("slot", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("term", T.StringType()),
        T.StructField("tf", T.LongType()),
    ]
)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and term, and one with an empty term for each document with terms.

    ``n`` is the document's number of terms with repeats. Documents are numbered by ``slot``
    within blocks, by ascending key with null keys last; the key itself stands in the row of
    the empty term only. Each input row is a document of its own.
    """
    arrow = to_arrow_schema(_POSTING)

    def rows(number: int, block: list) -> Iterator[pa.RecordBatch]:
        block.sort(key=lambda d: (d[0] is None, d[0]))
        sizes = np.array([len(c) + 1 for _, c in block])
        slots = np.repeat(np.arange(len(block), dtype=np.int32), sizes)
        lengths = np.array([sum(c.values()) for _, c in block], np.int64)
        keys = pa.array([k for k, c in block for k in (k, *[None] * len(c))], pa.int64())
        terms = pa.array([t for _, c in block for t in (b"", *c)], pa.binary()).cast(pa.string())
        counts = np.array([f for _, c in block for f in (0, *c.values())], np.int64)
        table = pa.Table.from_arrays(
            [pa.array(np.full(len(slots), number)), pa.array(slots), keys, pa.array(lengths[slots]), terms, pa.array(counts)],
            schema=arrow,
        )
        yield from table.to_batches(max_chunksize=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks are numbered apart by task; the result is written once and read from there.
        number = TaskContext.get().partitionId() << 32
        block, size = [], 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(terms_of(t or b""))
                if not counts:
                    continue
                block.append((k, counts))
                size += len(counts)
                if len(block) == BLOCK_DOCS or size >= BLOCK_TERMS:
                    yield from rows(number, block)
                    number, block, size = number + 1, [], 0
        if block:
            yield from rows(number, block)

    frame = docs.select(F.col(key).cast("bigint"), F.col(text).cast("binary"))
    return frame.mapInArrow(run, _POSTING)


_STATE = (
    "bundle bigint, block bigint, number bigint, terms array<bigint>, owners array<int>, "
    "rests array<bigint>, slots array<int>, scores array<bigint>"
)


def _owner_stage(owner: int, top: int):
    """What an owner does with the items of a bundle and its own postings, in one block."""
    arrow = pa.schema(
        [
            ("bundle", pa.int64()),
            ("block", pa.int64()),
            ("number", pa.int64()),
            ("terms", pa.list_(pa.int64())),
            ("owners", pa.list_(pa.int32())),
            ("rests", pa.list_(pa.int64())),
            ("slots", pa.list_(pa.int32())),
            ("scores", pa.list_(pa.int64())),
        ]
    )

    def stage(carried: pa.Table, own: pa.Table) -> pa.Table:
        terms = own.column("term").to_numpy()
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        slots = own.column("slot").to_numpy()[order]
        added = own.column("added").to_numpy()[order]
        width = 1 + max(
            int(slots.max(initial=-1)),
            max((max(s, default=-1) for s in carried.column("slots").to_pylist()), default=-1),
        )
        states = carried.to_pylist()
        for state in states:
            mine = np.array(state["terms"], np.int64)[np.array(state["owners"]) == owner]
            scores = np.zeros(width, np.int64)
            scores[np.array(state["slots"], np.int64)] = state["scores"]
            for low, high in zip(np.searchsorted(terms, mine), np.searchsorted(terms, mine, side="right")):
                # A term stands once in a document, so no slot is met twice.
                scores[slots[low:high]] += added[low:high]
            held = np.flatnonzero(scores)
            if len(held) > top:
                values = scores[held]
                least = np.partition(values, -top)[-top]
                rest = state["rests"][owner]
                if rest:
                    held = held[values + rest >= least]
                else:
                    # Slots rise with the key, so a stable order settles equal scores.
                    held = np.sort(held[np.argsort(-values, kind="stable")[:top]])
            state["slots"], state["scores"] = held.astype(np.int32), scores[held]
        return pa.Table.from_pylist(states, schema=arrow)

    return stage


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    top: int = TOP,
    shares: tuple[float, ...] = OWNER_SHARES,
) -> DataFrame:
    """The ``top`` best documents of each item: ``item``, ``rank`` from 1, ``key``, ``score``.

    A term of a document of n terms weighs w * ((1000000000 * tf) div (1000 * tf + 8 * m)) with
    m = 10 + (90 * n * N) div L and w = floor(1000 * ln((2N + 2) / (2df + 1))), over N documents
    with terms and L terms in all. Scores are exact integers; equal ones come by ascending key,
    null keys last. Only documents with a score above 0 are listed.

    Each row of ``docs`` is a document of its own, so a key that stands twice can be listed
    twice. Items that share an id, null included, are one item with the terms of all. Null and
    empty texts have no terms; items without any have no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    wanted = materialize(item_terms(items, item, text), "search-items")
    ids = materialize(
        wanted.select(item).distinct().withColumn("number", F.monotonically_increasing_id()), "search-ids"
    )
    vocabulary = materialize(
        wanted.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id() + 1), "search-terms"
    )
    bundles = ids.count() // BUNDLE_ITEMS + 1
    asked = (
        wanted.join(ids, wanted[item].eqNullSafe(ids[item]))
        .join(vocabulary, "term")
        .select(F.pmod(F.xxhash64("number"), F.lit(bundles)).alias("bundle"), "number", F.col("term_id").alias("term"))
    )
    # Rows of terms that no item asks for end here; the empty term has the number 0.
    known = vocabulary.unionByName(spark.range(1).select(F.lit("").alias("term"), F.col("id").alias("term_id")))
    found = materialize(
        postings(docs, key, text)
        .join(known, "term")
        .select("block", "slot", "doc_id", "n", F.col("term_id").alias("term"), "tf"),
        "search-postings",
    )
    documents, held = found.filter("term = 0"), found.filter("term > 0")
    sizes = documents.agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    n_docs, total = sizes.docs, sizes.total or 1
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    owner = sum([(F.col("df") > share * n_docs).cast("int") for share in shares], F.lit(0))
    scored = held.withColumn("m", F.expr(f"10 + (90 * n * {n_docs}L) div {total}L")).withColumn(
        "part", F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)")
    )
    weights = materialize(
        scored.groupBy("term")
        .agg(F.count("*").alias("df"), F.max("part").alias("most"))
        .select("term", weight.alias("w"), owner.alias("owner"), "most")
        .filter("w > 0")
        .withColumn("most", F.col("w") * F.col("most")),
        "search-weights",
    )
    owners = len(shares) + 1
    # What the owners after each one can add to an item at most.
    rests = F.array(
        *[F.coalesce(F.sum(F.when(F.col("owner") > i, F.col("most"))), F.lit(0)).cast("bigint") for i in range(owners)]
    )
    plans = (
        asked.join(weights, "term")
        .groupBy("bundle", "number")
        .agg(F.collect_list("term").alias("terms"), F.collect_list("owner").alias("owners"), rests.alias("rests"))
    )
    contributions = (
        scored.join(weights.select("term", "w", "owner"), "term")
        .join(asked.select("bundle", "term").distinct(), "term")
        .select("bundle", "block", "owner", "term", "slot", (F.col("w") * F.col("part")).alias("added"))
    )
    # A bundle is sent through the blocks that hold any of its terms.
    state = (
        contributions.select("bundle", "block")
        .distinct()
        .join(plans, "bundle")
        .select(
            "bundle", "block", "number", "terms", "owners", "rests",
            F.array().cast("array<int>").alias("slots"), F.array().cast("array<bigint>").alias("scores"),
        )
    )
    for i in range(owners):
        # Columns of their own, since both sides stem from one table.
        own = contributions.filter(F.col("owner") == i).select(
            F.col("bundle").alias("of_bundle"), F.col("block").alias("of_block"), "term", "slot", "added"
        )
        state = (
            state.groupBy("bundle", "block")
            .cogroup(own.groupBy("of_bundle", "of_block"))
            .applyInArrow(_owner_stage(i, top), _STATE)
        )
    best = (
        state.select("number", "block", F.explode(F.arrays_zip("slots", "scores")).alias("hit"))
        .select("number", "block", F.col("hit.slots").alias("slot"), F.col("hit.scores").alias("score"))
        .join(documents.select("block", "slot", F.col("doc_id").alias(key)), ["block", "slot"])
    )
    ordered = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last(key), "block", "slot")
    return (
        best.withColumn("rank", F.row_number().over(ordered))
        .filter(F.col("rank") <= top)
        .join(ids, "number")
        .select(item, "rank", key, "score")
    )

"""Documents whose sets of word n-grams are alike: MinHash bands propose, full sets decide.

Copies are folded first, so only different texts are compared. Texts that agree in a band are
joined to the smallest id of their bucket, which costs one row per member however large the
bucket is; the components of these stars hold every pair that any band proposes. Inside a
component, the proposed pairs are verified on the full n-gram sets, in blocks of bounded size,
and only counts and component labels leave a block. No pairs are emitted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evalspark.llm.common import WORD, map_columns, schema_of
from evalspark.session import materialize

N = 5
SIMILARITY = 0.8
# Chance that a pair at exactly the similarity is proposed, and the hashes it may cost.
RECALL = 0.9995
MAX_HASHES = 128
# Documents of a component that are compared in one block, and rounds before giving up.
BLOCK = 256
MAX_ROUNDS = 40
# Neighbours of a node are spread over this many join keys.
SALTS = 16
_SHINGLES_AT_ONCE = 8192


def bands_for(similarity: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the longest bands whose number reaches the recall within ``most`` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1)
    for rows in range(2, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def word_hashes(text: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in WORD.findall(text)], np.uint64)


def shingles(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams; a shorter text is one n-gram."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = min(n, len(words))
    count = len(words) - n + 1
    mixed = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            mixed = (mixed ^ words[i : i + count]) * np.uint64(0x9FB21C651E98DF25)
            mixed ^= mixed >> np.uint64(35)
    return np.unique(mixed)


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20).integers(1, 1 << 63, (2, count), np.int64).astype(np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of the set's MinHash values; the band's number is part of it."""
    factor, shift = _factors(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(grams), _SHINGLES_AT_ONCE):
            part = grams[i : i + _SHINGLES_AT_ONCE, None] * factor + shift
            least = np.minimum(least, (part >> np.uint64(20)).min(axis=0))
        mixed = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for r in range(rows):
            mixed = (mixed ^ least[r::rows]) * np.uint64(0x9FB21C651E98DF25)
            mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def signatures(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``doc_id``, ``copy`` (128-bit hash of the text) and ``bands``; null for texts without words."""
    bands, rows = bands_for(similarity, recall)

    def build():
        def work(ids, texts):
            copies, sets = [], []
            for text in texts:
                grams = shingles(text or "")
                copies.append(xxhash.xxh128_digest(text) if len(grams) else None)
                sets.append(band_hashes(grams, bands, rows) if len(grams) else None)
            return {"doc_id": ids, "copy": copies, "bands": sets}

        return work

    return map_columns(docs.select("doc_id", "text"), build, "doc_id bigint, copy binary, bands array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id it is connected with, for all ids on ``edges``.

    ``edges`` has ``a`` and ``b``. Large-star and small-star steps alternate until the edges
    stay as they are: each node's larger neighbours are linked to its smallest one, then its
    smaller ones. The number of edges never grows, and each round is written to the shared
    folder. Smallest neighbours are found with map-side minima and salted for the join, so a
    node with very many neighbours meets them in many tasks.
    """
    spark = edges.sparkSession
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.distinct(), "components")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = _with_least(both, least).filter("b > a").select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")
        )
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        edges = materialize(small.union(own).filter("a <> b").distinct(), "small-star")
        state = _state(edges)
        if state == before:
            own = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(own)
        before = state
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds on {spark.sparkContext.appName}")


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", salt).join(copies, ["a", "salt"]).drop("salt")


def _state(edges: DataFrame):
    """Equal for equal sets of edges."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()


def _star_edges(reps: DataFrame) -> DataFrame:
    """Each text linked to the smallest id of each of its buckets with more than one text."""
    members = reps.select("doc_id", F.explode("bands").alias("bucket"))
    leaders = members.groupBy("bucket").agg(F.min("doc_id").alias("b"), F.count("*").alias("n"))
    stars = members.join(leaders.filter("n > 1"), "bucket")
    return stars.select(F.col("doc_id").alias("a"), "b").filter("a <> b").distinct()


class _Block:
    """Documents of one comparison and what was found among them."""

    def __init__(self, ids, sides, bands, texts):
        self.ids, self.sides = np.array(ids, np.int64), np.array(sides)
        self.bands = np.array(bands, np.int64).reshape(len(ids), -1)
        self.sets = [shingles(t) for t in texts]

    def verified(self, same: bool, similarity: float):
        """Links of each document and the smallest id it is connected with in the block."""
        n = len(self.ids)
        sizes = np.array([len(s) for s in self.sets])
        proposed = np.zeros((n, n), bool)
        for column in self.bands.T:
            proposed |= column[:, None] == column[None, :]
        small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
        proposed &= small >= similarity * large
        if not same:
            proposed &= self.sides[:, None] != self.sides[None, :]
        links, root = np.zeros(n, np.int64), list(range(n))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*np.nonzero(np.triu(proposed, 1))):
            a, b = self.sets[i], self.sets[j]
            if len(a) > len(b):
                a, b = b, a
            spot = np.searchsorted(b, a)
            spot[spot == len(b)] = 0
            common = int((b[spot] == a).sum())
            if common >= similarity * (len(a) + len(b) - common):
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                if self.ids[x] > self.ids[y]:
                    x, y = y, x
                root[y] = x
        return links, [int(self.ids[top(i)]) for i in range(n)]


def _verified(parts: DataFrame, similarity: float) -> DataFrame:
    """Links per document and block; rows of a block lie next to each other in one task."""
    schema = schema_of("doc_id bigint, links bigint, root bigint")
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, rows = None, []
        out = [[], [], []]

        def finish():
            if rows:
                ids, sides, bands, texts = zip(*rows)
                links, roots = _Block(ids, sides, bands, texts).verified(key[1] == key[2], similarity)
                for into, values in zip(out, (ids, links.tolist(), roots)):
                    into.extend(values)

        for batch in batches:
            for component, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (component, x, y):
                    finish()
                    key, rows = (component, x, y), []
                rows.append(row)
            if len(out[0]) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=arrow)
                out = [[], [], []]
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=arrow)

    keys = ["component", "x", "y"]
    columns = [*keys, "doc_id", "side", "bands", "text"]
    ordered = parts.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "doc_id")
    return ordered.mapInArrow(run, schema)


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links`` and ``n_copies``, one row per document.

    ``class_id`` is the smallest id that a document is linked with, directly or over others;
    ``n_links`` is the number of different texts whose n-gram sets have at least the similarity
    with its own, and ``n_copies`` that of documents with exactly its text. Texts of one to four
    words are one n-gram. Null texts and those without words are linked with nothing. Rows that
    share an id are one document, taken to hold one text. Rows with a null id come back once,
    unlinked, with a null class. An empty table gives an empty result.
    """
    all_rows = materialize(signatures(docs, similarity, recall), "signatures")
    rows = all_rows.filter("doc_id is not null")
    ids = rows.groupBy("doc_id").agg(F.min("copy").alias("copy"))
    copies = ids.filter("copy is not null").groupBy("copy").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")
    )
    copies = materialize(copies, "copies")
    reps = (
        rows.join(copies.select(F.col("rep").alias("doc_id"), "copy"), ["doc_id", "copy"])
        .select("doc_id", "bands").dropDuplicates(["doc_id"])
    )
    reps = materialize(reps, "texts")
    near = components(_star_edges(reps))
    members = _blocks_of(near.select(F.col("id").alias("doc_id"), "component"))
    # The same plan at every size: members are a share of all documents, so they are not broadcast.
    named = members.select("doc_id").distinct().hint("merge")
    texts = docs.select("doc_id", "text").join(named, "doc_id", "left_semi")
    texts = texts.filter("text is not null").dropDuplicates(["doc_id"])
    parts = members.join(reps, "doc_id").join(texts, "doc_id")
    blocks = materialize(_verified(parts, similarity), "links")
    links = blocks.groupBy("doc_id").agg(F.sum("links").alias("n_links")).filter("n_links > 0")
    classes = components(blocks.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    marks = links.join(classes.withColumnRenamed("id", "doc_id"), "doc_id")
    found = copies.join(marks.withColumnRenamed("doc_id", "rep"), "rep", "left").select(
        "copy", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"
    )
    named = ids.join(found, "copy", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )
    nameless = all_rows.filter("doc_id is null").select("doc_id").limit(1).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")
    )
    return named.union(nameless)


def _blocks_of(near: DataFrame) -> DataFrame:
    """Each document once for every pair of blocks of its component that its block is part of.

    Components of up to ``BLOCK`` documents are one block; larger ones are split by a hash of the
    id, and every pair of their blocks is compared once.
    """
    sizes = near.groupBy("component").agg(F.count("*").alias("n"))
    split = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    rows = near.join(sizes, "component").withColumn("split", split)
    rows = rows.withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("split")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("split") - 1))
    rows = rows.select("doc_id", "component", "side", other.alias("other"))
    return rows.select(
        "doc_id", "component", "side", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the class's smallest, with all their columns."""
    first = similar_groups(docs).filter("doc_id = class_id").select("doc_id")
    return docs.join(first, "doc_id", "left_semi").select(*docs.columns)

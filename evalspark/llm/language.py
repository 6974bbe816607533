"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

The filter holds, for a pair of neighbouring words of count c, the pair with each level from 1 to
1 + floor(log_BASE c). Its level is read back by probing upwards until a level is missing. Levels
never come out too low; a missing pair is taken for one of level 1 with probability 2^-PROBES.

Single tokens are counted exactly, told apart by 96 bits of a hash. A context of count c is taken
to have c^beta different followers, with beta such that all contexts together have as many pairs
as the corpus has, and smoothing gives unseen followers as much weight (Witten and Bell):

    P(w | h) = (c(h w) + c(h)^beta * P(w)) / (c(h) + c(h)^beta),  P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

The model is made and kept in shards, ranges of the hash, whose number follows the size of the
texts. Up to ``BROADCAST_BYTES`` it is broadcast whole; beyond that the probes go to the shards
and the answers come back to the texts. Both ways read the same bits and give the same scores.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evalspark.llm.common import schema_of
from evalspark.session import materialize

# A level is a factor of this in the count.
BASE = 1.5
# Bits looked at per probe of the filter, and bits spent per entry for it.
PROBES = 5
BITS = PROBES / np.log(2)
# A model of at most so many bytes is broadcast.
BROADCAST_BYTES = 192 << 20
# Bytes of text per shard and per block of texts.
SHARD_BYTES = 16 << 20
# Bytes of text taken up at once, and n-grams that a task holds before it sends them.
CHUNK_BYTES, HELD = 1 << 20, 1_000_000
# What every token is counted too much, for tokens never seen.
ADDED = 0.1

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
_START = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
_BETAS = np.linspace(0, 1, 101)
# Integers of each level, averaged: what a level is read as.
_EDGES = BASE ** np.arange(0, 110)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _HALF)) * _TURN
    return (values ^ (values >> _HALF)) * _MIX


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE c) for counts from 1 on."""
    return np.searchsorted(_EDGES, counts, side="right")


def _level_values() -> np.ndarray:
    low = np.ceil(_EDGES[:-1])
    high = np.ceil(_EDGES[1:]) - 1
    return np.r_[0.0, (low + high) / 2]


LEVEL_VALUES = _level_values()


class Tokens:
    """The tokens of some texts: ``ids`` into ``keys`` and ``tags``, with an end after each text."""

    def __init__(self, texts: list[bytes]):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        end = numbers[b""]
        flat, sizes = [], []
        for text in texts:
            words = text.translate(_LOWER).split()
            flat += [numbers[w] for w in words]
            flat.append(end)
            sizes.append(len(words) + 1)
        self.ids = np.array(flat, np.int64)
        self.sizes = np.array(sizes, np.int64)
        digests = b"".join([xxhash.xxh3_128_digest(w) for w in numbers])
        both = np.frombuffer(digests, "<u8").reshape(-1, 2)
        self.keys, self.tags = both[:, 0].copy(), (both[:, 1] >> _HALF).astype(np.uint32)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, per_word: np.ndarray, first) -> np.ndarray:
        """For each token, what ``per_word`` says of the token before it; ``first`` at a start."""
        before = np.empty(len(self.ids), per_word.dtype)
        if not len(before):
            return before
        before[1:] = per_word[self.ids[:-1]]
        before[self.starts] = first
        return before

    def pairs(self) -> np.ndarray:
        """The hash of each token with the one before it."""
        return _mixed(_mixed(self.of(self.keys, _START)) + self.keys[self.ids])


def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in portions of about ``CHUNK_BYTES`` of text; texts come last."""
    sizes = pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)
    portions = (np.cumsum(sizes, dtype=np.int64) - sizes) // CHUNK_BYTES
    starts = np.flatnonzero(np.r_[len(sizes) > 0, portions[1:] != portions[:-1]]) if len(sizes) else []
    for start, end in zip(starts, [*starts[1:], len(sizes)]):
        yield batch.slice(start, end - start)


def summed(keys: np.ndarray, tags: np.ndarray, counts: np.ndarray):
    """Distinct (key, tag) in order, with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, tags, counts = keys[order], tags[order], counts[order]
    again = keys[1:] == keys[:-1]
    if (tags[1:] != tags[:-1])[again].any():
        order = np.lexsort((tags, keys))
        keys, tags, counts = keys[order], tags[order], counts[order]
        again = (keys[1:] == keys[:-1]) & (tags[1:] == tags[:-1])
    first = np.flatnonzero(np.r_[len(keys) > 0, ~again]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], tags[first], np.add.reduceat(counts, first, dtype=counts.dtype) if len(first) else counts


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The range of hashes a key falls in; rises with the key."""
    # Two halves, so that the product stays below 64 bits for up to 2^32 shards.
    return ((keys >> _HALF) * np.uint64(shards) >> _HALF).astype(np.int64)


_SENT = "kind string, shard bigint, block bigint, keys binary, tags binary, counts binary"
_PACKED = [(name, pa.binary()) for name in ("keys", "tags", "counts")]
# A piece keeps counts in a byte each; those from here on stand in ``large`` too.
_FULL = 255
_SENT_ARROW = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("block", pa.int64()), *_PACKED])


def _sent(kind: str, shards: int, block: int, keys, tags, counts) -> pa.RecordBatch:
    """One row per shard; the keys are in order."""
    at = shard_of(keys, shards)
    own = np.unique(at)
    low, high = np.searchsorted(at, own), np.searchsorted(at, own, side="right")
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(own)),
            pa.array(own),
            pa.array(np.full(len(own), block)),
            *(pa.array([c[a:b].tobytes() for a, b in zip(low, high)], pa.binary()) for c in (keys, tags, counts)),
        ],
        schema=_SENT_ARROW,
    )


def _joined(table: pa.Table):
    """The arrays of rows made by ``_sent``, one after the other."""
    kinds = (("keys", "<u8"), ("tags", "<u4"), ("counts", "<u4"))
    return tuple(np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in kinds)


class Tally:
    """N-grams of a task, added up as they come."""

    def __init__(self, kind: str, shards: int):
        self.kind, self.shards = kind, shards
        self.parts, self.size = [], 0

    def add(self, keys, tags, counts) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, tags, counts.astype(np.uint32)))
        self.size += len(keys)
        if self.size >= HELD:
            self.parts = [summed(*map(np.concatenate, zip(*self.parts)))]
            self.size = len(self.parts[0][0])
            if self.size >= HELD // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield _sent(self.kind, self.shards, 0, *summed(*map(np.concatenate, zip(*self.parts))))
        self.parts, self.size = [], 0


_PIECE = (
    "kind string, shard bigint, entries bigint, tokens bigint, sums array<double>, "
    "keys binary, tags binary, counts binary, large binary"
)
_PIECE_ARROW = pa.schema(
    [
        ("kind", pa.string()),
        *((name, pa.int64()) for name in ("shard", "entries", "tokens")),
        ("sums", pa.list_(pa.float64())),
        *_PACKED,
        ("large", pa.binary()),
    ]
)


_COLUMNS = ["keys", "tags", "counts", "large"]


def positions(keys: np.ndarray, level: int, probe: int, width) -> np.ndarray:
    """The bit that a key with a level sets at a probe, in a filter of ``width`` bits."""
    first = _mixed(keys + np.uint64(level * int(_TURN) % 2**64))
    step = _mixed(first) | np.uint64(1)
    return (first + np.uint64(probe) * step) % width


def filter_bits(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The Bloom filter of the keys with each of their levels, as bytes."""
    levels = levels_of(counts)
    entries = int(levels.sum())
    width = np.uint64(8 * (int(entries * BITS) // 8 + 1))
    bits = np.zeros(int(width), bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        mine = keys[levels >= level]
        for probe in range(PROBES):
            bits[positions(mine, level, probe, width)] = True
    return np.packbits(bits)


def _piece(table: pa.Table) -> pa.Table:
    """A shard of the model: exact counts of tokens, or the filter of its pairs."""
    kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
    keys, tags, counts = _joined(table)
    keys, tags, counts = summed(keys, tags, counts.astype(np.int64))
    sums: list[float] = []
    if kind == "token":
        sizes, often = np.unique(counts, return_counts=True)
        sums = (often @ sizes[:, None] ** _BETAS).tolist()
        small = np.minimum(counts, _FULL).astype(np.uint8)
        packed = keys.tobytes(), tags.tobytes(), small.tobytes(), counts[small == _FULL].tobytes()
    else:
        packed = filter_bits(keys, counts).tobytes(), b"", b"", b""
    row = dict(zip(_COLUMNS, packed))
    row |= {"kind": kind, "shard": shard, "entries": len(keys), "tokens": int(counts.sum()), "sums": sums}
    return pa.Table.from_pylist([row], schema=_PIECE_ARROW)


@dataclass(frozen=True)
class Model:
    """A trained model: its pieces as a table, and what all of them have in common."""

    pieces: DataFrame
    shards: int
    blocks: int
    tokens: int
    types: int
    beta: float
    size: int


# The columns of a whole model: those of the token pieces, and the filters of the pair pieces.
_PARTS = [("token", "keys"), ("token", "tags"), ("token", "counts"), ("token", "large"), ("pair", "keys")]


class Held:
    """A model, or a piece of it, in memory: counts of tokens and levels of pairs by their hashes.

    ``parts`` are the ``_PARTS`` of the shards one after the other, ``widths`` the bits of each
    shard's filter. Nothing is copied, so tasks of a worker share what has been broadcast to it.
    """

    def __init__(self, parts: list[bytes], widths: np.ndarray):
        kinds = ("<u8", "<u4", "u1", "<i8", "u1")
        self.keys, self.tags, self.small, self.large, self.bits = map(np.frombuffer, parts, kinds)
        self.full = np.flatnonzero(self.small == _FULL)
        self.widths, self.offsets = widths, np.cumsum(widths) - widths

    @classmethod
    def of_rows(cls, rows: list[dict], shards: int) -> Held:
        rows = sorted(rows, key=lambda r: r["shard"])
        parts = [b"".join(r[column] for r in rows if r["kind"] == kind) for kind, column in _PARTS]
        return cls(parts, widths_of([(r["shard"], len(r["keys"])) for r in rows if r["kind"] == "pair"], shards))

    def counts(self, keys: np.ndarray, tags: np.ndarray) -> np.ndarray:
        at = locate(self.keys, self.tags, keys, tags)
        got = picked(self.small, at).astype(np.int64)
        full = got == _FULL
        got[full] = self.large[np.searchsorted(self.full, at[full])]
        return got

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level of each key up to which its filter holds all levels, 0 for none."""
        found = np.zeros(len(keys), np.int64)
        shards = shard_of(keys, len(self.widths))
        alive = np.flatnonzero(self.widths[shards])
        keys, shards, level = keys[alive], shards[alive], 0
        while len(alive):
            level += 1
            for probe in range(PROBES):
                at = positions(keys, level, probe, self.widths[shards]) + self.offsets[shards]
                hit = (self.bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0
                alive, keys, shards = alive[hit], keys[hit], shards[hit]
            found[alive] = level
        return found


def widths_of(sizes: list[tuple[int, int]], shards: int) -> np.ndarray:
    """The bits of each shard's filter, from pairs of shard and bytes."""
    widths = np.zeros(shards, np.uint64)
    for shard, size in sizes:
        widths[shard] = 8 * size
    return widths


class Answered:
    """What shards have answered for a block: as ``Held``, for the keys asked for."""

    def __init__(self, table: pa.Table):
        kinds = np.array(table.column("kind").to_pylist(), object)
        tokens, pairs = (table.filter(pa.array(kinds == k, pa.bool_())) for k in ("token", "pair"))
        self.known, self.paired = self._arrays(tokens), self._arrays(pairs)

    @staticmethod
    def _arrays(table: pa.Table):
        kinds = (("keys", "<u8"), ("tags", "<u4"), ("counts", "<i8"))
        keys, tags, counts = (np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in kinds)
        order = np.lexsort((tags, keys))
        return keys[order], tags[order], counts[order]

    def counts(self, keys: np.ndarray, tags: np.ndarray) -> np.ndarray:
        return picked(self.known[2], locate(*self.known[:2], keys, tags))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return picked(self.paired[2], locate(*self.paired[:2], keys, np.zeros(len(keys), np.uint32)))


def locate(have, have_tags, keys, tags) -> np.ndarray:
    """The place of each (key, tag) among those in order, -1 if it is missing."""
    found = np.full(len(keys), -1)
    at = np.searchsorted(have, keys)
    alive = np.arange(len(keys))
    # More than one step only where different tokens share a key.
    while True:
        inside = at < len(have)
        alive, at = alive[inside], at[inside]
        same = have[at] == keys[alive]
        alive, at = alive[same], at[same]
        if not len(alive):
            return found
        equal = have_tags[at] == tags[alive]
        found[alive[equal]] = at[equal]
        alive, at = alive[~equal], at[~equal] + 1


def picked(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values at these places, 0 at -1."""
    if not len(values):
        return np.zeros(len(at), values.dtype)
    return np.where(at >= 0, values[np.maximum(at, 0)], 0)


def _train(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pairs = Tally("token", shards), Tally("pair", shards)
        for batch in batches:
            for part in chunks(batch):
                block = Tokens(part.filter(part.column(0)).column(1).to_pylist())
                often = np.bincount(block.ids, minlength=len(block.keys))
                used = often > 0
                yield from tokens.add(block.keys[used], block.tags[used], often[used])
                keys, counts = np.unique(block.pairs(), return_counts=True)
                yield from pairs.add(keys, np.zeros(len(keys), np.uint32), counts)
        yield from tokens.flush()
        yield from pairs.flush()

    return run


def _frame(docs: DataFrame, learn: Column, key: str, text: str) -> DataFrame:
    return docs.select(
        F.col(key),
        F.coalesce(learn, F.lit(False)).alias("learned"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
    )


def _trained(frame: DataFrame) -> Model:
    sized = frame.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = blocks = sized // SHARD_BYTES + 1
    sent = frame.select("learned", "body").mapInArrow(_train(shards), _SENT)
    pieces = materialize(sent.groupBy("kind", "shard").applyInArrow(_piece, _PIECE), "language-model")
    packed = sum([F.octet_length(c).cast("bigint") for c in _COLUMNS], F.lit(0))
    by = {
        r.kind: r
        for r in pieces.groupBy("kind")
        .agg(
            F.sum("entries").alias("entries"),
            F.sum("tokens").alias("tokens"),
            F.sum(packed).alias("size"),
        )
        .collect()
    }
    if "token" not in by:
        return Model(pieces, shards, blocks, 0, 0, 0.0, 0)
    numbered = pieces.filter("kind = 'token'").select(F.posexplode("sums").alias("i", "part"))
    powers = {r.i: r.total for r in numbered.groupBy("i").agg(F.sum("part").alias("total")).collect()}
    sums = np.log([powers[i] for i in range(len(_BETAS))])
    beta = float(np.interp(np.log(by["pair"].entries), sums, _BETAS))
    size = sum(r.size for r in by.values())
    return Model(pieces, shards, blocks, by["token"].tokens, by["token"].entries, beta, size)


def _scores(tokens: Tokens, lookup, model: Model) -> dict[str, np.ndarray]:
    """Per text: tokens, known ones, and both log10 probabilities."""
    counts = lookup.counts(tokens.keys, tokens.tags).astype(float)
    own = counts[tokens.ids]
    # A text starts as often as one ends; the end is the word of number 0.
    before = tokens.of(counts, counts[0])
    single = (own + ADDED) / (model.tokens + ADDED * (model.types + 1))
    pair = np.zeros(len(own))
    asked = np.flatnonzero((own > 0) & (before > 0))
    read = LEVEL_VALUES[lookup.levels(tokens.pairs()[asked])]
    pair[asked] = np.minimum(read, np.minimum(own[asked], before[asked]))
    followers = np.where(before > 0, before**model.beta, 1.0)
    smooth = (pair + followers * single) / (before + followers)
    return {
        "n_tokens": tokens.sizes,
        "n_known": np.add.reduceat((own > 0).astype(np.int64), tokens.starts),
        "base_score": np.add.reduceat(np.log10(single), tokens.starts),
        "score": np.add.reduceat(np.log10(smooth), tokens.starts),
    }


def _scored_rows(keys: pa.Array, learned: pa.Array, got: dict, model: Model, schema: pa.Schema) -> list[pa.Array]:
    got = got | {"train_tokens": np.full(len(keys), model.tokens, np.int64)}
    return [keys.cast(schema.field(0).type), learned] + [pa.array(got[f.name], f.type) for f in list(schema)[2:]]


def _broadcast_scores(frame: DataFrame, model: Model, schema: pa.Schema, out: str) -> DataFrame:
    plain = {k: getattr(model, k) for k in ("tokens", "types", "beta")}
    context = frame.sparkSession.sparkContext
    sizes, parts = [], []
    # One column at a time passes through the driver.
    for kind, column in _PARTS:
        rows = model.pieces.filter(F.col("kind") == kind).select("shard", column).toLocalIterator()
        packed = sorted((r[0], bytes(r[1])) for r in rows)
        if kind == "pair":
            sizes = [(shard, len(part)) for shard, part in packed]
        parts.append(context.broadcast(b"".join(part for _, part in packed)))
    widths = widths_of(sizes, model.shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, held = Model(None, 0, 0, size=0, **plain), Held([part.value for part in parts], widths)
        for batch in batches:
            for part in chunks(batch):
                got = _scores(Tokens(part.column(2).to_pylist()), held, small)
                yield pa.RecordBatch.from_arrays(
                    _scored_rows(part.column(0), part.column(1), got, small, schema), schema=schema
                )

    return frame.mapInArrow(run, out)


def _routed_scores(frame: DataFrame, model: Model, schema: pa.Schema, out: str) -> DataFrame:
    shards, plain = model.shards, {k: getattr(model, k) for k in ("tokens", "types", "beta")}
    blocked = frame.withColumn("block", F.pmod(F.xxhash64(frame.columns[0], "body"), F.lit(model.blocks)))
    none = np.zeros(0, np.uint32)

    def ask(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        tokens = Tokens(table.column("body").to_pylist())
        keys, tags, _ = summed(tokens.keys, tokens.tags, np.ones(len(tokens.keys), np.uint32))
        pairs = np.unique(tokens.pairs())
        both = [("token", keys, tags), ("pair", pairs, np.zeros(len(pairs), np.uint32))]
        return pa.Table.from_batches([_sent(kind, shards, number, k, t, none) for kind, k, t in both])

    def answer(asked: pa.Table, piece: pa.Table) -> pa.Table:
        held, rows = Held.of_rows(piece.to_pylist(), shards), asked.to_pylist()
        for row in rows:
            keys, tags = np.frombuffer(row["keys"], "<u8"), np.frombuffer(row["tags"], "<u4")
            got = held.counts(keys, tags) if row["kind"] == "token" else held.levels(keys)
            row["counts"] = got.tobytes()
        return pa.Table.from_pylist(rows, schema=asked.schema)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        small = Model(None, 0, 0, size=0, **plain)
        got = _scores(Tokens(table.column("body").to_pylist()), Answered(answers), small)
        keys, learned = (table.column(i).combine_chunks() for i in (0, 1))
        return pa.Table.from_arrays(_scored_rows(keys, learned, got, small, schema), schema=schema)

    asked = blocked.groupBy("block").applyInArrow(ask, _SENT)
    pieces = model.pieces.select(F.col("kind").alias("of"), F.col("shard").alias("at"), "kind", "shard", *_COLUMNS)
    answers = (
        asked.groupBy("kind", "shard").cogroup(pieces.groupBy("of", "at")).applyInArrow(answer, _SENT)
    )
    return (
        blocked.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(score, out)
    )


def language_scores(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Score every text with a model of the texts that ``learn`` is true for.

    Returns per input row ``key``, ``learned``, ``n_tokens``, ``n_known`` (tokens that stand in the
    learned texts), ``train_tokens`` and two log10 probabilities of the text: ``base_score`` from
    exact counts of single tokens, ``score`` from the pair model. Tokens are the words between
    ASCII white space, A to Z lower-cased, and one end per text.

    A null or empty text is its end alone. A null ``learn`` counts as false. Repeated rows are
    counted and scored each by itself, null keys are kept, other columns are not read. Without any
    learned text all probabilities are 1.
    """
    frame = _frame(docs, learn, key, text)
    model = _trained(frame)
    kind = frame.schema[key].dataType.simpleString()
    out = (
        f"`{key}` {kind}, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )
    schema = to_arrow_schema(schema_of(out))
    scores = _broadcast_scores if model.size <= broadcast_bytes else _routed_scores
    return scores(frame, model, schema, out)


def held_out(key: str = "doc_id") -> Column:
    """The tenth of the ids that is kept from learning; a null id is learned from."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(crc % 10 == 0, F.lit(False))

"""Bytes of documents that repeat fifty-byte strings of documents with smaller ids.

Suffix arrays are built only where something repeats. A fifty-byte string has one anchor, the
sixteen bytes in it with the smallest hash, so equal strings have equal anchors at equal places.

1. Each shard (an Arrow batch of documents) sends the sorted keys of its anchors, one entry per
   key however many of its documents hold it, to buckets by key.
2. A bucket merges the shards' lists by binary search and returns the anchors that more than one
   document holds.
3. Shards cut out the strings around these anchors: the union of all windows that an anchor
   stands for. Equal cuts within a shard are settled there; one of each goes to its bucket.
4. A bucket settles equal cuts by their smallest id. Of the anchors that are left with different
   cuts, it builds the suffix array by Larsson-Sadakane refinement and the common prefixes by
   Kasai's rule, both in numpy. Neighbours with fifty common bytes are equal windows; the smallest
   id of such a run decides for all the others.

An anchor that very many documents hold, with different bytes around it, would make one bucket
large. Its cuts are single windows, dealt by their own hash.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from evalspark.llm.common import map_columns, schema_of

LENGTH = 50
# Bytes of an anchor; any LENGTH bytes hold SPREAD of them.
ANCHOR = 16
SPREAD = LENGTH - ANCHOR + 1
# Bytes of documents per bucket, per shard whose cuts are held at once, and per array operation.
BUCKET_BYTES = 4_000_000
SHARD_BYTES = 8_000_000
BLOCK = 2_000_000
# Bytes of documents whose anchors are sought together: few enough for arrays that stay in a core's cache.
TOGETHER = 100_000
# Compression of what is shuffled.
LEVEL = 3
# From this many documents on, an anchor's windows are dealt one by one.
HOT = 5_000
# A start takes 31 bits, since a text has at most 2 GB; of rows that share an id, a mark of the
# text stands above it.
_START_BITS = 31
_MARKS = (1 << 25) - 1
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    size = 1
    while size < 8:
        padded = (padded[:-size] << np.uint64(8 * size)) | padded[size:]
        size *= 2
    return padded[: len(data)]


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    words = _words(data)
    n = len(data) - ANCHOR + 1
    with np.errstate(over="ignore"):
        h = words[:n] * _M1 ^ ((words[8 : n + 8] ^ (words[8 : n + 8] >> np.uint64(31))) * _M2)
        h = (h ^ (h >> np.uint64(29))) * _M1
        return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes]):
    """Document number, first and last window (starts within the document) and hash per anchor."""
    found = [[], [], [], []]
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= TOGETHER):
            size += len(texts[stop])
            stop += 1
        for part in _block_anchors(texts[start:stop], start):
            for into, values in zip(found, part):
                into.append(values)
        start = stop
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return tuple(np.concatenate([np.empty(0, k), *f]).astype(k) for f, k in zip(found, kinds))


def _block_anchors(texts: list[bytes], number: int):
    whole = b"".join(texts)
    if len(whole) < LENGTH:
        return
    if len(whole) > BLOCK and len(texts) == 1:
        # A very long document in pieces that overlap by all but one byte of a window.
        for at in range(0, len(whole) - LENGTH + 1, BLOCK):
            piece = whole[at : at + BLOCK + LENGTH - 1]
            for document, first, last, h in _block_anchors_of([piece]):
                yield document + number, first + at, last + at, h
        return
    for document, first, last, h in _block_anchors_of(texts):
        yield document + number, first, last, h


def _block_anchors_of(texts: list[bytes]):
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return
    h = _anchor_hashes(data)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= SPREAD:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = SPREAD - size
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    place = (low & _PLACE).astype(np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    valid = np.ones(len(place), bool)
    for begin, end in zip((ends - lengths).tolist(), ends.tolist()):
        valid[max(begin, end - LENGTH + 1) : end] = False
    windows = np.flatnonzero(valid)
    if not len(windows):
        return
    at = place[windows]
    # A window of another document has an anchor of its own.
    new = np.concatenate([[True], at[1:] != at[:-1]])
    first = windows[new]
    last = windows[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(windows) - 1]])]
    document = np.searchsorted(ends, first, "right")
    begin = (ends - lengths)[document]
    yield document, first - begin, last - begin, h[at[new]]


def _pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<I", len(arrays))
    body = b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes) + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + body)


def _unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (count,) = struct.unpack_from("<I", data)
    at, out = 4, []
    for _ in range(count):
        kind, size = struct.unpack_from("<2sQ", data, at)
        at += 10
        out.append(np.frombuffer(data[at : at + size], kind.decode()))
        at += size
    return out


def _batched(df: DataFrame, work, schema: str) -> DataFrame:
    """``work`` turns the columns of each batch into lists of output columns, or yields several."""
    spark_schema = schema_of(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        for batch in batches:
            for got in work(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(got, arrow)], schema=arrow
                )

    return df.mapInArrow(run, spark_schema)


_BLOBS = "bucket int, kind int, blob binary"
_SHARED = 0
_SETTLED = 1


def _send_anchors(buckets: int):
    """Step 1: keys per bucket; documents of keys that a shard holds twice are settled there."""

    def work(ids, texts):
        encoded = [t.encode() for t in texts]
        document, _, _, h = anchors(encoded)
        if not len(h):
            return
        names = np.array(ids, np.int64)
        code = (h >> np.uint64(1)).astype(np.int64)
        bucket = code % buckets
        key = ((code // buckets) & 0xFFFFFFFF).astype(np.uint32)
        placed = bucket << 32 | key
        # Documents come in their order as a rule, and a stable sort leaves them so.
        in_order = bool((np.diff(names) >= 0).all())
        order = np.argsort(placed, kind="stable") if in_order else np.lexsort((names[document], placed))
        bucket, key, doc = bucket[order], key[order], names[document][order]
        same_key = np.concatenate([[False], (key[1:] == key[:-1]) & (bucket[1:] == bucket[:-1])])
        again = same_key & np.concatenate([[False], doc[1:] == doc[:-1]])
        bucket, key, doc, same_key = (a[~again] for a in (bucket, key, doc, same_key))
        head = np.flatnonzero(~same_key)
        count = np.diff(np.append(head, len(key)))
        many = np.repeat(count > 1, count)
        # Entries by bucket: key, smallest document, how many documents.
        edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[head]) != 0, [True]]))
        out = [[], [], []]
        for low, high in zip(edges[:-1], edges[1:]):
            some = head[low:high]
            out[0].append(int(bucket[some[0]]))
            out[1].append(_SHARED)
            out[2].append(_pack(key[some], _steps(doc[some]), np.minimum(count[low:high], 65535).astype(np.uint16)))
        yield out
        twice = np.flatnonzero(many)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[twice]) != 0, [True]])) if len(twice) else []
        out = [[], [], []]
        for low, high in zip(edges[:-1], edges[1:]):
            some = twice[low:high]
            out[0].append(int(bucket[some[0]]))
            out[1].append(_SETTLED)
            out[2].append(_pack(key[some], _steps(doc[some])))
        yield out

    return work


def _order(keys: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of numbers of at most ``bits`` bits.

    With its place below it a number is like no other. Numpy sorts plain numbers many times
    faster than it finds the stable order of any.
    """
    width = len(keys).bit_length()
    if bits + width > 64:
        return np.argsort(keys, kind="stable")
    placed = keys.astype(np.uint64) << np.uint64(width) | np.arange(len(keys), dtype=np.uint64)
    return (np.sort(placed) & np.uint64((1 << width) - 1)).astype(np.int64)


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0)


def _grouped(df: DataFrame, buckets: int, work, schema: str) -> DataFrame:
    """``work`` on the blobs of one bucket at a time, which lie together in one task."""
    spark_schema = schema_of(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        key, blobs = None, defaultdict(list)

        def finish():
            if blobs:
                for got in work(key, blobs):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, f.type) for v, f in zip(got, arrow)], schema=arrow
                    )

        for batch in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != key:
                    yield from finish()
                    key, blobs = bucket, defaultdict(list)
                blobs[kind].append(blob)
        yield from finish()

    dealt = df.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, spark_schema)


def _merge_anchors(buckets: int, hot: int):
    """Step 2: of one bucket, document and code of the anchors held by several documents."""

    def work(bucket, blobs):
        lists = [_unpack(b) for b in blobs[_SHARED]]
        lists = [(key, np.cumsum(steps), count) for key, steps, count in lists]
        table = np.unique(np.concatenate([key for key, _, _ in lists]))
        least = np.full(len(table), np.iinfo(np.int64).max)
        most = np.full(len(table), np.iinfo(np.int64).min)
        total = np.zeros(len(table), np.int64)
        for key, doc, count in lists:
            # Keys are distinct within a list, so plain assignment is enough.
            at = np.searchsorted(table, key)
            least[at] = np.minimum(least[at], doc)
            most[at] = np.maximum(most[at], doc)
            total[at] += count
        shared = least < most
        is_hot = total >= hot

        def answer(key, doc, some):
            at = np.searchsorted(table, key[some])
            code = key[some].astype(np.int64) * buckets + bucket
            return doc[some], np.where(is_hot[at], -code - 1, code)

        for key, doc, count in lists:
            some = shared[np.searchsorted(table, key)] & (count == 1)
            if some.any():
                yield answer(key, doc, some)
        for key, steps in map(_unpack, blobs[_SETTLED]):
            yield answer(key, np.cumsum(steps), slice(None))

    return work


def _send_cuts(buckets: int):
    """Step 3: one of each cut around a shared anchor; spans of documents that repeat a cut."""

    def work(ids, packed, codes, several):
        inflate = zstandard.ZstdDecompressor()
        start = 0
        while start < len(ids):
            texts, size = [], 0
            while start + len(texts) < len(ids) and size < SHARD_BYTES:
                z = packed[start + len(texts)]
                texts.append(inflate.decompress(z) if z else b"")
                size += len(texts[-1])
            stop = start + len(texts)
            marks = [_mark(t) if s else 0 for t, s in zip(texts, several[start:stop])]
            yield _cut_rows(*_cuts_of(ids[start:stop], texts, codes[start:stop], marks, buckets), buckets)
            start = stop

    return work


def _mark(text: bytes) -> int:
    """What tells a text from others with its id; never 0."""
    return xxhash.xxh64_intdigest(text) % _MARKS + 1


def _cuts_of(ids: list[int], texts: list[bytes], codes: list[list[int]], marks: list[int], buckets: int):
    """Cuts of a shard with bucket, anchor key, and starts by document; spans settled already."""
    document, first, last, h = anchors(texts)
    code = (h >> np.uint64(1)).astype(np.int64)
    bucket, key = code % buckets, (code // buckets) & 0xFFFFFFFF
    code = key * buckets + bucket
    asked = [np.array(c or [], np.int64) for c in codes]
    owner = np.repeat(np.arange(len(asked)), [len(a) for a in asked])
    flat = np.concatenate([np.empty(0, np.int64), *asked])
    cold = flat >= 0
    mixed = _mix(owner, np.where(cold, flat, -flat - 1))
    order = np.argsort(mixed)
    mixed, cold = mixed[order], cold[order]
    wanted = _mix(document, code)
    spot = np.searchsorted(mixed, wanted)
    spot[spot == len(mixed)] = 0
    hit = np.flatnonzero(mixed[spot] == wanted) if len(mixed) else np.empty(0, np.int64)
    cuts: dict[bytes, tuple[int, int, int, list[int]]] = {}
    settled: list[tuple[int, int]] = []

    def add(cut, doc, start, to, key):
        held = cuts.get(cut)
        if held is None:
            cuts[cut] = (doc, to, key, [start])
        elif held[0] == doc:
            held[3].append(start)
        else:
            # Another document of the shard has the same cut: the larger one loses it.
            if held[0] > doc:
                cuts[cut] = (doc, to, key, [start])
                doc, starts = held[0], held[3]
            else:
                starts = [start]
            settled.extend((doc, s * 128 + len(cut)) for s in starts)

    columns = (document[hit], first[hit], last[hit], bucket[hit], key[hit], cold[spot[hit]])
    for d, a, b, to, number, whole in zip(*(c.tolist() for c in columns)):
        text, doc, above = texts[d], ids[d], marks[d] << _START_BITS
        if whole:
            cut, start = text[a : b + LENGTH], above + a
            held = cuts.get(cut)
            if held is None:
                cuts[cut] = (doc, to, number, [start])
            elif held[0] == doc:
                held[3].append(start)
            elif held[0] < doc:
                settled.append((doc, start * 128 + len(cut)))
            else:
                add(cut, doc, start, to, number)
        else:
            for s in range(a, b + 1):
                window = text[s : s + LENGTH]
                add(window, doc, above + s, xxhash.xxh32_intdigest(window) % buckets, number)
    return cuts, settled


def _cut_rows(cuts: dict, settled: list, buckets: int):
    out = [[], [], []]
    parts, held = list(cuts), list(cuts.values())
    docs, buckets_of, keys = (np.array([h[i] for h in held], np.int64) for i in range(3))
    sizes = np.array([len(p) for p in parts], np.uint8)
    # A row per start, those of a bucket together.
    number = np.repeat(np.arange(len(held)), np.array([len(h[3]) for h in held], np.int64))
    starts = np.fromiter(chain.from_iterable(h[3] for h in held), np.int64, len(number))
    order = np.argsort(buckets_of[number], kind="stable")
    number, starts = number[order], starts[order]
    edges = np.flatnonzero(np.diff(buckets_of[number], prepend=-1, append=-1))
    for low, high in zip(edges[:-1], edges[1:]):
        some = number[low:high]
        out[0].append(int(buckets_of[some[0]]))
        out[1].append(_SHARED)
        out[2].append(
            _pack(
                _steps(docs[some]), starts[low:high], keys[some].astype(np.uint32), sizes[some],
                np.frombuffer(b"".join([parts[i] for i in some.tolist()]), np.uint8),
            )
        )
    if settled:
        docs, spans = (np.array(c, np.int64) for c in zip(*settled))
        out[0].append(int(docs[0]) % buckets)
        out[1].append(_SETTLED)
        out[2].append(_pack(docs, spans))
    return out


def _mix(document: np.ndarray, code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = code.astype(np.uint64) * _M1 ^ document.astype(np.uint64) * _M2
        return x ^ (x >> np.uint64(30))


def suffix_ranks(data: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Rank of the ``LENGTH`` bytes from each position on, by Larsson-Sadakane refinement.

    Ranks by the first eight bytes are refined by the rank of the suffix that begins where the
    compared bytes end, doubling them each round. Only positions whose rank is shared are sorted
    again; a rank is the number of the first place of its group. With ``wanted`` only the ranks of
    positions that it marks are complete: a round sorts what they and later rounds look at.
    """
    steps, known = [], 8
    while known < LENGTH:
        steps.append(min(known, LENGTH - known))
        known += steps[-1]
    needs = [np.ones(len(data), bool) if wanted is None else wanted]
    for step in reversed(steps[1:]):
        needs.append(needs[-1].copy())
        needs[-1][step:] |= needs[-2][:-step]
    words = _words(data)
    order = np.argsort(words)
    sorted_words = words[order]
    rank = _group_ranks(order, np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]]))
    bits = max(1, len(data).bit_length())
    for step, need in zip(steps, reversed(needs)):
        counts = np.bincount(rank, minlength=len(data))
        open_ = np.flatnonzero((counts[rank] > 1) & need)
        if not len(open_):
            break
        beyond = open_ + step
        tail = np.where(beyond < len(data), rank[np.minimum(beyond, len(data) - 1)] + 1, 0)
        pair = rank[open_].astype(np.uint64) << np.uint64(bits) | tail.astype(np.uint64)
        by = _order(pair, 2 * bits)
        pair, open_ = pair[by], open_[by]
        group = pair >> np.uint64(bits)
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        head = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(pair))
        inside = place - np.maximum.accumulate(np.where(head, place, 0))
        first = np.maximum.accumulate(np.where(new, place, 0))
        refined = rank.copy()
        refined[open_] = group.astype(np.int32) + inside[first].astype(np.int32)
        rank = refined
    return rank


def _group_ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    place = np.arange(len(order))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    return rank


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Common prefix, up to ``LENGTH``, of each window with its predecessor in ``order``.

    Kasai's rule: if a window shares h bytes with its predecessor, and both go on by a window,
    the next one shares h - 1 at least with its own. Among equal windows, which ``order`` does
    not sort further, that holds if the next one's predecessor follows on the predecessor. The
    rule runs from the front of every cut of ``windows`` windows, all cuts side by side.
    """
    before = np.full(len(data), -2, np.int64)
    before[order[1:]] = order[:-1]
    before[order[:1]] = -1
    out = np.zeros(len(data), np.int64)
    shared = np.zeros(len(starts), np.int64)
    last = np.full(len(starts), -2, np.int64)
    for offset in range(int(windows.max())):
        live = np.flatnonzero(windows > offset)
        at = starts[live] + offset
        other = before[at]
        follows = np.where(last[live] >= 0, before[np.minimum(last[live] + 1, len(data) - 1)] > -2, False)
        holds = follows & ((shared[live] < LENGTH) | (other == last[live] + 1))
        value = np.where(holds & (other >= 0), np.maximum(shared[live] - 1, 0), 0)
        todo = np.flatnonzero((other >= 0) & (value < LENGTH))
        while len(todo):
            same = data[at[todo] + value[todo]] == data[other[todo] + value[todo]]
            todo = todo[same]
            value[todo] += 1
            todo = todo[value[todo] < LENGTH]
        out[at] = value
        shared[live], last[live] = value, other
    return out[order]


def repeated_windows(docs: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each byte of the cuts, whether the window from it on is in a document with a smaller id."""
    starts = np.cumsum(lengths) - lengths
    is_window = np.arange(len(data)) + LENGTH <= np.repeat(starts + lengths, lengths)
    windows = np.flatnonzero(is_window)
    order = windows[_order(suffix_ranks(data, is_window)[windows], len(data).bit_length())]
    group = np.cumsum(common_prefixes(data, order, starts, lengths - LENGTH + 1) < LENGTH) - 1
    owner = np.repeat(docs, lengths)[order]
    first = np.minimum.reduceat(owner, np.flatnonzero(np.diff(group, prepend=-1)))
    found = np.zeros(len(data), bool)
    found[order] = first[group] < owner
    return found


def _judge_cuts():
    """Step 4: document and span (start times 128 plus length) of repeated runs of one bucket."""

    def work(bucket, blobs):
        if blobs[_SHARED]:
            docs, spans, rest = _equal_cuts(map(_unpack, blobs[_SHARED]))
            yield docs, spans
            if len(rest[0]):
                docs, starts, lengths, data = rest
                found = repeated_windows(docs, lengths, data)
                at = np.cumsum(lengths) - lengths
                on = np.flatnonzero(found & ~np.concatenate([[False], found[:-1]]))
                off = np.flatnonzero(found & ~np.concatenate([found[1:], [False]]))
                # The last bytes of a cut begin no window, so a run ends with its cut.
                cut = np.searchsorted(at, on, "right") - 1
                yield docs[cut], (starts[cut] + on - at[cut]) * 128 + (off - on + LENGTH)
        for docs, spans in map(_unpack, blobs[_SETTLED]):
            yield docs, spans

    return work


def _equal_cuts(lists):
    """Spans of cuts that a smaller id has too; the first of each where an anchor has several."""
    first: dict[bytes, tuple[int, int, list[int]]] = {}
    docs_out, spans_out = [], []
    for docs, starts, keys, lengths, data in lists:
        data, at = data.tobytes(), 0
        for doc, start, key, n in zip(np.cumsum(docs).tolist(), starts.tolist(), keys.tolist(), lengths.tolist()):
            cut = data[at : at + n]
            at += n
            held = first.get(cut)
            if held is None:
                first[cut] = (doc, key, [start])
                continue
            if held[0] == doc:
                held[2].append(start)
                continue
            if held[0] < doc:
                docs_out.append(doc)
                spans_out.append(start * 128 + n)
                continue
            first[cut] = (doc, key, [start])
            for s in held[2]:
                docs_out.append(held[0])
                spans_out.append(s * 128 + n)
    keys = np.array([k for _, k, _ in first.values()], np.uint32)
    # A single window has met all its equals above.
    sizes = np.array([len(c) for c in first], np.int64)
    number, times = np.unique(keys, return_counts=True)
    several = (times > 1)[np.searchsorted(number, keys)] & ~_only_single(number, keys, sizes)
    rest = [[], [], []]
    for cut, held, open_ in zip(first, first.values(), several.tolist()):
        if open_:
            for s in held[2]:
                rest[0].append(held[0])
                rest[1].append(s)
                rest[2].append(cut)
    lengths = np.array([len(c) for c in rest[2]], np.int64)
    data = np.frombuffer(b"".join(rest[2]), np.uint8)
    left = (np.array(rest[0], np.int64), np.array(rest[1], np.int64), lengths, data)
    return np.array(docs_out, np.int64), np.array(spans_out, np.int64), left


def _only_single(number: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether all cuts of a cut's anchor are single windows."""
    longest = np.zeros(len(number), np.int64)
    np.maximum.at(longest, np.searchsorted(number, keys), sizes)
    return longest[np.searchsorted(number, keys)] == LENGTH


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id`` and compressed text: what the two joins on ids move."""

    def build():
        def work(ids, texts):
            press = zstandard.ZstdCompressor(level=LEVEL)
            return {"doc_id": ids, "z": [press.compress(t.encode()) if t else None for t in texts]}

        return work

    return map_columns(docs.select("doc_id", "text"), build, "doc_id bigint, z binary")


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id`` and ``span``: pieces of the bytes to remove, as start times 128 plus length.

    Where rows share an id, the start has the text's mark above it.
    """
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = size // BUCKET_BYTES + 16
    sent = _batched(docs, _send_anchors(buckets), _BLOBS)
    asked = _grouped(sent, buckets, _merge_anchors(buckets, hot), "doc_id bigint, code bigint")
    asked = asked.groupBy("doc_id").agg(F.collect_set("code").alias("codes"))
    asked = asked.join(shared.select("doc_id", F.lit(True).alias("several")), "doc_id", "left")
    texts = _packed(docs).join(asked, "doc_id")
    cuts = _batched(texts.select("doc_id", "z", "codes", "several"), _send_cuts(buckets), _BLOBS)
    return _grouped(cuts, buckets, _judge_cuts(), "doc_id bigint, span bigint")


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` per input row.

    Text is UTF-8 bytes; a null text counts as empty. Texts of fewer than ``LENGTH`` bytes lose
    nothing. Rows that share an id lose nothing because of each other; each loses what rows with
    smaller ids hold, also if their texts differ (texts of one id are told apart by 25 hash bits).
    Rows with a null id lose nothing and take nothing.
    """
    spans = repeated_spans(docs, hot).groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    rows = _packed(docs).join(spans, "doc_id", "left")

    def build():
        def work(ids, packed, spans):
            inflate = zstandard.ZstdDecompressor()
            out = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for z, some in zip(packed, spans):
                text = inflate.decompress(z) if z else b""
                kept, removed, runs = _kept(text, _own(text, some or []))
                out["n_bytes"].append(len(text))
                out["n_removed"].append(removed)
                out["n_spans"].append(runs)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            return out

        return work

    return map_columns(
        rows.select("doc_id", "z", "spans"), build,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    )


def _own(text: bytes, spans: list[int]) -> list[int]:
    """The spans of this text, without marks."""
    bits = _START_BITS + 7
    if not any(s >> bits for s in spans):
        return spans
    mark = _mark(text)
    return [s & ((1 << bits) - 1) for s in spans if s >> bits in (0, mark)]


def _kept(text: bytes, spans: list[int]) -> tuple[bytes, int, int]:
    """What is left of the text, how many bytes are gone, and in how many runs."""
    packed = np.sort(np.array(spans, np.int64))
    begin, end = packed // 128, packed // 128 + packed % 128
    reach = np.maximum.accumulate(end) if len(end) else end
    head = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]])) if len(begin) else []
    parts, at, removed = [], 0, 0
    tails = [*head[1:], len(begin)] if len(begin) else []
    for i, j in zip(head, tails):
        low, high = int(begin[i]), int(reach[j - 1])
        parts.append(text[at:low])
        removed += high - low
        at = high
    return b"".join([*parts, text[at:]]), removed, len(head)

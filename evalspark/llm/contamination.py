"""Benchmark passages in documents, by the q-gram lemma.

A passage of n characters that occurs with at most e edits shares at least n - q + 1 - q e of its
q-grams with the document, all of them within e + 1 neighbouring diagonals (position in the
document minus position in the passage). Shared q-grams are counted in bands of 2 e + 1 diagonals
that overlap by e, so that every run of e + 1 diagonals lies in one band. Bands that reach the
bound are verified by an alignment that stays inside the band.

Of items longer than ``PASSAGE`` any stretch of ``REGION`` characters counts, wherever it starts: a
band is searched for places so close that a stretch around them can reach the bound.

Documents stream through once. Only the benchmark, cut into slices of bounded size, travels to
the tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import map_columns, texts_of

Q = 10
# Edits per character of a passage.
MAX_ERROR = 0.08
# Longer items are cut into passages of this many characters, each starting half a passage on.
PASSAGE = 160
# Any stretch of so many characters of a longer item counts, within its own edits.
REGION = 80
REGION_EDITS = int(REGION * MAX_ERROR)
REGION_LEAST = REGION - Q + 1 - Q * REGION_EDITS
# Benchmark characters that one pass over the documents looks for.
SLICE_CHARS = 16_000_000
# Characters of documents that are worked on at once.
BLOCK = 2_000_000
# Candidates that are aligned at once.
ALIGNED = 2_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xD6E8FEB86659FD93)
_TABLE_BITS = 22
_BOUNDARY = 0


def _letters() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalized(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits, one space for all between them, and the texts' starts.

    Each text is followed by a boundary code that no passage holds.
    """
    lowered = [t.lower() for t in texts]
    codes = _codes("\0".join([*lowered, ""])).copy()
    ends = np.cumsum([len(t) + 1 for t in lowered]) - 1
    word = letters[codes]
    keep = word.copy()
    keep[1:] |= word[:-1]
    codes[~word] = 32
    codes[ends] = _BOUNDARY
    keep[ends] = True
    starts = np.zeros(len(texts), np.int64)
    starts[1:] = np.cumsum(keep)[ends[:-1]]
    return codes[keep], starts


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``Q`` codes from each position on."""
    part, size, power = codes.astype(np.uint64) + np.uint64(1), 1, _FACTOR
    whole, done = None, 0
    n = max(0, len(codes) - Q + 1)
    with np.errstate(over="ignore"):
        while done < Q:
            if Q & size:
                piece = part[done : done + n]
                whole = piece.copy() if whole is None else whole * power + piece
                done += size
            if done < Q:
                m = len(part) - size
                part = part[:m] * power + part[size:] if m > 0 else part[:0]
                size, power = 2 * size, power * power
        return whole ^ (whole >> np.uint64(31))


class Grams:
    """The q-grams of passages."""

    def __init__(self, passages: list[np.ndarray]):
        hashes = [gram_hashes(c) for c in passages]
        keys = np.concatenate([np.empty(0, np.uint64), *hashes])
        order = np.argsort(keys, kind="stable")
        self.passage = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[order]
        self.place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(h)) for h in hashes)])[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._slot(self.keys)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (hashes * _MIXER) >> np.uint64(64 - _TABLE_BITS)

    def shared(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, passage and place in the passage of every shared q-gram."""
        if not len(self.keys):
            return (np.empty(0, np.int64),) * 3
        at = np.flatnonzero(self.table[self._slot(hashes)])
        spot = np.searchsorted(self.keys, hashes[at])
        spot[spot == len(self.keys)] = 0
        same = self.keys[spot] == hashes[at]
        at, spot = at[same], spot[same]
        times = self.count[spot]
        entry = np.repeat(self.first[spot] - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.repeat(at, times), self.passage[entry], self.place[entry]


class Passages:
    """Passages of a slice of the benchmark, its longer items whole, and the index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.letters = _letters()
        self.item, self.codes = [], []
        self.long_item, self.long_codes = [], []
        for item, text in items:
            codes, _ = normalized([text or ""], self.letters)
            codes = codes[:-1]
            while len(codes) and codes[-1] == 32:
                codes = codes[:-1]
            if len(codes) > PASSAGE:
                self.long_item.append(item)
                self.long_codes.append(codes)
            last = max(0, len(codes) - PASSAGE)
            for start in sorted({*range(0, last, PASSAGE // 2), last}):
                if len(codes) >= Q:
                    self.item.append(item)
                    self.codes.append(codes[start : start + PASSAGE])
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.minimum(
            (self.length * MAX_ERROR).astype(np.int64), (self.length - Q) // Q
        ).clip(0)
        self.least = self.length - Q + 1 - Q * self.edits
        self.long_length = np.array([len(c) for c in self.long_codes], np.int64)
        self.grams, self.long_grams = Grams(self.codes), Grams(self.long_codes)

    def bands(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passage and first diagonal of the bands that reach the bound of the lemma."""
        at, passage, place = self.grams.shared(hashes)
        step = self.edits[passage] + 1
        # A passage's diagonals begin at minus its length; none is negative after the shift.
        band = (at - place + PASSAGE) // step
        both = np.concatenate([band, band - 1])
        key = np.concatenate([passage, passage]) * np.int64(1 << 40) + both + 1
        key, n = np.unique(key, return_counts=True)
        passage, band = key >> 40, (key & ((1 << 40) - 1)) - 1
        enough = n >= self.least[passage]
        passage, band = passage[enough], band[enough]
        return passage, band * (self.edits[passage] + 1) - PASSAGE

    def regions(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longer item, first diagonal and start of the stretches that reach the bound of the lemma."""
        at, item, place = self.long_grams.shared(hashes)
        step, shift = REGION_EDITS + 1, int(self.long_length.max(initial=0))
        band = (at - place + shift) // step
        key = np.concatenate([item, item]) * np.int64(1 << 40) + np.concatenate([band, band - 1]) + 1
        place = np.concatenate([place, place])
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        ahead = REGION_LEAST - 1
        near = np.flatnonzero(
            (key[ahead:] == key[: len(key) - ahead]) & (place[ahead:] - place[: len(place) - ahead] <= REGION - Q)
        )
        item = key[near] >> 40
        # The starts of stretches that hold all these q-grams; both ends grow along a band.
        first = (place[near + ahead] + Q - REGION).clip(0)
        last = np.minimum(place[near], self.long_length[item] - REGION)
        known = np.zeros(len(near), np.int64)
        known[1:] = np.where(key[near][1:] == key[near][:-1], last[:-1] + 1, 0)
        first = np.maximum(first, known)
        times = (last - first + 1).clip(0)
        start = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        low = ((key[near] & ((1 << 40) - 1)) - 1) * step - shift
        return np.repeat(item, times), np.repeat(low, times), start

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """Text number, item and edits of every verified passage."""
        if not self.codes:
            return
        codes, starts = normalized(texts, self.letters)
        hashes = gram_hashes(codes)
        passage, low = self.bands(hashes)
        known = set()
        by_shape = defaultdict(list)
        for i, p in enumerate(passage.tolist()):
            by_shape[(int(self.length[p]), int(self.edits[p]))].append(i)
        for (n, e), chosen in by_shape.items():
            for k in range(0, len(chosen), ALIGNED):
                some = np.array(chosen[k : k + ALIGNED])
                wanted = np.stack([self.codes[p] for p in passage[some]])
                for i, text, edits in self._verified(codes, starts, wanted, low[some], e):
                    known.add((text, self.item[passage[some[i]]]))
                    yield text, self.item[passage[some[i]]], edits
        item, low, start = self.regions(hashes)
        # Items that a text holds already need no stretch.
        text = np.searchsorted(starts, (low + start + REGION // 2).clip(0), "right") - 1
        new = np.array([(t, self.long_item[i]) not in known for t, i in zip(text.tolist(), item.tolist())], bool)
        item, low, start = item[new], low[new], start[new]
        for k in range(0, len(item), ALIGNED):
            some = slice(k, k + ALIGNED)
            wanted = np.stack([self.long_codes[p][o : o + REGION] for p, o in zip(item[some], start[some])])
            for i, text, edits in self._verified(codes, starts, wanted, low[some] + start[some], REGION_EDITS):
                yield text, self.long_item[item[k + i]], edits

    def _verified(self, codes, starts, wanted, low, e) -> Iterator[tuple[int, int, int]]:
        """Number, text and edits of the passages that are within their edits."""
        n = wanted.shape[1]
        best, end = self._aligned(codes, wanted, low, e)
        for i in np.flatnonzero(best <= e):
            middle = min(max(0, int(end[i]) - n // 2), len(codes) - 1)
            yield int(i), int(np.searchsorted(starts, middle, "right")) - 1, int(best[i])

    def _aligned(self, codes, wanted, low, e):
        """Fewest edits of each passage along its band, and where that alignment ends."""
        n = wanted.shape[1]
        width = 2 * e + 2
        spots = low[:, None] + np.arange(n + width)[None, :]
        inside = (spots >= 0) & (spots < len(codes))
        region = np.where(inside, codes[spots.clip(0, len(codes) - 1)], _BOUNDARY)
        slope = np.arange(width)
        cost = np.zeros((len(wanted), width), np.int64)
        for i in range(n):
            following = cost + (region[:, i : i + width] != wanted[:, i : i + 1])
            following[:, :-1] = np.minimum(following[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(following - slope, axis=1) + slope
        place = cost.argmin(axis=1)
        return cost[np.arange(len(cost)), place], low + n + place


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``BLOCK`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def found_items(passages: Passages, texts: list[str]) -> list[dict[int, int]]:
    """For each text the items found in it, with the fewest edits of a passage."""
    found: list[dict[int, int]] = [{} for _ in texts]
    for start, stop in _blocks(texts):
        for text, item, edits in passages.find(texts[start:stop]):
            into = found[start + text]
            into[item] = min(edits, into.get(item, edits))
    return found


def _slices(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The benchmark in slices of about ``SLICE_CHARS``, each small enough for every task."""
    rows = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    n = total // SLICE_CHARS + 1
    part = F.pmod(F.xxhash64("item_id"), F.lit(n))
    return [
        [tuple(r) for r in rows.filter(part == i).orderBy("item_id", "text").collect()]
        for i in range(n)
    ]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``contaminated``, ``n_items`` and ``items`` (ids in order) per input row.

    Letters are compared without case and with one space for all between them. A null or empty
    text holds nothing; an empty benchmark finds nothing; benchmark rows with a null id or text,
    or with fewer than ``Q`` characters, are not looked for. Repeated rows give repeated results.
    Each slice of the benchmark is one narrow pass; there is no shuffle.
    """
    rows = texts_of(docs).withColumn("items", F.array().cast("array<bigint>"))
    for items in _slices(benchmark):

        def build(items=items):
            passages = Passages(items)

            def work(ids, texts, before):
                found = found_items(passages, texts)
                merged = [sorted({*b, *f}) for b, f in zip(before, found)]
                return {"doc_id": ids, "text": texts, "items": merged}

            return work

        rows = map_columns(rows, build, "doc_id bigint, text string, items array<bigint>")
    return rows.select(
        "doc_id",
        (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"),
        "items",
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns."""
    for items in _slices(benchmark):

        def run(batches, items=items):
            passages = Passages(items)
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                clean = [not f for f in found_items(passages, texts)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

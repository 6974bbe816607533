"""Periodic runs of words, found on a Re-Pair grammar of each text.

A text's stretches that could hold a run are turned into a grammar in which every rule has two
parts. A run lies inside the smallest part of the derivation that holds all of it, and there it
crosses the border of the two halves. So the runs across the border of each rule are computed once
per rule, moved to every place where the rule is derived, and intervals of one period that belong
together are merged.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import map_columns

# A run has this many words at least, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
# Every word of a run lies in a string of so many words that stands in the text again: a run's
# first and last two thirds are equal, and two thirds of the shortest run are so many words.
_ECHO = LEAST_WORDS - LEAST_WORDS // LEAST_PERIODS
# Words that are taken up at once.
BLOCK_WORDS = 200_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * _MIX
    return (values ^ (values >> _SHIFT)) * _MIX


def echo_stretches(ids: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Intervals (start, end) that hold every run; ``part`` numbers the text of each word, rising.

    A word outside all strings of ``_ECHO`` words that their text holds twice is in no run. What
    is left of a text is looked at again by itself, until no more words fall out. Strings are
    told apart by hashes; equal hashes of different strings only keep words in.
    """
    places = np.arange(len(ids), dtype=np.int64)
    while len(ids) >= LEAST_WORDS:
        keys, width = _mixed(ids.astype(np.uint64) + np.uint64(1)), 1
        while width < _ECHO:
            step = min(width, _ECHO - width)
            keys = _mixed(keys[:-step] + _mixed(keys[step:]))
            width += step
        whole = part[: len(keys)] == part[_ECHO - 1 :]
        keys = (keys + _mixed(part[: len(keys)].astype(np.uint64)))[whole]
        order = np.sort(keys)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(twice):
            return np.zeros((0, 2), np.int64)
        at = np.searchsorted(twice, keys)
        starts = np.flatnonzero(whole)[twice[np.minimum(at, len(twice) - 1)] == keys]
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + _ECHO, -1)
        inside = np.cumsum(edge[:-1]) > 0
        first = inside & np.r_[True, (~inside[:-1]) | (part[1:] != part[:-1])]
        label = np.cumsum(first)
        sizes = np.bincount(label[inside], minlength=label[-1] + 1)
        inside &= sizes[label] >= LEAST_WORDS
        if inside.all():
            ends = np.r_[np.flatnonzero(first)[1:], len(ids)]
            return np.stack([places[first], places[ends - 1] + 1], axis=1)
        ids, places, part = ids[inside], places[inside], label[inside]
    return np.zeros((0, 2), np.int64)


def re_pair(words: list[int]) -> tuple[list[int], list[tuple[int, int]], int]:
    """The grammar of a sequence: root symbols, rules, and the number of the first rule.

    The most frequent pair of neighbours is replaced by a new symbol, of equally frequent ones
    the pair met first, until no pair stands twice. Places of a pair are kept in a list and
    checked when they are used, counts in a heap whose outdated entries are put back.
    """
    n, base = len(words), max(words, default=-1) + 1
    symbols, following, before = list(words), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(n - 1):
        places[symbols[i], symbols[i + 1]].append(i)
    counts = {pair: len(at) for pair, at in places.items()}
    born = count()
    heap = [(-c, next(born), pair) for pair, c in counts.items() if c > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        minus, birth, pair = heapq.heappop(heap)
        now = counts.get(pair, 0)
        if now < 2:
            continue
        if now < -minus:
            heapq.heappush(heap, (-now, birth, pair))
            continue
        a, b = pair
        taken, end = [], -1
        for i in sorted(places.pop(pair)):
            j = following[i] if i > end and symbols[i] == a else n
            if j < n and symbols[j] == b:
                taken.append(i)
                end = j
        del counts[pair]
        if len(taken) < 2:
            continue
        new = base + len(rules)
        rules.append(pair)
        made = {}
        for i in taken:
            j = following[i]
            h, k = before[i], following[j]
            symbols[i], symbols[j], following[i] = new, -1, k
            if k < n:
                before[k] = i
                old = (b, symbols[k])
                if old in counts:
                    counts[old] -= 1
                made[new, symbols[k]] = None
                places[new, symbols[k]].append(i)
            if h >= 0:
                left = symbols[h]
                old = (left, a)
                if old in counts:
                    counts[old] -= 1
                if left == new:
                    # The pair noted at the place before has had its right half replaced now.
                    made[new, new] = None
                    places[new, new].append(h)
                else:
                    made[left, new] = None
                    places[left, new].append(h)
        for pair in made:
            counts[pair] = len(places[pair])
            if counts[pair] > 1:
                heapq.heappush(heap, (-counts[pair], next(born), pair))
    root, i = [], 0
    while i < n:
        root.append(symbols[i])
        i = following[i]
    return root, rules, base


def _matches(text: list[int]) -> list[int]:
    """For each place, how many words from there on equal the text's beginning."""
    n = len(text)
    found = [0] * n
    left = right = 0
    for i in range(1, n):
        size = min(right - i, found[i - left]) if i < right else 0
        while i + size < n and text[size] == text[i + size]:
            size += 1
        found[i] = size
        if i + size > right:
            left, right = i, i + size
    return found


def runs_across(words: list[int], border: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) inside ``words`` that hold words on both sides of ``border``.

    A run of three periods has one whole period on one side at least. With that side's words
    taken as the text, the words equal at a distance of q after the border, and before it, are
    read off two match tables.
    """
    left, right = words[:border], words[border:]
    found: dict[tuple[int, int], int] = {}
    # Matches of ``after`` with itself, and of the reversed ``ahead`` with what ends at each place.
    for ahead, after, mirrored in ((left, right, False), (right[::-1], left[::-1], True)):
        m, b = len(after), len(ahead)
        own = _matches(after)
        back = ahead[::-1]
        # Words equal backwards from the border and from q words behind it.
        crossed = _matches(back + [-1] + (ahead + after)[::-1])
        for q in range(1, min(m, len(words) // LEAST_PERIODS) + 1):
            forth = own[q] if q < m else 0
            size = crossed[b + 1 + m - q] if b else 0
            start, end = b - min(size, b), b + q + forth
            if start < b and end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
                if mirrored:
                    start, end = len(words) - end, len(words) - start
                if (start, end) not in found or found[start, end] > q:
                    found[start, end] = q
    return [(s, e, q) for (s, e), q in found.items()]


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """All maximal runs (start, end, period) of a sequence, by start and period."""
    root, rules, base = re_pair(words)
    known = {}
    level = []
    for symbol in root:
        level.append(symbol)
    # The root is halved into rules of its own, used once each.
    while len(level) > 1:
        above = []
        for i in range(0, len(level) - 1, 2):
            pair = level[i], level[i + 1]
            if pair not in known:
                known[pair] = base + len(rules)
                rules.append(pair)
            above.append(known[pair])
        level = above + level[len(level) // 2 * 2 :]
    if not rules:
        return []
    spelled: list[list[int]] = []
    sizes: list[int] = []
    for a, b in rules:
        x = spelled[a - base] if a >= base else [a]
        y = spelled[b - base] if b >= base else [b]
        spelled.append(x + y)
        sizes.append(len(x))
    across = [
        runs_across(text, border) if len(text) >= LEAST_WORDS else []
        for text, border in zip(spelled, sizes)
    ]
    # Rules are numbered after their parts, so all places of a rule are known before its turn.
    places: list[list[int]] = [[] for _ in rules]
    places[level[0] - base].append(0)
    by_period: dict[int, list[tuple[int, int]]] = defaultdict(list)
    needed = [len(text) >= LEAST_WORDS for text in spelled]
    for r in range(len(rules) - 1, -1, -1):
        at = places[r]
        if not at or not needed[r]:
            continue
        for start, end, q in across[r]:
            by_period[q] += [(p + start, p + end) for p in at]
        a, b = rules[r]
        if a >= base:
            places[a - base] += at
        if b >= base:
            places[b - base] += [p + sizes[r] for p in at]
        places[r] = []
    best: dict[tuple[int, int], int] = {}
    for q in sorted(by_period):
        merged: list[list[int]] = []
        for start, end in sorted(set(by_period[q])):
            if merged and start + q <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        for start, end in merged:
            # A stretch that has been found with a smaller period is that run.
            best.setdefault((start, end), q)
    return sorted(((s, e, q) for (s, e), q in best.items()), key=lambda x: (x[0], x[2]))


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row ``key``, ``n_words``, ``runs`` (start, length, period) and ``collapsed``.

    Words are what stands between ASCII white space, numbered from 0. A run is a longest stretch
    with a smallest period q in which words q apart are equal, of ``LEAST_WORDS`` words and
    ``LEAST_PERIODS`` periods at least; runs come by start, then period. ``collapsed`` is the text
    without the words that some run holds after its first period, joined by one space.

    A null or empty text has no words and no runs. Rows are handled each by itself, so repeated
    and null keys keep their rows; other columns are not read. Nothing is shuffled.
    """

    def build():
        def block(texts):
            numbers = defaultdict(count().__next__)
            found = []
            words = [t.split() for t in texts]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ids = np.array([numbers[w] for ws in words for w in ws], np.int64)
            part = np.repeat(np.arange(len(words)), sizes)
            starts = np.r_[0, np.cumsum(sizes)]
            runs: list[list] = [[] for _ in words]
            for start, end in echo_stretches(ids, part).tolist():
                doc = int(part[start])
                shift = start - int(starts[doc])
                runs[doc] += [(s + shift, e + shift, q) for s, e, q in runs_of(ids[start:end].tolist())]
            for doc, ws in enumerate(words):
                mine = sorted(runs[doc], key=lambda x: (x[0], x[2]))
                n = len(ws)
                if mine:
                    dropped = np.zeros(n + 1, np.int64)
                    for s, e, q in mine:
                        dropped[s + q] += 1
                        dropped[e] -= 1
                    kept = np.cumsum(dropped[:-1]) == 0
                    ws = [w for w, keep in zip(ws, kept.tolist()) if keep]
                found.append((n, [(s, e - s, q) for s, e, q in mine], b" ".join(ws).decode()))
            return found

        def work(keys, texts):
            found, held, size = [], [], 0
            for t in texts:
                held.append(t or b"")
                size += len(held[-1])
                if size >= BLOCK_WORDS * 6:
                    found += block(held)
                    held, size = [], 0
            found += block(held)
            return {
                key: keys,
                "n_words": [f[0] for f in found],
                "runs": [[{"start": s, "length": n, "period": q} for s, n, q in f[1]] for f in found],
                "collapsed": [f[2] for f in found],
            }

        return work

    rows = docs.select(F.col(key), F.col(text).cast("binary").alias(text))
    kind = rows.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, n_words bigint, "
        "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )
    return map_columns(rows, build, schema)


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where a tenth of the texts ends in a repeated stretch of its words.

    With h the crc32 of the id's decimal digits, texts with h % 10 = 0 have every word i from
    a = (h / 10) % n on replaced by word a + (i - a) % p, p = 1 + (n - a) / (3 + (h / 10) % 8),
    divisions rounded down. Such a text's words come joined by one space. A null id changes
    nothing.
    """

    def build():
        def work(ids, texts):
            out = []
            for i, text in zip(ids, texts):
                h = 1 if i is None else zlib.crc32(str(i).encode())
                words = text.split() if text and h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
                    text = b" ".join(words)
                out.append(text)
            return {"doc_id": ids, "text": [None if t is None else t.decode() for t in out]}

        return work

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    return map_columns(rows, build, "doc_id bigint, text string")


def strongest(runs: Column) -> Column:
    """The run of greatest length per period, of equal ones the first start, then period; or null."""

    def better(best: Column, run: Column) -> Column:
        ours, theirs = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (ours > theirs), run).otherwise(best)

    # Runs come by start and period, so the first of equal ones is met first.
    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs``: number of runs, the strongest one, and digests of runs and text."""
    best = strongest(F.col("runs"))
    listed = F.array_join(
        F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"
    )
    ended = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(ended, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

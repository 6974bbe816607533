"""Token counts of a byte-level BPE vocabulary, by merging with a heap over a linked list."""

from __future__ import annotations

import heapq
import json
import re

import regex
from pyspark.sql import DataFrame

from evalspark.llm.common import map_columns, texts_of, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
# Words whose counts a task remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges: initial symbols minus merges.

    The pair of lowest rank is merged first, the leftmost of equal ones. The symbols form a
    linked list; an entry of the heap whose symbols have changed since is skipped.
    """
    n = left = len(symbols)
    if n < 2:
        return n
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = following[i] if symbols[i] == a else n
        if j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, ""
        left -= 1
        k = following[j]
        following[i] = k
        if k < n:
            before[k] = i
            rank = ranks.get((symbols[i], symbols[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbols[h], symbols[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return left


# The vocabulary's own pattern always starts a word at a space before a non-space, so texts can
# be cut there first. Python's \s holds every white-space character of that pattern.
_CUT = re.compile(r" (?=\S)")


class ChunkCounts(dict):
    """Tokens of each space-led chunk of text met so far."""

    def __init__(self, ranks, words):
        super().__init__()
        self.ranks, self.words, self.characters = ranks, words, byte_characters()

    def __missing__(self, chunk: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = n = self.count(" " + chunk)
        return n

    def count(self, text: str) -> int:
        characters, ranks = self.characters, self.ranks
        return sum(
            merge_count([characters[b] for b in word.encode()], ranks)
            for word in self.words.findall(text)
        )


def load(vocabulary: str):
    """A function from text to its number of tokens."""
    from public_tokenizers import PATTERN

    with open(tokenizer_path(vocabulary), encoding="utf-8") as file:
        data = json.load(file)
    model = data["model"]
    if model["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data["normalizer"]:
        raise ValueError(f"{vocabulary} is no plain byte-level BPE")
    pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
    counts = ChunkCounts({pair: rank for rank, pair in enumerate(pairs)}, regex.compile(PATTERN))
    specials = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
    special = regex.compile("|".join(map(regex.escape, specials)))

    def count(text: str) -> int:
        parts = special.split(text) if specials else [text]
        total = len(parts) - 1
        for part in parts:
            first, *rest = _CUT.split(part)
            total += counts.count(first) + sum(map(counts.__getitem__, rest))
        return total

    return count


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` per input row, without a shuffle.

    A null text counts as empty: no bytes, no tokens. A special token's string inside a text
    is one token, as the vocabulary's library has it. Repeated rows give repeated results.
    """

    def build():
        count = load(vocabulary)

        def work(ids, texts):
            tokens = [count(t) for t in texts]
            return {
                "doc_id": ids,
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
            }

        return work

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_columns(texts_of(docs), build, schema)

"""SentencePiece encoding by Viterbi over a lattice of pieces, and decoding back to the text.

Each batch of documents is a small relational problem: the substrings of its new words, up to the
longest piece, are joined to the piece table by their hashes; the matches, grouped by word, are the
edges of its lattice; a fold over the positions keeps the best path to each. The fold runs over all
words of the batch at once. ``segment_words`` states the same with DataFrame operations only.

The paths are best by the sum of the model's scores, as for a unigram model. A model made for
merging has its own segmentation, which ``fold="merge"`` gives: the adjacent pair that makes the
best piece is joined until none does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import map_columns, texts_of, tokenizer_path
from evalspark.llm.tokens import merge_count

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# What a character without a piece costs beyond the worst piece, as the library has it.
UNKNOWN_COST = 10.0
# Words whose pieces a task remembers, and words that are worked on at once.
REMEMBERED = 1_000_000
CHUNK = 50_000
# Longer words take a plain loop over their positions.
LONG_WORD = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model."""

    texts: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]

    @classmethod
    def load(cls, model: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(model))
        n = m.get_piece_size()
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [
            not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)
        ]
        texts = [m.id_to_piece(i) for i in range(n)]
        if any(SPACE in t.lstrip(SPACE) for t, ok in zip(texts, normal) if ok):
            raise ValueError("pieces that go on beyond a space need whole texts as words")
        if any(not m.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no pieces for bytes")
        return cls(texts, [m.get_score(i) for i in range(n)], normal, byte_ids)

    def table(self) -> dict[str, tuple[int, float]]:
        return {t: (i, self.scores[i]) for i, t in enumerate(self.texts) if self.normal[i]}

    def unknown_score(self) -> float:
        return min(s for s, ok in zip(self.scores, self.normal) if ok) - UNKNOWN_COST


def _rolling(codes: np.ndarray, longest: int):
    """Hashes of the substrings of each length from each position on."""
    hashes = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for length in range(1, longest + 1):
            n = len(codes) - length + 1
            if n <= 0:
                return
            hashes = hashes[:n] * _FACTOR + codes[length - 1 :] + np.uint64(1)
            yield length, hashes


class _MergedPieces:
    """Ranks of pairs by the score of the piece that they make."""

    def __init__(self, table):
        self.table = table

    def get(self, pair: tuple[str, str]) -> float | None:
        found = self.table.get(pair[0] + pair[1])
        return None if found is None else -found[1]


class Encoder(dict):
    """Piece ids, as bytes of 32-bit numbers, of each word met so far."""

    def __init__(self, pieces: Pieces, fold: str = "viterbi"):
        super().__init__()
        if fold not in ("viterbi", "merge"):
            raise ValueError(f"unknown fold {fold}")
        self.fold = fold
        self.pieces, self.table, self.unknown = pieces, pieces.table(), pieces.unknown_score()
        self.longest = max(map(len, self.table))
        # No piece holds a line end, so words end there too.
        stop = "" if any("\n" in t for t in self.table) else "\n"
        self.words = re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+|\n" if stop else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.by_length = {}
        for length in range(1, self.longest + 1):
            some = [(t, i, s) for t, (i, s) in self.table.items() if len(t) == length]
            if some:
                codes = np.array([[ord(c) for c in t] for t, _, _ in some], np.uint64)
                keys = np.zeros(len(some), np.uint64)
                with np.errstate(over="ignore"):
                    for column in codes.T:
                        keys = keys * _FACTOR + column + np.uint64(1)
                order = np.argsort(keys)
                self.by_length[length] = (
                    keys[order],
                    np.array([i for _, i, _ in some], np.int32)[order],
                    np.array([s for _, _, s in some], float)[order],
                )

    def _edges(self, codes: np.ndarray, left: np.ndarray):
        """Per length the scores and ids of the piece that starts at each position."""
        for length, hashes in _rolling(codes, self.longest):
            score = np.full(len(codes), -np.inf)
            ids = np.full(len(codes), -1, np.int32)
            if length in self.by_length:
                keys, numbers, scores = self.by_length[length]
                at = np.flatnonzero(left[: len(hashes)] >= length)
                spot = np.searchsorted(keys, hashes[at])
                spot[spot == len(keys)] = 0
                same = keys[spot] == hashes[at]
                at, spot = at[same], spot[same]
                score[at], ids[at] = scores[spot], numbers[spot]
            if length == 1:
                score[ids < 0] = self.unknown
            yield length, score, ids

    def _segment(self, words: list[str]) -> None:
        """Remember the best paths of words that are not known yet."""
        words = sorted(words, key=len, reverse=True)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
        edges = {length: (score, ids) for length, score, ids in self._edges(codes, left)}
        width = int(lengths[0])
        best = np.full((len(words), width + 1), -np.inf)
        best[:, 0] = 0.0
        back = np.zeros((len(words), width + 1), np.int8)
        for end in range(1, width + 1):
            n = int(np.searchsorted(-lengths, -end, "right"))
            # The longest piece first: it wins among equal sums.
            for length in range(min(end, self.longest), 0, -1):
                if length not in edges:
                    continue
                sums = best[:n, end - length] + edges[length][0][starts[:n] + end - length]
                better = np.flatnonzero(sums > best[:n, end])
                best[better, end] = sums[better]
                back[better, end] = length
        paths: list[list[int]] = [[] for _ in words]
        place, active = lengths.copy(), np.arange(len(words))
        while len(active):
            length = back[active, place[active]].astype(np.int64)
            place[active] -= length
            spot = starts[active] + place[active]
            for kind in np.unique(length):
                of = length == kind
                for word, number in zip(active[of].tolist(), edges[int(kind)][1][spot[of]].tolist()):
                    paths[word].append(number)
            active = active[place[active] > 0]
        for word, path in zip(words, paths):
            self._remember(word, path[::-1])

    def _remember(self, word: str, path: list[int]) -> None:
        """Characters without a piece become the pieces of their bytes."""
        if -1 in path:
            ids, at = [], 0
            for number in path:
                if number >= 0:
                    ids.append(number)
                    at += len(self.pieces.texts[number])
                else:
                    ids += [self.pieces.byte_ids[b] for b in word[at].encode()]
                    at += 1
            path = ids
        self[word] = np.array(path, "<i4").tobytes()

    def _segment_long(self, word: str) -> None:
        best, back = [0.0], [(0, 0)]
        for end in range(1, len(word) + 1):
            found = (-np.inf, 0, 0)
            for length in range(min(end, self.longest), 0, -1):
                number, score = self.table.get(word[end - length : end], (-1, -np.inf))
                if number < 0 and length == 1:
                    score = self.unknown
                if best[end - length] + score > found[0]:
                    found = (best[end - length] + score, length, number)
            best.append(found[0])
            back.append(found[1:])
        path, at = [], len(word)
        while at:
            length, number = back[at]
            path.append(number)
            at -= length
        self._remember(word, path[::-1])

    def _merge(self, word: str) -> None:
        symbols = list(word)
        merge_count(symbols, _MergedPieces(self.table))
        self._remember(word, [self.table.get(s, (-1, 0.0))[0] for s in symbols if s])

    def _words_of(self, text: str) -> list[list[str]]:
        """Words of the parts between literal space marks, which are kept as bytes."""
        if not text:
            return []
        first, *rest = text.split(SPACE)
        parts = [SPACE + first.replace(" ", SPACE), *(p.replace(" ", SPACE) for p in rest)]
        return [self.words.findall(p) for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Piece ids of each text, as bytes of 32-bit numbers."""
        mark = np.array([self.pieces.byte_ids[b] for b in SPACE.encode()], "<i4").tobytes()
        out, start = [], 0
        while start < len(texts):
            if len(self) > REMEMBERED:
                self.clear()
            split, new, stop = [], set(), start
            while stop < len(texts) and len(new) < CHUNK:
                split.append(self._words_of(texts[stop]))
                for words in split[-1]:
                    new.update(w for w in words if w not in self)
                stop += 1
            if self.fold == "merge":
                for word in new:
                    self._merge(word)
                new = set()
            new_words = list(new)
            short = [w for w in new_words if len(w) <= LONG_WORD]
            for i in range(0, len(short), CHUNK):
                self._segment(short[i : i + CHUNK])
            for word in new_words:
                if len(word) > LONG_WORD:
                    self._segment_long(word)
            look = self.__getitem__
            out += [mark.join(b"".join(map(look, words)) for words in parts) for parts in split]
            start = stop
        return out


class Decoder:
    def __init__(self, pieces: Pieces):
        raw = {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}
        self.bytes = [
            raw[i] if i in raw else t.replace(SPACE, " ").encode() if ok else b""
            for i, (t, ok) in enumerate(zip(pieces.texts, pieces.normal))
        ]

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; the space that encoding puts in front is taken off."""
        whole = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


def encode(docs: DataFrame, model: str = MODEL, fold: str = "viterbi") -> DataFrame:
    """``doc_id`` and ``ids``, the piece ids of each text, in one narrow pass.

    A null or empty text has no pieces. Characters without a piece, and literal space marks, are
    kept as pieces of their bytes, so ``decode`` gives back every text exactly. Repeated rows
    give repeated results; a null ``doc_id`` is handed through.
    """

    def build():
        encoder = Encoder(Pieces.load(model), fold)

        def work(ids, texts):
            return {"doc_id": ids, "ids": [np.frombuffer(e, "<i4") for e in encoder.encode(texts)]}

        return work

    return map_columns(texts_of(docs), build, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``; null ids give an empty text."""

    def build():
        decoder = Decoder(Pieces.load(model))

        def work(keys, ids):
            return {"doc_id": keys, "text": [decoder.decode(i or []) for i in ids]}

        return work

    return map_columns(encoded.select("doc_id", "ids"), build, "doc_id bigint, text string")


def encode_and_check(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: ``n_pieces``, ``ids_sha256`` (of the ids as 32-bit numbers) and ``round_trip``."""

    def build():
        import hashlib

        pieces = Pieces.load(model)
        encoder, decoder = Encoder(pieces), Decoder(pieces)

        def work(keys, texts):
            coded = encoder.encode(texts)
            return {
                "doc_id": keys,
                "n_pieces": [len(c) // 4 for c in coded],
                "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded],
                "round_trip": [
                    decoder.decode(np.frombuffer(c, "<i4").tolist()) == t for c, t in zip(coded, texts)
                ],
            }

        return work

    schema = "doc_id bigint, n_pieces bigint, ids_sha256 string, round_trip boolean"
    return map_columns(texts_of(docs), build, schema)


def with_ids(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, lang, source, text`` and the ``ids`` of each row's text."""
    rows = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))

    def build():
        encoder = Encoder(Pieces.load(model))

        def work(keys, langs, sources, texts):
            ids = [np.frombuffer(e, "<i4") for e in encoder.encode(texts)]
            return {"doc_id": keys, "lang": langs, "source": sources, "text": texts, "ids": ids}

        return work

    return map_columns(rows, build, "doc_id bigint, lang string, source string, text string, ids array<int>")


def piece_table(spark: SparkSession, model: str = MODEL) -> DataFrame:
    """``piece, id, score`` of the pieces that words are made of."""
    rows = [(t, i, float(s)) for t, (i, s) in Pieces.load(model).table().items()]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def segment_words(words: DataFrame, pieces: DataFrame, longest: int, unknown: float) -> DataFrame:
    """``word`` and ``path`` (piece ids, -1 for a character without one), in DataFrame operations.

    ``words`` holds distinct ``word``s with spaces as marks. Their substrings are joined to the
    piece table, whose size a model fixes, the matches are grouped by word, and an aggregate over
    the positions folds them into the best path.
    """
    ends = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("stop"))
    spans = ends.select(
        "word", "stop", F.explode(F.sequence(F.lit(1), F.least(F.col("stop"), F.lit(longest)))).alias("size")
    )
    piece = F.col("word").substr(F.col("stop") - F.col("size") + 1, F.col("size"))
    edges = spans.withColumn("piece", piece).join(F.broadcast(pieces), "piece", "left")
    single = (F.col("size") == 1) & F.col("id").isNull()
    edges = edges.filter(F.col("id").isNotNull() | (F.col("size") == 1)).select(
        "word", "stop", "size",
        F.when(single, F.lit(unknown)).otherwise(F.col("score")).alias("score"),
        F.coalesce("id", F.lit(-1)).alias("id"),
    )
    lattices = edges.groupBy("word").agg(F.collect_list(F.struct("stop", "size", "score", "id")).alias("edges"))
    empty = F.expr("array(named_struct('sum', 0D, 'size', 0, 'path', cast(array() AS array<int>)))")

    def step(paths, stop):
        arriving = F.filter("edges", lambda e: e["stop"] == stop)

        def along(e):
            before = F.element_at(paths, stop - e["size"] + 1)
            return F.struct(
                (before["sum"] + e["score"]).alias("sum"),
                e["size"].alias("size"),
                F.concat(before["path"], F.array(e["id"])).alias("path"),
            )

        return F.concat(paths, F.array(F.array_max(F.transform(arriving, along))))

    folded = F.aggregate(F.sequence(F.lit(1), F.length("word")), empty, step, lambda p: F.element_at(p, -1)["path"])
    return lattices.select("word", folded.alias("path"))

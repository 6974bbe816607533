"""Toxic terms, misspelled ones included, scored by what stands around them.

The lexicon is learned from labelled documents. Its trie is intersected with Levenshtein automata:
a state is the set of trie nodes that the letters read so far can lead to, each with the edits
spent; made deterministic, the automaton reads each word once, whatever the number of terms.
Terms are words, found with one or two letters wrong, or stems, with which a word must begin.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import map_columns, texts_of
from evalspark.session import materialize

# The lexicon, the weights and the cut are fitted on at most this many labelled documents.
SAMPLE = 12_000
# Words from EDITED letters on are found with one edit, from LONG on with two.
EDITED, LONG = 4, 9
# Letters of a stem: shorter beginnings belong to too many words, longer words are terms themselves.
MIN_STEM, MAX_STEM = 4, 10
# States of an automaton that are kept from one block of text to the next.
STATES = 100_000
# Least toxic documents of a term, and least log odds with three standard errors to spare.
LEAST_COUNT, LEAST_ODDS = 8, 1.5
# Share of a stem's documents that hold it as a word, from which on it counts as that word.
WORD_SHARE = 0.8
THRESHOLD = 0.7
# Words on each side of a term that make its context.
WINDOW = 8
BLOCK = 2_000_000

# Fixed cues of the four languages: address of a person, and report of what others said.
PERSON = frozenset("you your youre yourself u du dich dein deine sie tu toi te vous votre eres usted tus".split())
REPORT = frozenset(
    "said says called calls quoted quote wrote writes term word sagte nannte wort zitat dit appelé mot "
    "citation dijo llamó palabra cita".split()
)
QUOTES = "\"'“”„‘’«»‹›`"
_OPENING, _CLOSING = "“„«‹", "”»›"
FEATURES = (
    "terms", "misspelled", "stems", "quoted", "addressed", "reported", "density", "stem_density", "kinds", "cluster"
)


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


class Automaton:
    """All terms within their edit distance: classes of code points, moves, and what is accepted.

    A term ending in ``*`` is a stem, whose words may go on; it and words of fewer than ``EDITED``
    letters are matched without edits. State 0 is dead and state 1 the start. Class 0 ends a word,
    class 1 is every letter or digit that occurs in no term. ``accept`` is -1, or four times the
    term's number plus the edits. States are made deterministic when a word first leads to them,
    so that the number of terms needs no limit.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.stem = [t.endswith("*") for t in terms]
        self.letters = ["", "", *sorted({c for t in terms for c in t.rstrip("*")})]
        self.limit = [0 if s or len(t) < EDITED else 1 if len(t) < LONG else 2 for t, s in zip(terms, self.stem)]
        self.classes = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000).astype(np.uint16)
        for i, c in enumerate(self.letters[2:]):
            self.classes[ord(c)] = i + 2
        self.children, self.ends, self.budget = [{}], [-1], [0]
        for number, term in enumerate(terms):
            node, allowed = 0, self.limit[number]
            self.budget[0] = max(self.budget[0], allowed)
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], allowed)
            self.ends[node] = number
        self._restart()

    def _restart(self):
        """Only the dead state and the start are known."""
        self.number, self.states = {}, []
        self.moves = np.full((64, len(self.letters)), -1, np.int32)
        self.accept = np.full(64, -1, np.int32)
        self._state(())
        self.moves[0] = 0
        self._state(self._closed({0: 0}))

    def _closed(self, states: dict[int, int]) -> tuple:
        """With the nodes that skipping letters of a term leads to."""
        todo = deque(states.items())
        while todo:
            node, edits = todo.popleft()
            if states[node] < edits:
                continue
            for child in self.children[node].values():
                if edits < self.budget[child] and edits + 1 < states.get(child, 9):
                    states[child] = edits + 1
                    todo.append((child, edits + 1))
        return tuple(sorted(states.items()))

    def _after(self, states: tuple, letter: str) -> tuple:
        got: dict[int, int] = {}
        for node, edits in states:
            open_end = self.ends[node] >= 0 and self.stem[self.ends[node]] and edits == 0
            options = [(node, 0 if open_end else edits + 1)]
            options += [(child, edits + (c != letter)) for c, child in self.children[node].items()]
            for target, spent in options:
                if spent <= self.budget[target] and spent < got.get(target, 9):
                    got[target] = spent
        return self._closed(got)

    def _state(self, states: tuple) -> int:
        if states in self.number:
            return self.number[states]
        i = self.number[states] = len(self.states)
        self.states.append(states)
        if i == len(self.accept):
            self.moves = np.concatenate([self.moves, np.full_like(self.moves, -1)])
            self.accept = np.concatenate([self.accept, np.full_like(self.accept, -1)])
        self.moves[i, 0] = 0
        whole = [(e, self.ends[n]) for n, e in states if self.ends[n] >= 0 and e <= self.limit[self.ends[n]]]
        if whole:
            edits, term = min(whole)
            self.accept[i] = 4 * term + edits
        return i

    def _moved(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The states that follow; moves not yet known are worked out."""
        following = self.moves[state, kind]
        new = following < 0
        if not new.any():
            return following
        for s, k in set(zip(state[new].tolist(), kind[new].tolist())):
            target = self._state(self._after(self.states[s], self.letters[k]))
            self.moves[s, k] = target
        return self.moves[state, kind]

    def read(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the words, numbers of the words that are accepted, and as what."""
        if len(self.states) > STATES:
            self._restart()
        kinds = np.append(self.classes[codes], np.uint16(0))
        word = kinds > 0
        starts = np.flatnonzero(word[:-1] & ~np.concatenate([[False], word[:-2]])) if len(codes) else np.empty(0, np.int64)
        at, which, state = starts, np.arange(len(starts)), np.ones(len(starts), np.int32)
        words, accepted = [which[:0]], [state[:0]]
        while len(at):
            kind = kinds[at]
            ended = kind == 0
            if ended.any():
                what = self.accept[state[ended]]
                words.append(which[ended][what >= 0])
                accepted.append(what[what >= 0])
            state = self._moved(state, kind)
            alive = state > 0
            at, which, state = at[alive] + 1, which[alive], state[alive]
        words, accepted = np.concatenate(words), np.concatenate(accepted)
        order = np.argsort(words)
        return starts, words[order], accepted[order]


def _word(text: str, start: int) -> str:
    end = start
    while end < len(text) and text[end].isalnum():
        end += 1
    return text[start:end]


class Quotations:
    """Where quotations are open, from one look at all marks of a block of text."""

    def __init__(self, text: str, codes: np.ndarray):
        self.text = text
        self.lines, self.plain, self.opened, self.closed = (
            np.flatnonzero(np.isin(codes, [ord(c) for c in marks])) for marks in ("\n", '"', _OPENING, _CLOSING)
        )

    def at(self, start: int, length: int) -> bool:
        """A quotation mark stands at the word, or one opened before it on the line is still open."""
        if start > 0 and self.text[start - 1] in QUOTES:
            return True
        if self.text[start + length : start + length + 1] in QUOTES and start + length < len(self.text):
            return True
        line = np.searchsorted(self.lines, start)
        begin = self.lines[line - 1] if line else 0
        plain, opened, closed = (
            int(np.diff(np.searchsorted(places, (begin, start)))[0]) for places in (self.plain, self.opened, self.closed)
        )
        return plain % 2 == 1 if plain else opened > closed


def context_scores(automaton: Automaton, weights: list[float], texts: list[str]) -> list[list[float]]:
    """The values of ``FEATURES`` for each text."""
    lowered = [t.lower() for t in texts]
    whole = "\n".join([*lowered, ""])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    starts, words, accepted = automaton.read(codes)
    quotations = Quotations(whole, codes)
    first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]])) if texts else []
    last = np.searchsorted(starts, ends) if texts else []
    scores = [[0.0] * len(FEATURES) for _ in texts]
    owner = np.searchsorted(ends, starts[words], "right") if len(words) else []
    by_text: dict[int, list[tuple[int, int]]] = {}
    for text, word, what in zip(owner, words.tolist(), accepted.tolist()):
        by_text.setdefault(int(text), []).append((word, what))
    for text, hits in by_text.items():
        low, high = int(first[text]), int(last[text])
        exact = misspelled = stems = quoted = addressed = reported = 0.0
        for word, what in hits:
            start = int(starts[word])
            near = {
                _word(whole, int(starts[i]))
                for i in range(max(low, word - WINDOW), min(high, word + WINDOW + 1))
                if i != word
            }
            weight = weights[what >> 2]
            if automaton.stem[what >> 2]:
                stems += weight
            elif quotations.at(start, len(_word(whole, start))):
                quoted += weight
            elif what & 3:
                misspelled += weight
            else:
                exact += weight
            addressed += weight * bool(near & PERSON)
            reported += weight * bool(near & REPORT)
        places = np.array([w for w, _ in hits])
        cluster = max(np.searchsorted(places, places + 4 * WINDOW) - np.arange(len(places)))
        stem_hits = sum(automaton.stem[w >> 2] for _, w in hits)
        share = 100.0 / max(1, high - low)
        kinds = len({w >> 2 for _, w in hits})
        sums = (exact, misspelled, stems, quoted, addressed, reported)
        rates = ((len(hits) - stem_hits) * share, stem_hits * share)
        scores[text] = [*map(np.log1p, (*sums, *rates)), kinds, np.log1p(cluster)]
    return scores


def _blocks(texts: list[str]):
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK or i + 1 == len(texts):
            yield texts[start : i + 1]
            start, size = i + 1, 0


def _scored(rows: DataFrame, terms: list[str], weights: list[float], coefficients=None) -> DataFrame:
    """``doc_id`` with the features, or with the score once there are coefficients."""

    def build():
        automaton = Automaton(terms)

        def work(ids, texts):
            values = [v for block in _blocks(texts) for v in context_scores(automaton, weights, block)]
            if coefficients is None:
                return {"doc_id": ids, "features": values}
            x = np.array(values, float).reshape(len(values), len(FEATURES))
            scores = 1 / (1 + np.exp(-(coefficients[0] + x @ coefficients[1:])))
            return {"doc_id": ids, "score": scores.tolist()}

        return work

    kind = "features array<double>" if coefficients is None else "score double"
    return map_columns(texts_of(rows), build, f"doc_id bigint, {kind}")


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Text and label of at most ``sample`` labelled documents that are not held out.

    They are those with the smallest hashes of their ids. The ids, whose number the sample bounds,
    are broadcast, so the documents are not shuffled.
    """
    learned = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    return texts_of(docs).join(F.broadcast(learned), "doc_id")


def learn_lexicon(training: DataFrame) -> list[tuple[str, float]]:
    """Terms and their weights: words, and stems marked by a final ``*``.

    Counts are of documents; a term's toxic count is at most the number of different words that
    it follows in toxic documents, so copies of one document do not make its words terms. Of
    terms of which one begins with the other, that with more sure odds times count stays. Words
    have any length, and all terms that pass count; each stands in ``LEAST_COUNT`` of the training
    documents, which ``sample`` bounds.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # Strings, which Spark makes distinct by hash; structs it compares with each other.
    pairs = F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda w, b: F.concat(w, F.lit(" "), b))
    lengths = F.filter(F.sequence(F.lit(MIN_STEM), F.lit(MAX_STEM)), lambda n: n <= F.length("w"))
    stems = F.transform(lengths, lambda n: F.concat(F.col("w").substr(F.lit(1), n), F.lit("*")))
    term = F.explode(F.concat(stems, F.array("w"))).alias("term")
    toxic = (
        training.filter("toxic = 1").select("doc_id", F.explode(F.array_distinct(pairs)).alias("p")).filter("p is not null")
        .select("doc_id", F.substring_index("p", " ", 1).alias("w"), F.substring_index("p", " ", -1).alias("b"))
        .select("doc_id", "b", term)
    )
    clean = training.filter("toxic = 0").select("doc_id", F.explode(F.array_distinct(words)).alias("w")).select("doc_id", term)
    after = toxic.select("term", "b").distinct().groupBy("term").agg(F.count("*").alias("a"))
    held = toxic.select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("t"))
    counts = after.join(held, "term").filter(F.least("t", "a") >= LEAST_COUNT)
    clean = (
        clean.join(counts.select("term"), "term", "left_semi")
        .select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("c"))
    )
    totals = training.agg(
        F.count_if(F.col("toxic") == 1).alias("T"), F.count_if(F.col("toxic") == 0).alias("C")
    ).head()
    t, c = F.least("t", "a") + 0.5, F.coalesce("c", F.lit(0)) + 0.5
    odds = F.log(t / (totals["T"] + 1 - t)) - F.log(c / (totals["C"] + 1 - c))
    spare = 3 * F.sqrt(1 / t + 1 / c)
    best = (
        counts.join(clean, "term", "left")
        .select("term", "t", F.round(odds, 6).alias("weight"), F.round(odds - spare, 6).alias("sure"))
        .filter(F.col("sure") > LEAST_ODDS)
        .orderBy(F.desc(F.col("sure") * F.col("t")), F.desc(F.length("term")), "term")
    )
    found = best.collect()
    as_word = {r["term"]: r["t"] for r in found if not r["term"].endswith("*")}
    chosen: dict[str, float] = {}
    texts, beginnings = set(), set()
    for row in found:
        text = row["term"].rstrip("*")
        # A word shorter than a stem covers nothing but itself.
        own = {text[:n] for n in range(MIN_STEM, len(text) + 1)} or {text}
        if text in beginnings or own & texts:
            continue
        texts.add(text)
        beginnings |= own
        word = as_word.get(text, 0) >= WORD_SHARE * row["t"]
        chosen[text if word else text + "*"] = row["weight"]
    return sorted(chosen.items())


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the constant comes first and is not shrunk."""
    x = np.hstack([np.ones((len(features), 1)), features])
    penalty = np.diag([1e-6] + [ridge] * features.shape[1])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (labels - p) - penalty @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` per row of ``docs``.

    Only text enters a score. A null text counts as empty and gets the score of a text without
    terms. Labels other than 0 and 1 are not learned from; of several labels of a document the
    larger holds. Without labels of both kinds, all scores are 0. A null ``doc_id`` is not held
    out. Repeated rows give repeated results. All documents are scored in one narrow pass. The
    training rows are written once to the shared folder.
    """
    training = materialize(training_rows(docs, labels, sample), "toxicity-training")
    lexicon = learn_lexicon(training)
    terms, weights = [t for t, _ in lexicon], [w for _, w in lexicon]
    known = _scored(training, terms, weights).join(
        F.broadcast(training.select("doc_id", "toxic").distinct()), "doc_id"
    )
    rows = known.select("features", "toxic").collect()
    y = np.array([r["toxic"] for r in rows], float)
    if 0 < y.sum() < len(y):
        coefficients = fit(np.array([r["features"] for r in rows], float), y)
    else:
        coefficients = np.array([-np.inf] + [0.0] * len(FEATURES))
    scored = _scored(docs, terms, weights, coefficients)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

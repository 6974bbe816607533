"""Operators on documents: odd inputs for all, and each against a plain computation."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import contamination, licenses, near, outliers, personal, pieces, repeats, tokens, toxicity
from evalspark.llm.common import WORD, table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket int, kind string, spans string"
LONG = "alpha beta gamma delta " * 30_000
COPY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ROWS = [
    (1, COPY, "en", "a", 1, 1, "k", "s"),
    (2, COPY, "en", None, None, None, None, None),
    (2, COPY, "en", None, None, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, 1, "k", "s"),
    (5, " \t\n ", "en", "a", 4, 1, "k", "s"),
    (6, "x" * 100_000, "en", "a", 4, 1, "k", "s"),
    (7, LONG, "en", "a", 4, 1, "k", "s"),
    (8, COPY + " end", None, "a", 4, 1, "k", "s"),
    (9, "mail jo@ex.org or +49 30 1234567, é中𝄞▁ \x00", "en", "a", 4, 1, "k", "s"),
    (None, COPY, "en", "a", 4, 1, "k", "s"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    return table(spark, FOLDER, "documents")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, COPY + " seventeen"), (2, None), (None, COPY), (3, "a")], "item_id bigint, text string")


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 0, 1), (2, None, None), (8, 1, 0)], "doc_id bigint, quality int, toxic int")


PER_ROW = {
    "quality": lambda d, i, m: outliers.quality(d),
    "contaminated": lambda d, i, m: contamination.contaminated(d, i),
    "personal": lambda d, i, m: personal.span_digests(personal.find_personal_data(d)),
    "licenses": lambda d, i, m: licenses.license_report(d),
    "tokens": lambda d, i, m: tokens.count_tokens(d),
    "pieces": lambda d, i, m: pieces.encode_and_check(d),
    "toxicity": lambda d, i, m: toxicity.toxicity(d, m),
    "repeats": lambda d, i, m: repeats.remove_repeats(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_per_row(odd, none, items, marks, name):
    rows = PER_ROW[name](odd, items, marks).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in ROWS)
    twice = [tuple(r) for r in rows if r.doc_id == 2]
    assert twice[0] == twice[1]
    assert PER_ROW[name](none, items, marks).count() == 0
    assert PER_ROW[name](odd, items.limit(0), marks.limit(0)).count() == len(ROWS)


def test_one_result_per_document(odd, none):
    rows = {r.doc_id: r for r in near.similar_groups(odd).collect()}
    assert sorted(map(str, rows)) == sorted({str(r[0]) for r in ROWS})
    assert rows[2].class_id == rows[8].class_id == 1 and rows[1].n_copies == 2 and rows[8].n_links == 1
    assert rows[3].class_id == 3 and rows[4].class_id == 4 and rows[5].class_id == 5
    assert rows[None].class_id is None
    assert near.similar_groups(none).count() == 0


def test_filters_keep_columns(odd, items):
    assert near.one_of_each(odd).columns == odd.columns
    clean = contamination.without_benchmark(odd, items)
    assert clean.columns == odd.columns and clean.filter("doc_id = 1").count() == 1
    hit = contamination.without_benchmark(odd, items.withColumn("text", F.lit(COPY)).filter("item_id = 1"))
    assert sorted(str(r.doc_id) for r in hit.collect()) == ["3", "4", "5", "6", "7", "9"]
    masked = personal.redact(odd)
    assert masked.columns == odd.columns
    row = masked.filter("doc_id = 9").head()
    assert "[email]" in row.text and "[phone]" in row.text and "jo@" not in row.text and row.n_chars == len(row.text)
    assert masked.filter("doc_id = 3").head().text is None


def test_base_statistics(given):
    got = {r.doc_id: r for r in outliers.quality(given).collect()}
    for row in given.collect():
        words = WORD.findall(row.text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = collections.Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in row.text.split("\n") if WORD.search(x)]
        r = got[row.doc_id]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in row.text)
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == len(covered)
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_outliers_of_one_group(spark):
    draw = random.Random(3)
    plain = [" ".join(f"{draw.choice('abcdefg')}{draw.randrange(9000)}" for _ in range(draw.randint(80, 300))) for _ in range(60)]
    junk = [" ".join(f"w{draw.randrange(900)}###$$$" for _ in range(100)) for _ in range(12)]
    rows = [(i, t, "en", "s") for i, t in enumerate(plain + junk)]
    got = outliers.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert {r.doc_id for r in got.filter("not kept").collect()} == set(range(60, 72))


def test_outliers_of_a_group_with_much_junk(spark):
    draw = random.Random(5)

    def text(mark):
        return " ".join(f"{draw.choice('abcdefg')}{draw.randrange(9000)}{next(mark)}" for _ in range(draw.randint(80, 300)))

    plain = [text(itertools.repeat("")) for _ in range(60)]
    junk = [text(itertools.repeat("#$%")) for _ in range(40)]
    mild = [text(itertools.cycle(["#", "", ""])) for _ in range(4)]
    lines = [plain[i].replace(" ", "\n") + "\nagain" * 15 for i in range(2)]
    for some in (junk, mild, lines):
        rows = [(i, t, "en", "s") for i, t in enumerate(plain + some)]
        got = outliers.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
        assert {r.doc_id for r in got.filter("not kept").collect()} == set(range(60, len(rows)))


def test_concentration_equals_plain_numpy(spark, given):
    """The distances are those of the same search with sorting instead of bins and salts."""
    got = {r.doc_id: r for r in outliers.quality(given).collect()}
    rows = collections.defaultdict(list)
    for row in given.collect():
        r = got[row.doc_id]
        n = max(1, r.n_words)
        rows[row.lang, row.source].append(
            (r.doc_id, [np.log1p(r.n_words), r.word_chars / n, r.n_symbols / n, np.sqrt(r.n_dup_lines / n), r.n_repeat_words / n])
        )
    for members in rows.values():
        x = np.array([v for _, v in members])
        low, mid, high = (np.sort(np.rint(x * 256), axis=0)[max(0, int(np.ceil(q * len(x))) - 1)] / 256 for q in (0.25, 0.5, 0.75))
        center, scatter = mid, np.diag(((high - low) / 1.349) ** 2) + outliers._floor()
        for _ in range(outliers.STEPS):
            d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(scatter), x - center)
            bins = np.floor(np.log2(np.maximum(d, 1e-6)) * outliers.BINS)
            cut = np.sort(bins)[int(np.ceil(outliers.SUPPORT * len(x))) - 1]
            some = x[bins <= cut]
            center = some.mean(axis=0)
            scale = outliers.SUPPORT / outliers._share_of_scatter(outliers.SUPPORT)
            scatter = np.cov(some.T, bias=True).reshape(5, 5) * scale + outliers._floor()
        d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(scatter), x - center)
        some = x[d <= outliers.chi_square_quantile(0.975, 5)]
        center, scatter = some.mean(axis=0), np.cov(some.T, bias=True).reshape(5, 5) + outliers._floor()
        d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(scatter), x - center)
        assert np.allclose(d, [got[i].distance for i, _ in members], rtol=1e-4, atol=1e-4)


def test_contamination_within_the_edit_budget(spark, given):
    items = table(spark, FOLDER, "benchmark").collect()
    passages = contamination.Passages([(r.item_id, r.text) for r in items])
    draw = random.Random(8)
    for _ in range(60):
        item = draw.choice(items)
        text = list(item.text.upper())
        for _ in range(int(0.05 * len(text))):
            at = draw.randrange(len(text))
            text[at : at + 1] = draw.choice((["Q"], [], [text[at], "q"]))
        found = contamination.found_items(passages, ["other words", "Before. " + "".join(text) + " After.", "and more"])
        assert item.item_id in found[1] and not found[0] and not found[2]
    got = {r.doc_id: set(r["items"]) for r in contamination.contaminated(given, table(spark, FOLDER, "benchmark")).collect()}
    for row in given.collect():
        assert {r.item_id for r in items if r.text in row.text} <= got[row.doc_id]


def test_stretches_of_long_items_wherever_they_start():
    draw = random.Random(9)
    item = " ".join("".join(draw.choices("abcdefghijkl", k=draw.randint(2, 9))) for _ in range(60))[:300].strip() + "z"
    passages = contamination.Passages([(7, item), (8, "some other words " * 3), (9, item[:100][::-1])])
    for size in (82, 120, 200):
        for start in range(0, len(item) - size, 7):
            text = list(item[start : start + size])
            for _ in range(draw.randrange(4)):
                text[draw.randrange(len(text))] = "q"
            found = contamination.found_items(passages, ["none", "xx " + "".join(text) + " yy", "", "none"])
            assert [sorted(f) for f in found] == [[], [7], [], []]
    assert not contamination.found_items(passages, [item[20:80], item[100:150] + " ... " + item[10:60]])[0]


def test_base_spans_equal_the_plain_patterns(given):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    address = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def plain(text):
        out = [("email", *m.span()) for m in email.finditer(text)]
        out += [("ip", *m.span()) for m in address.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or 0) < 256 for p in m.group().split("."))]
        for m in card.finditer(text):
            digits = re.sub(r"\D", "", m.group())
            if 16 <= len(digits) <= 19 and personal.luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in phone.finditer(text) if 8 <= len(re.sub(r"\D", "", m.group())) <= 15]
        return out

    draw = random.Random(4)
    texts = ["".join(draw.choice("a17.@_-+ %(") for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += [r.text for r in given.collect()] + ["card 4111 1111 1111 1111 ok", "x" * 1000 + "1" * 5000 + ".1" * 500]
    for text in texts:
        base = [s[:3] for s in personal.spans_of(text) if s[0] in personal.BASE_KINDS]
        assert base == plain(text), text


def test_digests_and_added_kinds(spark):
    text = "ip 10.0.0.1 iban DE89 3704 0044 0532 0130 00 of the bank, ssn 123-45-6789; 987-65-4321, 123-45-6780"
    frame = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    row, empty = sorted(personal.span_digests(personal.find_personal_data(frame)).collect())
    assert row.base_sha256 == hashlib.sha256(b"ip:3:11").hexdigest() and row.n_ip == 1
    assert [s.split(":")[0] for s in row.spans.split(",")] == ["ip", "iban", "ssn", "ssn"]
    assert empty.base_sha256 == hashlib.sha256(b"").hexdigest() and empty.spans == ""
    assert not personal.mod97("DE88370400440532013000")


def test_token_counts_equal_the_library(given):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.tokenizer_path(tokens.VOCABULARY))
    count = tokens.load(tokens.VOCABULARY)
    texts = [r.text for r in given.collect()] + [r[1] or "" for r in ROWS]
    texts += ["a<|endoftext|>b", "don't 'LL \n\n x  y \x1c z", "   ", "<|endoftext|>", "\r\n\t x"]
    assert [count(t) for t in texts] == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pieces_round_trip_and_library(spark, given, odd):
    checked = pieces.encode_and_check(given.select("doc_id", "text").union(odd.select("doc_id", "text")))
    assert checked.filter("not round_trip").count() == 0
    frame = given.limit(40).select("doc_id", "text")
    assert sorted(pieces.decode(pieces.encode(frame)).collect()) == sorted(frame.collect())
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.tokenizer_path(pieces.MODEL))
    merged = {r.doc_id: r["ids"] for r in pieces.encode(frame, fold="merge").collect()}
    assert all(merged[r.doc_id] == library.encode(r.text) for r in frame.collect())


def test_paths_are_best(spark):
    table_ = pieces.Pieces.load(pieces.MODEL)
    encoder, scores, unknown = pieces.Encoder(table_), table_.table(), table_.unknown_score()
    words = ["▁the", "▁hest", "ingest", "▁▁x", "ééa", "𝄞b"]

    def best(word):
        splits = itertools.product((0, 1), repeat=len(word) - 1)
        return max(
            sum(scores.get(p, (0, unknown if len(p) == 1 else -np.inf))[1] for p in parts)
            for parts in ("".join(c + "|" * s for c, s in zip(word, (*split, 0))).split("|") for split in splits)
        )

    native = pieces.segment_words(
        spark.createDataFrame([(w,) for w in words], "word string"), pieces.piece_table(spark), encoder.longest, unknown
    )
    for word, path in native.collect():
        assert sum(unknown if i < 0 else table_.scores[i] for i in path) == best(word)
        if -1 not in path:
            encoder._segment([word])
            assert encoder[word] == np.array(path, "<i4").tobytes()
            encoder._segment_long(word)
            assert encoder[word] == np.array(path, "<i4").tobytes()


def test_similar_groups_equal_all_pairs(spark, given):
    base = [r.text for r in given.collect() if len(r.text) > 300][:40]
    draw = random.Random(2)
    texts = list(base)
    for text in base[:12]:
        for _ in range(3):
            words = text.split(" ")
            words[draw.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    many = base[0].split(" ")
    for k in range(600):
        texts.append(" ".join([*many[: len(many) // 2], f"w{k}", *many[len(many) // 2 :]]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in near.similar_groups(frame).collect()}
    sets = [frozenset(near.shingles(t).tolist()) for t in texts]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    reps = sorted(first.values())
    links, parent = collections.Counter(), list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(reps, 2):
        common = len(sets[a] & sets[b])
        if common >= near.SIMILARITY * (len(sets[a]) + len(sets[b]) - common):
            links[a] += 1
            links[b] += 1
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    for i, t in enumerate(texts):
        assert (got[i].class_id, got[i].n_links) == (top(first[t]), links[first[t]])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r.id: r.component for r in near.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


def _removed(rows):
    first = {}
    for i, text in sorted(rows):
        for s in range(len(text) - 49):
            first.setdefault(text[s : s + 50], i)
    out = {}
    for i, text in rows:
        gone = bytearray(len(text))
        for s in range(len(text) - 49):
            if first[text[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(text, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_repeats_equal_all_windows(spark, given, hot):
    draw = random.Random(6)
    line = "This very line stands in all of the texts, with other words before and after it."
    texts = [r.text for r in given.collect()][:60]
    texts += [" ".join(draw.choice(("aa", "bb", "ab")) for _ in range(draw.randint(5, 200))) for _ in range(40)]
    texts += [f"{draw.random()} {line}{draw.random()} é" for _ in range(30)] + [texts[3][100:400], "ab" * 300, "ab" * 200, ""]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(frame, hot).collect()}
    assert got == _removed([(i, t.encode()) for i, t in rows])


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_repeats_of_rows_that_share_an_id(spark, hot):
    """Rows of one id with different texts lose what smaller ids hold, not each other's spans."""
    draw = random.Random(12)
    parts = ["".join(draw.choices("abcdefgh ", k=70)) for _ in range(12)]
    rows = [(i, "".join(draw.sample(parts, 4)) + f" {draw.random()}") for i in (1, 2, 2, 2, 3, 4, 4, 5, 6) for _ in range(2)]
    rows += rows[4:7] + [(2, None), (4, "")]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), hot)
    expected = []
    for i, text in rows:
        smaller = [r for r in rows if r[0] < i and r[1]] + [(i, text or "")]
        expected.append((i, *_removed([(j, t.encode()) for j, t in smaller])[i]))
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_suffix_ranks_sort(spark):
    draw = random.Random(1)
    data = np.array([draw.randrange(97, 100) for _ in range(3000)] * 2, np.uint8)
    rank, text = repeats.suffix_ranks(data), data.tobytes()
    keys = [text[i : i + repeats.LENGTH] for i in range(len(text) - repeats.LENGTH)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    for a, b in zip(order, order[1:]):
        assert (rank[a] == rank[b]) if keys[a] == keys[b] else (rank[a] < rank[b])


def test_anchors_of_a_very_long_text_behind_an_empty_one():
    """The long text goes alone, in pieces; places beyond the bits of a block would wrap."""
    draw = np.random.default_rng(3)
    part = draw.integers(97, 123, 400_000, np.uint8).tobytes()
    text = part + draw.integers(97, 123, 17_000_000, np.uint8).tobytes() + part
    alone, behind = repeats.anchors([text]), repeats.anchors([b"", text])
    assert (behind[0] == 1).all()
    assert all((a == b).all() for a, b in zip(alone[1:], behind[1:]))
    # Of windows that both ends have, the anchors are equal, but where pieces of the text meet.
    hashes = alone[3]
    head, tail = hashes[alone[2] < len(part) - 50], hashes[alone[1] > len(text) - len(part) + 50]
    assert len(np.setdiff1d(tail, head)) <= 2


def test_notices(spark):
    texts = [
        "Words.\nReleased under the MIT License.\nMore words.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 1.",
        "Licensed under CC BY-NC-SA 4.0.",
        "The license of the driver was taken.",
        licenses.TEMPLATES[2][1].replace("free of charge", "without a fee"),
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r.licenses for r in licenses.license_report(frame).orderBy("doc_id").collect()]
    assert got == [["MIT"], ["GPL-3.0"], [], [], [], ["MIT"]]
    found = licenses.find_licenses(frame).filter("doc_id = 5").head().found[0]
    assert "-free" in found.differences and "+fee" in found.differences


def test_notices_in_longer_blocks():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    draw = random.Random(4)
    for size in (8, 40, 200, 4000):
        prose = " ".join("".join(draw.choices("abdefgiklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(size))
        for name, template in licenses.TEMPLATES:
            for block in (f"{prose} {template} {prose[:50]}", f"Copyright (c) 2019-2021 The Example Authors. All rights reserved.\n{template}"):
                assert name in [f["license"] for f in scanner.scan(block)]


def test_every_notice_of_a_block():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    dual = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    got = [(f["license"], dual[f["start"] : f["end"]]) for f in scanner.scan(dual)]
    assert got == [("MIT", dual[:31]), ("Apache-2.0", dual[32:])]
    for joint in ("\n", " ", "\nPart of the bundle:\n"):
        found = scanner.scan(joint.join(t for _, t in licenses.TEMPLATES))
        assert [f["license"] for f in found] == [n for n, _ in licenses.TEMPLATES]
    twice = "Licensed under CC BY 4.0.\nLicensed under the CC BY 4.0.\nLicensed under CC BY-NC-SA 4.0."
    assert [f["differences"] for f in scanner.scan(twice)] == [[], ["+the"]]


def test_wrapped_notices():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for width in (40, 50, 60, 72, 80):
        for sign in ("# ", " * ", "// ", ""):
            for name, template in licenses.TEMPLATES:
                lines = "\n".join(sign + line for line in textwrap.wrap(template, width))
                text = f"int main() {{}}\n{lines}\n\nThe river was wide and slow.\n"
                assert [f["license"] for f in scanner.scan(text)] == [name], (width, sign, template)


def test_compression_chooses_the_template(monkeypatch):
    """Of two confirmed templates the one that saves more bytes wins; with savings the other way round the other."""
    templates = [("short", "Released under the MIT License."), ("long", "Released under the MIT License, see the file COPYING beside it.")]
    scanner = licenses.Scanner(templates)
    assert [f["license"] for f in scanner.scan(templates[1][1])] == ["long"]
    plain = scanner.saved
    monkeypatch.setattr(scanner, "saved", lambda text, some: [-gain for gain in plain(text, some)])
    assert [f["license"] for f in scanner.scan(templates[1][1])] == ["short"]


def test_notices_against_brute_force():
    """Verbatim notices among prose with cues everywhere, found by comparing all places of all templates."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    draw = random.Random(9)
    for size in (5, 60, 900):
        parts = []
        for _ in range(12):
            parts += draw.choices(["copyright", "river", "wide", "permission", "slow", "boat", "water"], k=draw.randint(0, size))
            parts.append(draw.choice(licenses.TEMPLATES)[1] + "\n")
        text = " ".join(parts)
        words = licenses._words(text)
        at = {}
        for (name, _), wanted in zip(licenses.TEMPLATES, scanner.words):
            for i in range(len(words) - len(wanted) + 1):
                if words[i : i + len(wanted)] == wanted and len(wanted) > at.get(i, ("", 0))[1]:
                    at[i] = (name, len(wanted))
        expected, behind = [], 0
        for i in sorted(at):
            if i >= behind:
                expected.append(at[i][0])
                behind = i + at[i][1]
        assert [f["license"] for f in scanner.scan(text)] == expected


def test_toxicity_holds_out(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in rows)
    hits = [r for r in held if r.predicted]
    assert sum(r.toxic for r in hits) >= 0.95 * len(hits)
    assert sum(r.toxic for r in hits) >= 0.75 * sum(r.toxic for r in held)
    # Labels that are held out change nothing.
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    some = docs.filter("doc_id < 300")
    assert sorted(toxicity.toxicity(docs, other).join(some, "doc_id", "left_semi").collect()) == sorted(
        toxicity.toxicity(docs, labels).join(some, "doc_id", "left_semi").collect()
    )


def test_automaton_equals_edit_distance():
    terms = ["idiot", "scum", "worthless", "abcde", "ox", "bomente*"]
    automaton = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    draw = random.Random(5)
    for _ in range(3000):
        word = list(draw.choice(terms).rstrip("*"))
        for _ in range(draw.randint(0, 3)):
            at = draw.randrange(len(word) + 1)
            word[at : at + draw.randint(0, 1)] = draw.choice(([], ["x"], ["o"]))
        word = "".join(word)
        wanted = [distance(word, t) for t in terms[:-1]]
        allowed = [0 if len(t) < toxicity.EDITED else 1 if len(t) < toxicity.LONG else 2 for t in terms]
        wanted = [d for d, most in zip(wanted, allowed) if d <= most]
        wanted += [0] * word.startswith("bomente")
        _, _, what = automaton.read(np.array([ord(c) for c in word], np.uint32))
        assert (int(what[0]) & 3 if len(what) else None) == min(wanted, default=None), word


def test_quotation_is_told_from_abuse():
    automaton = toxicity.Automaton(["idiot"])
    names = toxicity.FEATURES
    abuse, quote = toxicity.context_scores(automaton, [5.0], ["you idiot, go", 'they said the word "idiot" there'])
    assert abuse[names.index("terms")] > 0 and abuse[names.index("addressed")] > 0 and not abuse[names.index("quoted")]
    assert quote[names.index("quoted")] > 0 and quote[names.index("reported")] > 0 and not quote[names.index("terms")]
    # However long before a quotation was opened, but on the same line.
    far = "so it goes on " * 200
    texts = [f'He: "{far}idiot, go', f'He: "{far}" idiot, go', f'He: “{far}idiot, go', f'He: "{far}\nidiot, go', f"{far}idiot go"]
    got = [s[names.index("quoted")] > 0 for s in toxicity.context_scores(automaton, [5.0], texts)]
    assert got == [True, False, True, False, False]


def test_states_of_many_terms_are_made_when_needed(monkeypatch):
    draw = random.Random(4)
    terms = sorted({"".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 14))) for _ in range(2000)})
    automaton = toxicity.Automaton(terms)
    texts = [" ".join(draw.choices(terms, k=50)) for _ in range(20)]
    weights = [1.0] * len(terms)
    before = toxicity.context_scores(automaton, weights, texts)
    assert len(automaton.states) < 100_000 and all(s[toxicity.FEATURES.index("density")] > 4.6 for s in before)
    # Forgetting the states changes nothing.
    monkeypatch.setattr(toxicity, "STATES", 1)
    assert toxicity.context_scores(automaton, weights, texts) == before


def test_lexicon_has_short_words_and_no_limit(spark):
    draw = random.Random(14)
    bad = ["".join(draw.choices("qxzvw", k=draw.randint(2, 3))) + str(i) for i in range(100)] + ["zx"]
    plain = [w + "ly" for w in ("slow", "quick", "nice", "bare", "real", "calm", "late", "near", "dear", "fair")]
    rows = []
    for i in range(10_000):
        words = [draw.choice(plain) + str(draw.randrange(300)) for _ in range(12)]
        if i % 8 == 1:
            words[1::2] = draw.sample(bad[:-1], 6)
            words[0] = bad[-1] if i % 16 == 1 else words[0]
        rows.append((i, int(i % 8 == 1), " ".join([f"start{i}", *words])))
    lexicon = dict(toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id bigint, toxic int, text string")))
    automaton = toxicity.Automaton(sorted(lexicon))
    _, found, _ = automaton.read(np.array([ord(c) for c in " ".join([*bad, *plain])], np.uint32))
    assert found.tolist() == list(range(len(bad))) and len(lexicon) > 64 and "zx" in lexicon


def test_order_is_stable_at_any_width():
    draw = np.random.default_rng(5)
    keys = draw.integers(0, 9, 5000).astype(np.uint64)
    for some, bits in ((keys, 4), (keys << np.uint64(58), 62), (keys[:0], 4), (keys[:1], 64)):
        assert (repeats._order(some, bits) == np.argsort(some, kind="stable")).all()


def test_only_what_windows_look_at_is_sorted(monkeypatch):
    """Ranks of the wanted positions sort their windows; each round sorts no more than it needs."""
    draw = random.Random(8)
    cut = bytes(draw.randrange(97, 99) for _ in range(67))
    data = np.frombuffer((cut + bytes(draw.randrange(97, 99) for _ in range(67))) * 40 + cut[:60], np.uint8)
    wanted = np.zeros(len(data), bool)
    for start in range(0, len(data) - 67, 67):
        wanted[start : start + 18] = True
    sizes, plain = [], repeats._order
    monkeypatch.setattr(repeats, "_order", lambda keys, bits: sizes.append(len(keys)) or plain(keys, bits))
    rank, text = repeats.suffix_ranks(data, wanted), data.tobytes()
    assert len(sizes) == 3 and sizes[2] <= wanted.sum() < sizes[1] < sizes[0] < len(data)
    at = sorted(np.flatnonzero(wanted).tolist(), key=lambda i: text[i : i + repeats.LENGTH])
    for a, b in zip(at, at[1:]):
        same = text[a : a + repeats.LENGTH] == text[b : b + repeats.LENGTH]
        assert (rank[a] == rank[b]) if same else (rank[a] < rank[b])


def test_rows_of_no_cuts_and_of_many():
    assert repeats._cut_rows({}, [], 7) == [[], [], []]
    cuts = {bytes([65 + i]) * 50: (10 - i, i % 3, 100 + i, [i, i + 200]) for i in range(7)}
    buckets, kinds, blobs = repeats._cut_rows(cuts, [(4, 128)], 7)
    assert buckets == [0, 1, 2, 4] and kinds == [0, 0, 0, 1]
    got = []
    for blob in blobs[:3]:
        docs, starts, keys, sizes, data = repeats._unpack(blob)
        assert (sizes == 50).all()
        got += zip(np.cumsum(docs).tolist(), starts.tolist(), keys.tolist(), (data.tobytes()[i : i + 50] for i in range(0, len(data), 50)))
    assert sorted(got) == sorted((doc, s, key, cut) for cut, (doc, _, key, starts) in cuts.items() for s in starts)


def test_spans_do_not_depend_on_the_order_of_documents():
    draw = random.Random(2)
    shared = ["".join(draw.choices("abc ", k=90)) for _ in range(5)]
    texts = ["".join(draw.choices(shared, k=3)) + "".join(draw.choices("xyz", k=20)) for _ in range(30)]
    ids = list(range(30))
    sent = [sorted(x for out in repeats._send_anchors(5)(i, t) for x in zip(*out)) for i, t in ((ids, texts), (ids[::-1], texts[::-1]))]
    assert sent[0] == sent[1]


def test_anchors_do_not_depend_on_what_is_sought_together(monkeypatch):
    draw = random.Random(6)
    texts = ["".join(draw.choices("abcdé ", k=draw.choice([0, 10, 60, 700]))).encode() for _ in range(60)]
    expected = repeats.anchors(texts)
    assert len(expected[0]) > 200
    for size in (1, 300, 5000):
        monkeypatch.setattr(repeats, "TOGETHER", size)
        assert all((a == b).all() for a, b in zip(repeats.anchors(texts), expected))

"""Main text of web pages by wrappers inferred per host.

Every page is a nested stream of tags and text slots. Streams of one host are aligned level by
level: what both have is kept, what one lacks becomes optional, runs of equal siblings or sibling
groups become repeated, and every text becomes a slot. The result is a regular expression
without unions that all pages of the host match. Its slots inside the article, or outside all
page furniture where a host has no article, make the main text.

The lines of text of a host's pages are compared as well, as digests counted by place: a line that
is the same on every page that has its place is template and is dropped. Inside an article that
holds for lines of links alone; its headings and its own text stay, on however many pages they are.

Alignment is associative enough to be done in parts: equal page expressions are counted first,
then folded per host and salt, then per host, so no task sees more than a share of a host.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import map_columns
from evalspark.session import materialize

SALTS = 64
# Of deeper elements only furniture and articles are told apart, as many as MAX_DEEPER within each
# other; the others still break lines.
MAX_DEPTH = 120
MAX_DEEPER = 8
# Siblings in the longest group whose repetition is recognized.
MAX_GROUP = 3
# Different pages that a line must be on to be template: an article's two versions prove nothing.
LEAST_PAGES = 3
# Numbers in a table of the alignment of two sequences of siblings.
CELLS = 1 << 22

# Fixed sets of HTML: elements without content, with raw text, that break a line, page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(
    "script style textarea title iframe noscript template svg select annotation annotation-xml".split()
)
MATH = frozenset(
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace "
    "mstyle mpadded mphantom merror menclose mmultiscripts mprescripts semantics".split()
)
INLINE = MATH | frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
FURNITURE = frozenset("nav footer aside form button dialog menu head".split())
# Words of a class, id or role that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal newsletter subscribe subscription nav navbar navigation menu "
    "menus breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus replies reply discussion "
    "related share sharing social login signup search searchbox pagination pager skip toolbar widget".split()
)
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Whole names that outvote marks in the other names of an element.
BODIES = frozenset("article body content entry main post story text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")


def _label(name: str, attributes: str) -> str:
    """The tag with a ``!`` if its attributes mark it as furniture; articles are never marked."""
    if "=" in attributes and name not in CONTENT:
        values = [value.strip("\"'") for _, value in _ATTRIBUTE.findall(attributes)]
        if BODIES.isdisjoint(" ".join(values).lower().split()):
            for value in values:
                if not MARKS.isdisjoint(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())):
                    return name + "!"
    return name


def _closed_by(name: str) -> tuple[str, ...]:
    """Open elements that a start tag ends."""
    if name in ("li", "option", "tr"):
        return (name,)
    if name in ("td", "th"):
        return ("td", "th")
    if name in ("dt", "dd"):
        return ("dt", "dd")
    return () if name in INLINE else ("p",)


_SCOPE = frozenset(("table", "ul", "ol", "dl", "td", "th", "div", "section", "article", "main", "body", "blockquote"))


def parse(page: str):
    """Events of a page: ``("open", label)``, ``("close", "")``, ``("text", raw)``, ``("break", "")``.

    Opens and closes are balanced whatever the page leaves out. Line breaks and other void
    elements are a space; comments and the content of raw elements are dropped.
    """
    stack: list[tuple[str, bool]] = []  # name, and whether its tags are events
    opened: Counter[str] = Counter()
    shown = 0

    def leave(size: int) -> list[tuple[str, str]]:
        """Close elements until so many are open."""
        nonlocal shown
        events = []
        while len(stack) > size:
            name, counts = stack.pop()
            opened[name] -= 1
            shown -= counts
            if counts:
                events.append(("close", ""))
            elif name not in INLINE:
                events.append(("break", ""))
        return events

    at = 0
    for_end = len(page)
    while at < for_end:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:]
            break
        if start > at:
            yield "text", page[at:start]
        m = _TOKEN.match(page, start)
        if not m:
            yield "text", "&lt;"
            at = start + 1
            continue
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        empty = m.group(3).rstrip().endswith("/")
        if m.group(1):
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                yield from leave(depth)
        elif name in RAW:
            if not empty:
                end = re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else for_end
        elif name in VOID or (name in MATH and empty):
            yield "text", " "
            if name == "hr":
                yield "break", ""
        else:
            ends = _closed_by(name)
            if any(opened[e] for e in ends):
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in ends:
                        yield from leave(depth)
                        break
                    if stack[depth][0] in _SCOPE:
                        break
            label = _label(name, m.group(3))
            counts = shown < MAX_DEPTH or (
                shown < MAX_DEPTH + MAX_DEEPER and (name in CONTENT or is_furniture(label, True))
            )
            stack.append((name, counts))
            opened[name] += 1
            shown += counts
            if counts:
                yield "open", label
            elif name not in INLINE:
                yield "break", ""
    yield from leave(0)


# An expression is a list of items [label, quantity, children]; the label of a text slot is "#"
# and that of a group of siblings is "()". Quantities are "1", "?", "+" and "*".


def _more(quantity: str, optional: bool, repeated: bool) -> str:
    optional = optional or quantity in "?*"
    repeated = repeated or quantity in "+*"
    return {(False, False): "1", (True, False): "?", (False, True): "+", (True, True): "*"}[optional, repeated]


def _key(item) -> str:
    return item[0] if item[0] != "()" else "(" + ",".join(_key(c) for c in item[2]) + ")"


def _tail_lengths(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """For every tail of ``a``, shortest first, its longest common subsequence with all tails of ``b``."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for value in a[::-1]:
        step = np.where(b == value, row[1:] + 1, row[:-1])
        row = np.append(np.maximum.accumulate(step[::-1])[::-1], np.int32(0))
        yield row


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence.

    What both begin and end with is set aside. A table of lengths gives the rest; where it would
    be larger than ``CELLS`` numbers, ``a`` is halved at the best place of ``b`` until it fits.
    """
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(k, len(numbers)) for k in keys], dtype=np.int64) for keys in (a, b))
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and x[n - 1] == y[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) > CELLS and n - i > 1:
            middle = (i + n) // 2
            before = after = np.zeros(m - j + 1, dtype=np.int32)
            for after in _tail_lengths(x[middle:n], y[j:m]):
                pass
            for before in _tail_lengths(x[i:middle][::-1], y[j:m][::-1]):
                pass
            cut = j + int(np.argmax(before[::-1] + after))
            todo += [(i, middle, j, cut), (middle, n, cut, m)]
            continue
        best = [np.zeros(m - j + 1, dtype=np.int32), *_tail_lengths(x[i:n], y[j:m])][::-1]
        p, q = i, j
        while p < n and q < m:
            if x[p] == y[q]:
                out.append((p, q))
                p, q = p + 1, q + 1
            elif best[p - i + 1][q - j] >= best[p - i][q - j + 1]:
                p += 1
            else:
                q += 1
    return sorted(out)


def _merged(a, b):
    """One item for two with the same key."""
    optional = a[1] in "?*" or b[1] in "?*"
    return [a[0], _more("1", optional, a[1] in "+*" or b[1] in "+*"), align(a[2], b[2])]


def align(a: list, b: list) -> list:
    """The expression of both sequences: common items in order, the others optional."""
    ka, kb = [_key(i) for i in a], [_key(i) for i in b]
    if ka == kb:
        return [_merged(x, y) for x, y in zip(a, b)]
    out: list = []
    i = j = 0
    for x, y in [*_common(ka, kb), (len(a), len(b))]:
        out += [[k[0], _more(k[1], True, False), k[2]] for k in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(_merged(a[x], b[y]))
        i, j = x + 1, y + 1
    return folded(out)


def folded(items: list) -> list:
    """Runs of equal siblings, and of equal groups of siblings, as one repeated item."""
    for size in range(1, MAX_GROUP + 1):
        out: list = []
        at = 0
        while at < len(items):
            keys = [_key(i) for i in items[at : at + size]]
            stop = at + size
            group = items[at:stop]
            while len(group) == size and [_key(i) for i in items[stop : stop + size]] == keys:
                group = [_merged(x, y) for x, y in zip(group, items[stop : stop + size])]
                stop += size
            if len(group) == size and stop > at + size:
                if size == 1:
                    out.append([group[0][0], _more(group[0][1], False, True), group[0][2]])
                else:
                    out.append(["()", "+", group])
                at = stop
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def page_expression(page: str) -> list:
    """The expression of one page."""
    levels: list[list] = [[]]
    for kind, value in parse(page):
        if kind == "open":
            item = [value, "1", []]
            levels[-1].append(item)
            levels.append(item[2])
        elif kind == "close":
            levels.pop()
            parent = levels[-1]
            parent[-1][2] = folded(parent[-1][2])
        elif kind == "text" and value.strip() and not (levels[-1] and levels[-1][-1][0] == "#"):
            levels[-1].append(["#", "1", []])
    return folded(levels[0])


def expression(items: list) -> str:
    """The wrapper as text, for reading."""
    parts = []
    for label, quantity, children in items:
        inner = expression(children)
        body = f"({inner})" if label == "()" else label + (f"<{inner}>" if inner else "")
        parts.append(body + ("" if quantity == "1" else quantity))
    return " ".join(parts)


def is_furniture(label: str, inside_content: bool) -> bool:
    """A header inside an article holds its title, all others are the page's."""
    name = label.rstrip("!")
    if name == "header":
        return not inside_content or label.endswith("!")
    return name in FURNITURE or (label.endswith("!") and name not in ("html", "body"))


def _holds_content(items: list) -> bool:
    return any(label in CONTENT or (label != "#" and _holds_content(children)) for label, _, children in items)


def content_slots(items: list) -> tuple[set[str], set[str], set[str]]:
    """Paths of the text slots inside articles, of all slots outside furniture, and of those with marked ones.

    An element that holds an article is no furniture for its marks, nor a form that holds one.
    """
    inside, outside, marked = set(), set(), set()
    todo = [(items, "", False, False)]
    while todo:
        level, path, content, mark = todo.pop()
        for label, _, children in level:
            if label == "#":
                marked.add(path)
                if not mark:
                    outside.add(path)
                if content and not mark:
                    inside.add(path)
            elif label == "()":
                todo.append((children, path, content, mark))
            else:
                name = label.rstrip("!")
                furniture = is_furniture(label, content)
                if furniture and (label.endswith("!") or name == "form") and _holds_content(children):
                    furniture = name != "form" and is_furniture(name, content)
                if not furniture or (label.endswith("!") and not is_furniture(name, content)):
                    todo.append((children, f"{path}/{label}", content or name in CONTENT, mark or furniture))
    return inside, outside, marked


def _lines(page: str):
    """Lines of the page: the place (path of the element that makes the line) and ``(path, raw)`` pieces."""
    paths, places = [""], [""]
    pieces: list[tuple[str, str]] = []
    for kind, value in parse(page):
        if kind == "text":
            pieces.append((paths[-1], value))
            continue
        label = value if kind == "open" else paths[-1].rsplit("/", 1)[-1]
        block = kind == "break" or label.rstrip("!") not in INLINE
        if block and pieces:
            yield places[-1], pieces
            pieces = []
        if kind == "open":
            paths.append(f"{paths[-1]}/{label}")
            places.append(paths[-1] if block else places[-1])
        elif kind == "close":
            paths.pop()
            places.pop()
    if pieces:
        yield places[-1], pieces


def _plain(pieces: list[tuple[str, str]]) -> str:
    return " ".join("".join(html.unescape(raw) for _, raw in pieces).split())


def _digest(*parts: str) -> int:
    whole = "\0".join(parts).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "big", signed=True)


def _may_be_template(place: str, pieces: list[tuple[str, str]]) -> bool:
    """Any line outside articles; inside them a line of links alone that is no heading."""
    elements = place.split("/")
    if CONTENT.isdisjoint(elements):
        return True
    return HEADINGS.isdisjoint(elements) and all("a" in path.split("/") for path, raw in pieces if raw.strip())


def _text(page: str, slots: set[str], template: frozenset[int] = frozenset()) -> str:
    out = []
    for place, pieces in _lines(page):
        if template and _may_be_template(place, pieces) and _digest(place, _plain(pieces)) in template:
            continue
        line = _plain([p for p in pieces if p[0] in slots or not p[1].strip()])
        if line:
            out.append(line)
    return "\n".join(out)


def line_digests(page: str) -> tuple[int, set[int], set[tuple[int, int]]]:
    """Digests of all lines together, of the places that have a line, and of place and line where that may be template."""
    every, places, lines = [], set(), set()
    for place, pieces in _lines(page):
        if not (line := _plain(pieces)):
            continue
        at, whole = _digest(place), _digest(place, line)
        every.append(whole)
        places.add(at)
        if _may_be_template(place, pieces):
            lines.add((at, whole))
    return _digest(*map(str, every)), places, lines


def _first_text(page: str, tiers: tuple[set[str], ...], template: frozenset[int] = frozenset()) -> str:
    """The text of the first slots that hold any; marked elements count where there is no other text.

    A page with nothing but template keeps it.
    """
    for some in (template, frozenset()) if template else (template,):
        for slots in tiers:
            if slots and (text := _text(page, slots, some)):
                return text
    return ""


def main_text(page: str, wrapper: list) -> str:
    """The page's text in the wrapper's content slots."""
    return _first_text(page, content_slots(wrapper))


def _host():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))


def _fold(key, rows: pd.DataFrame) -> pd.DataFrame:
    wrapper: list = []
    for i, text in enumerate(sorted(rows["wrapper"])):
        wrapper = align(wrapper, json.loads(text)) if i else json.loads(text)
    return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(wrapper, separators=(",", ":"))]})


def template_lines(pages: DataFrame) -> DataFrame:
    """``host`` and ``template``: digests of the lines that are the same on every page with their place.

    Pages with equal lines are one page: the digest of all lines is part of the first key, so
    that different pages are counted exactly, without a set per line.
    """

    def build():
        def work(hosts, htmls):
            out: dict[str, list] = {"host": [], "place": [], "line": [], "page": []}
            for host, page in zip(hosts, htmls):
                whole, places, lines = line_digests(page)
                for place, line in [*lines, *((place, None) for place in places)]:
                    for name, value in zip(out, (host, place, line, whole)):
                        out[name].append(value)
            return out

        return work

    rows = pages.select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    counts = (
        map_columns(rows, build, "host string, place bigint, line bigint, page bigint")
        .distinct()
        .groupBy("host", "place", "line")
        .agg(F.count("*").alias("n"))
    )
    counts = materialize(counts.filter(F.col("line").isNull() | (F.col("n") >= LEAST_PAGES)), "page-lines")
    whole = counts.filter("line is null").select("host", "place", F.col("n").alias("all"))
    same = counts.filter("line is not null")
    equal = same.join(whole, ["host", "place"]).filter(F.col("n") == F.col("all"))
    return equal.groupBy("host").agg(F.array_sort(F.collect_set("line")).alias("template"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host`` and ``wrapper`` (an expression as JSON) from all pages of each host."""

    def build():
        def work(hosts, htmls):
            found = [json.dumps(page_expression(h), separators=(",", ":")) for h in htmls]
            return {"host": hosts, "wrapper": found}

        return work

    rows = pages.select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    kinds = map_columns(rows, build, "host string, wrapper string").groupBy("host", "wrapper").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).alias("salt")
    parts = kinds.groupBy("host", salt).applyInPandas(lambda key, rows: _fold(key, rows), "host string, wrapper string")
    return parts.groupBy("host").applyInPandas(lambda key, rows: _fold(key, rows), "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``.

    A null page is empty; pages without a host share one wrapper. Broken markup is balanced: a
    tag ends what cannot contain it, the page's end closes the rest, and a ``<`` that starts no
    tag is text. Repeated rows give repeated results. Wrappers are written once to the shared
    folder and joined with a salt, so a host with very many pages meets its wrapper in many tasks.
    Template lines are dropped; where no line of a page differs from its host's, all are kept.
    """
    known_lines = template_lines(pages)
    wrappers = materialize(infer_wrappers(pages).join(known_lines, "host", "left"), "wrappers")
    copies = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"),
        F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"),
    ).join(copies, ["host", "salt"], "left")

    def build():
        known: dict[str, tuple[set, set, set]] = {}

        def work(ids, urls, htmls, texts, templates):
            out = []
            for page, wrapper, template in zip(htmls, texts, templates):
                if wrapper not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[wrapper] = content_slots(json.loads(wrapper))
                out.append(_first_text(page, known[wrapper], frozenset(template or ())))
            return {"page_id": ids, "url": urls, "text": out, "n_chars": [len(t) for t in out]}

        return work

    return map_columns(
        rows.select("page_id", "url", "html", F.coalesce("wrapper", F.lit("[]")), "template"), build,
        "page_id bigint, url string, text string, n_chars bigint",
    )

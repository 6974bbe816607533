"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import map_columns, texts_of

SPAN = "kind string, start int, end int, score double"
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
# Spans of the added kinds with a lower score are not reported.
MIN_SCORE = 0.6
# Characters before and after a span in which context words count.
WINDOW = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The part before a match is no digit: a run of digits fails or matches as a whole.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)"
    r"(?![A-Za-z0-9])"
)
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write to|mailto", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login", re.I),
    "card": re.compile(r"card|visa|mastercard|credit|payment|cvv", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|fax|whatsapp", re.I),
    "iban": re.compile(r"iban|account|bank|transfer|konto|compte|cuenta", re.I),
    "ssn": re.compile(r"\bssn\b|social security|tax\W{0,3}id", re.I),
}
_DOUBT = re.compile(r"version|example|sample|isbn|part no|serial|build", re.I)
_START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The checksum of international account numbers."""
    rest = 0
    for c in account[4:] + account[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches found from their ``@``, so that long runs of name characters cost one pass."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", max(at + 1, free))
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _proposals(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans of every kind, in the order of the kinds and by start."""
    spans = [("email", s, e) for s, e in _emails(text)]
    spans += [
        ("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))
    ]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            spans.append(("phone", *m.span()))
    for m in _IBAN.finditer(text):
        # In the spaced form words may follow; groups are given back until the sum is right.
        end = m.end()
        while end > m.start() + 14:
            account = text[m.start() : end].replace(" ", "")
            if len(account) >= 15 and mod97(account):
                spans.append(("iban", m.start(), end))
                break
            end = text.rfind(" ", m.start(), end)
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            spans.append(("ssn", *m.span()))
    return spans


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """Spans with scores. The four base kinds are always kept, the others by their score."""
    out = []
    for kind, start, end in _proposals(text):
        near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
        score = _START_SCORE[kind]
        score += 0.3 * bool(_CONTEXT[kind].search(near)) - 0.3 * bool(_DOUBT.search(near))
        score = round(min(1.0, max(0.0, score)), 2)
        if kind in BASE_KINDS or score >= MIN_SCORE:
            out.append((kind, start, end, score))
    return out


def redacted(text: str) -> str:
    """The text with each stretch of personal data replaced by its kind in brackets."""
    pieces, done = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e, _ in spans_of(text)):
        end = -end
        if start >= done:
            pieces += [text[done:start], f"[{kind}]"]
        done = max(done, end)
    return "".join([*pieces, text[done:]])


def _finder():
    def work(ids, texts):
        names = ("kind", "start", "end", "score")
        return {
            "doc_id": ids,
            "spans": [[dict(zip(names, s)) for s in spans_of(t)] for t in texts],
        }

    return work


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, an array of kind, start, end (code points, exclusive), score.

    One row per input row, in one pass without a shuffle. A null text counts as empty and has
    no spans; repeated rows give repeated results; a null ``doc_id`` is handed through.
    """
    return map_columns(texts_of(docs), _finder, f"doc_id bigint, spans array<struct<{SPAN}>>")


def redact(docs: DataFrame) -> DataFrame:
    """All columns, personal data in ``text`` replaced by its kind; null texts stay null.

    ``n_chars``, if there, is set to the new length in code points.
    """
    column = F.udf(lambda t: redacted(t) if t else t, "string", useArrow=True)
    out = docs.withColumn("text", column(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans per document."""

    def joined(spans):
        label = F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.sha2(F.concat_ws(",", label), 256)

    def of(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    all_spans = F.transform(
        F.col("spans"),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        joined(base).alias("base_sha256"),
        F.concat_ws(",", all_spans).alias("spans"),
    )

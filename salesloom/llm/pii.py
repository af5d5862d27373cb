"""Personal data in texts, also in disguise: the text is rewritten by transducers that keep offsets.

Three transducers in turn replace characters that look like ASCII ones, spelled digits, and spelled signs of addresses.
Each knows for every character of its output which stretch of its input it stands for; what is detected in the last
output is mapped back to the source. Spans are code points of the source, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from salesloom.llm.common import id_and_text, per_batch

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the plain identifiers. An address's name is looked up backwards from its sign, and a number starts
# where no digit stands before: the same matches as searching from the left, in linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    found, at, end = [], 0, 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _NAME_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, match.end()))
            at = end = match.end()
        else:
            at += 1
    return found


def _ips(text: str) -> list[Span]:
    return [
        m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    ]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def _phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


FINDERS: dict[str, Callable[[str], list[Span]]] = dict(zip(KINDS, (_emails, _ips, _cards, _phones)))


def detect(text: str) -> list[tuple[str, int, int]]:
    """Plain identifiers: (kind, start, end), by kind and then start."""
    return [(kind, s, e) for kind in KINDS for s, e in FINDERS[kind](text)]


class Mapped:
    """A rewritten text and where it comes from: stretches that were copied, and those that stand for others.

    A stretch is (start in the text, start and end in the source, whether copied). An unchanged text of any length is one
    stretch, and each edit adds two, so that what is held besides the text follows the edits.
    """

    def __init__(self, text: str, stretches: list[tuple[int, int, int, bool]] | None = None):
        self.text = text
        self.stretches = [(0, 0, len(text), True)] if stretches is None else stretches
        self.begins = [x[0] for x in self.stretches]

    def rewritten(self, edits: list[tuple[int, int, str]]) -> "Mapped":
        """``edits`` are (start, end, replacement) in order, none overlapping."""
        if not edits:
            return self
        parts: list[str] = []
        out: list[tuple[int, int, int, bool]] = []
        at = size = 0
        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            for begin, low, high, copied in self._between(at, s):
                out.append((size + begin - at, low, high, copied))
            parts += (self.text[at:s], new)
            size += s - at
            if new and e > s:
                out.append((size, *self.source(s, e), False))
                size += len(new)
            at = e
        return Mapped("".join(parts), out)

    def _between(self, start: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
        """The stretches of a part of the text, cut to it."""
        if start >= end:
            return
        for k in range(bisect_right(self.begins, start) - 1, len(self.begins)):
            begin, low, high, copied = self.stretches[k]
            if begin >= end:
                return
            if copied:
                skip = max(0, start - begin)
                yield begin + skip, low + skip, min(high, low + end - begin), True
            else:
                yield max(begin, start), low, high, False

    def source(self, start: int, end: int) -> Span:
        first, last = (self.stretches[bisect_right(self.begins, at) - 1] for at in (start, end - 1))
        return first[1] + (start - first[0] if first[3] else 0), last[1] + end - last[0] if last[3] else last[2]


# Letters of other scripts that look like ASCII letters, and what they look like.
_LOOKS = dict(
    zip(
        "авсԁеһіјкӏмпорԛгѕтуѵԝхАВСЕНІЈКМОРЅТУХԌԚԜαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧɑɡɩʏℓ",
        "abcdehijklmnopqrstuvwxABCEHIJKMOPSTYXGQWaeikvoptuxABEZHIKMNOPTYXagiyl",
        strict=True,
    )
)
#: Signs that stand for those of identifiers; and characters that show nothing.
_SIGNS = {"․": ".", "。": ".", "·": ".", "‧": ".", "∙": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹫": "@", " ": " ", " ": " ", " ": " "}
_UNSEEN = "­​‌‍⁠﻿"


def _look(c: str) -> str | None:
    """The ASCII text that a character may pass for, if it isn't ASCII; empty for one that shows nothing."""
    if c in _UNSEEN:
        return ""
    if c in _LOOKS:
        return _LOOKS[c]
    if c in _SIGNS:
        return _SIGNS[c]
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)  # full-width and styled letters
    if len(folded) == 1 and folded.isascii() and folded.isprintable() and folded != c:
        return folded
    return None


class _Looks(dict):
    def __missing__(self, c: str) -> str | None:
        self[c] = found = _look(c)
        return found


_looks = _Looks()
_FOREIGN = re.compile(r"[^\x00-\x7f]")


def homoglyphs(text: Mapped) -> Mapped:
    if text.text.isascii():
        return text
    return text.rewritten(
        [(m.start(), m.end(), new) for m in _FOREIGN.finditer(text.text) if (new := _looks[m[0]]) is not None]
    )


# The digits 0 to 9 by name, in four languages.
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGIT = {name: str(d) for names in DIGIT_NAMES for d, name in enumerate(names.split())}
_NAMES = "|".join(sorted(_DIGIT, key=len, reverse=True))
_DIGIT_WORD = rf"(?:{_NAMES})(?![^\W_])"
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[\x20-]?(?={_DIGIT_WORD}))?{_DIGIT_WORD}(?:[\x20,-]{{1,2}}(?:dot[\x20-])?{_DIGIT_WORD}|[\x20-]?(?:\[dot\]|\(dot\)|\.)[\x20-]?{_DIGIT_WORD})+", re.I)
_SPELLED_PART = re.compile(rf"(plus)|({_NAMES})(?![^\W_])|(dot|\.)|[\x20,()\[\]-]+", re.I)
#: A single name between figures of one number.
_LONE = re.compile(rf"(?<=[0-9][\x20-])({_NAMES})(?=[\x20-][0-9])", re.I)
_PLUS_DIGIT = re.compile(r"(?<![^\W_])plus\x20(?=[0-9])", re.I)


def spelled_digits(text: Mapped) -> Mapped:
    """Runs of two digit names or more, and single ones between figures, become digits, with ``plus`` before and ``dot``
    between them as signs."""
    edits = []
    for run in _SPELLED.finditer(text.text):
        for part in _SPELLED_PART.finditer(text.text, run.start(), run.end()):
            new = "+" if part[1] else _DIGIT[part[2].lower()] if part[2] else "." if part[3] else ""
            edits.append((part.start(), part.end(), new))
    text = text.rewritten(edits)
    text = text.rewritten([(m.start(), m.end(), _DIGIT[m[1].lower()]) for m in _LONE.finditer(text.text)])
    return text.rewritten([(m.start(), m.end(), "+") for m in _PLUS_DIGIT.finditer(text.text)])


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT = rf"(?:\x20?{_OPEN}\x20?(?:at|@|arroba)\x20?{_CLOSE}\x20?|\x20-at-\x20)"
_DOT = rf"(?:\x20?{_OPEN}\x20?(?:dot|\.|punkt|point|punto|do?t)\x20?{_CLOSE}\x20?|\x20-dot-\x20)"
_LABEL = r"[A-Za-z0-9-]+"
# A bare "at" counts only before a domain with a disguised dot, a bracketed one before any domain, and an @ between blanks
# before one that ends in letters.
_ADDRESS = re.compile(
    rf"(?<=[A-Za-z0-9_%+-])(?:(?P<at>{_AT})(?P<d1>{_LABEL}(?:(?:{_DOT}|\x20dot\x20|\.){_LABEL})+)"
    rf"|(?P<bare>\x20(?:at|@)\x20|@)(?P<d2>{_LABEL}(?:\.{_LABEL})*(?:{_DOT}|\x20dot\x20){_LABEL}(?:(?:{_DOT}|\x20dot\x20|\.){_LABEL})*)"
    rf"|(?P<apart>\x20@\x20)(?P<d3>{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}(?![A-Za-z0-9-])))",
    re.I,
)
_DOTS = re.compile(rf"{_DOT}|\x20dot\x20", re.I)
_NAME_DOTS = re.compile(rf"{_DOT}|\x20dot\x20", re.I)
_NUMBER_DOTS = re.compile(rf"(?<=[0-9])(?:{_DOT}|\x20dot\x20)(?=[0-9])", re.I)
_HINT = re.compile(r"[\[({<]\x20?(?:at|@|arroba|dot|\.|punkt|point|punto)|\x20(?:-?at-?|-?dot-?|@)\x20", re.I)
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_DOT_BEFORE = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:{_DOT}|\x20dot\x20)\Z", re.I)
_LONGEST_DOT = 12  # no disguised dot is longer


def _name_start(text: str, end: int) -> int:
    """Where the name that ends at ``end`` starts, however long it is."""
    while end > 0 and text[end - 1] in _NAME:
        end -= 1
    return end


def address_signs(text: Mapped) -> Mapped:
    """``at`` and ``dot``, spelled or in brackets, become signs inside what then reads as an address or a number."""
    if not _HINT.search(text.text):
        return text
    edits = []
    for m in _ADDRESS.finditer(text.text):
        sign, domain = ("at", "d1") if m["at"] else ("bare", "d2") if m["bare"] else ("apart", "d3")
        # a dot spelled inside the name, right before the sign
        at = m.start()
        names = []
        low = edits[-1][1] if edits else 0
        while at > low and (start := _name_start(text.text, at)) < at:
            dot = _DOT_BEFORE.search(text.text, max(0, start - _LONGEST_DOT), start)
            if dot is None:
                break
            names.append((dot.start(), dot.end(), "."))
            at = dot.start()
        edits += [x for x in reversed(names) if not edits or x[0] >= edits[-1][1]]
        edits.append((m.start(sign), m.end(sign), "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOTS.finditer(text.text, m.start(domain), m.end(domain))]
    text = text.rewritten(edits)
    return text.rewritten([(m.start(), m.end(), ".") for m in _NUMBER_DOTS.finditer(text.text)])


def disguised(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans found after rewriting only: those that no plain span of their kind covers."""
    rewritten = address_signs(spelled_digits(homoglyphs(Mapped(text))))
    if rewritten.text == text:
        return []
    held: dict[str, list[Span]] = {k: [] for k in KINDS}
    for kind, s, e in plain:
        held[kind].append((s, e))
    found = []
    for kind, s, e in detect(rewritten.text):
        start, end = rewritten.source(s, e)
        if not any(a <= start and end <= b for a, b in held[kind]):
            found.append((kind, start, end))
    return found


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The plain spans, and all spans with the disguised ones; by kind, then start."""
    plain = detect(text)
    more = disguised(text, plain)
    return plain, sorted({*plain, *more}, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if more else plain


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the plain spans, spans (all).

    Null and empty texts have no spans. Repeated rows give repeated rows; an empty table gives an empty one.
    """

    def make(batch: pa.RecordBatch) -> dict:
        found = [spans_of(t) for t in batch.column(1).to_pylist()]
        out = {
            "doc_id": batch.column(0),
            "base_sha256": pa.array([hashlib.sha256(_joined(p).encode()).hexdigest() for p, _ in found], pa.string()),
            "spans": pa.array([_joined(a) for _, a in found], pa.string()),
        }
        for kind in KINDS:
            out[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in p) for p, _ in found], pa.int64())
        return out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return per_batch(id_and_text(docs), schema, make)

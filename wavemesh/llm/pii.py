"""Personal data in texts, found also where it is disguised, with spans in the text as it stands.

First the plain detectors run over the text. Then transducers rewrite look-alike characters, take out invisible ones, and
rewrite bracketed, underscored and spoken @ and dot, spelled-out digits, alone among numerals too, and letters that stand
for numerals, each on the output of the one before, keeping for every character they put out the span it came from; the
detectors run over the result, and what they find across a rewritten place is mapped back to the source.
Plain finds always stay; a mapped one is added unless it lies within one of them.

Defined cases: a null or empty text has no spans; rows that repeat give the same spans each; no rows give no rows; all
scans are linear in the text, so very long texts and runs of one character are only as slow as they are long; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_ZONE = re.compile(r"[0-9][0-9 .-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, 0, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index into KINDS, end) of the plain detectors, sorted."""
    found = list(_emails(text))
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        if text.count(".", a, b) >= 3:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text, a, b) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
        if b - a >= 12:
            for m in _CARD.finditer(text, a, b):
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
    "․": ".", "。": ".", "﹒": ".", "·": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
# Characters of no width, and letters written for numerals.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
NUMERALS = {"l": "1", "I": "1", "O": "0", "o": "0"}
#: The spelled digits, in the order of their values.
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_DIGIT = "(?:" + "|".join(DIGITS) + ")"
_ODD = re.compile("[" + "".join(map(re.escape, LOOK_ALIKES)) + INVISIBLE + "！-～٠-٩۰-۹०-९]")
_SPELLED = re.compile(rf"(?:\bplus[ ,-]+)?\b{_DIGIT}(?:[ ,-]+{_DIGIT}\b)+(?:[ ]+dot[ ]+{_DIGIT}(?:[ ,-]+{_DIGIT}\b)*)*")
_WORDS = re.compile(rf"\b(?:plus|dot|{_DIGIT})\b")
# what follows a token is looked at with it, so that a chain is gone through once
_MIXED = re.compile(rf"\b(?:{_DIGIT}|[0-9]++)\b(?:[ .-](?:{_DIGIT}|[0-9]++)\b)++")
_LETTERS = "".join(NUMERALS)
_NUMBER = re.compile(rf"(?<![A-Za-z0-9])[0-9{_LETTERS}]++(?![A-Za-z0-9])(?:[ .-][0-9{_LETTERS}]++(?![A-Za-z0-9]))*+")
_NUMERAL, _LETTER = re.compile(r"[0-9]"), re.compile(f"[{_LETTERS}]")
_UNDERSCORED_AT = re.compile(r"(?<=[a-z0-9%+-])_at_(?=[a-z0-9-]++_dot_[a-z0-9])")
_UNDERSCORED_DOT = re.compile(r"(?<=[a-z0-9%+-])_dot_(?=[a-z0-9])")
_BRACKETED = re.compile(r"[ ]?[\[({<][ ]?(?:(at|@)|dot|\.)[ ]?[\])}>][ ]?")
_SPOKEN_AT = re.compile(r"@|(?<=[a-z0-9_%+-])[ ]at[ ]")
_SPOKEN_DOMAIN = re.compile(r"[a-z0-9-]++(?:(?:\.|[ ]dot[ ])[a-z0-9-]++)+")
_DOT = " dot "
_SPOKEN_DOT = re.compile(_DOT)


def _lower(text: str) -> str:
    low = text.lower()
    # a few letters change their length
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


# What the transducers replace: (start, end, by), sorted, without overlaps.


def _look_alikes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    plain = lambda c: "" if c in INVISIBLE else LOOK_ALIKES.get(c) or (chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else str(unicodedata.digit(c)))
    return [(m.start(), m.end(), plain(m[0])) for m in _ODD.finditer(text)]


def _underscored(low: str) -> list[tuple[int, int, str]]:
    """Underscored at and dot as spoken ones, if an at is followed by a dot."""
    if "_dot_" not in low or not (ats := [m.span() for m in _UNDERSCORED_AT.finditer(low)]):
        return []
    return sorted([(a, b, " at ") for a, b in ats] + [(m.start(), m.end(), _DOT) for m in _UNDERSCORED_DOT.finditer(low)])


def _bracketed(low: str) -> list[tuple[int, int, str]]:
    if not any(f"{p}{c}" in low for p in ("at", "at ", "@", "@ ", "dot", "dot ", ".", ". ") for c in "])}>"):
        return []
    return [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(low)]


def _spoken(low: str, dots: list[int]) -> list[tuple[int, int, str]]:
    """Spoken at and dot in addresses. A spoken at counts only with a spoken dot behind it or a dot of dots, the places
    of the bracketed ones: 'look at example.com' is no address."""
    if _DOT not in low and not (dots and " at " in low):
        return []
    out, done = [], 0
    for m in _SPOKEN_AT.finditer(low):
        a, b = m.span()
        if a < done or not (domain := _SPOKEN_DOMAIN.match(low, b)):
            continue
        start, local = a, []
        while True:
            word = start
            while word > done and low[word - 1] in _LOCAL:
                word -= 1
            if word == start:
                break
            start = word
            if word - 6 < done or low[word - 5 : word] != _DOT or low[word - 6] not in _LOCAL or low[word - 6] == ".":
                break
            local.append(word - 5)
            start = word - 5
        if start == a:
            continue
        k = bisect.bisect_left(dots, start)
        if m[0] == "@" or _DOT in domain[0] or k < len(dots) and dots[k] < domain.end():
            out += [(at, at + 5, ".") for at in reversed(local)]
            out += [(a, b, "@")] if m[0] != "@" else []
            out += [(d.start(), d.end(), ".") for d in _SPOKEN_DOT.finditer(low, b, domain.end())]
            done = domain.end()
    return out


def _spelled(low: str) -> list[tuple[int, int, str]]:
    out = []
    if any(w in low for w in DIGITS):
        for m in _SPELLED.finditer(low):
            last = m.start()
            for w in _WORDS.finditer(low, m.start(), m.end()):
                out.append((last, w.end(), "+" if w[0] == "plus" else "." if w[0] == "dot" else str(DIGITS.index(w[0]))))
                last = w.end()
    return out


def _mixed(low: str) -> list[tuple[int, int, str]]:
    """Spelled digits that stand in a chain with numerals or others."""
    if not any(w in low for w in DIGITS):
        return []
    return [(w.start(), w.end(), str(DIGITS.index(w[0]))) for m in _MIXED.finditer(low) for w in _WORDS.finditer(low, m.start(), m.end())]


def _numerals(text: str) -> list[tuple[int, int, str]]:
    """Letters for numerals in chains of tokens of such letters and numerals, which hold both."""
    if not _NUMERAL.search(text):
        return []
    return [(c.start(), c.end(), NUMERALS[c[0]]) for m in _NUMBER.finditer(text) if _NUMERAL.search(m[0]) for c in _LETTER.finditer(text, m.start(), m.end())]


class _Layer:
    """A text with its changes made, and the way back to the places before them."""

    def __init__(self, text: str, changes: list[tuple[int, int, str]]):
        # the start in the new text and in the old one of every run that was copied or replaced
        pieces, self.starts, self.ends, self.touched, at, size = [], [], [], [], 0, 0
        for a, b, by in changes:
            if a > at:
                pieces.append(text[at:a]), self.starts.append(size), self.ends.append((at, None))
                size += a - at
            pieces.append(by), self.starts.append(size), self.ends.append((a, b)), self.touched.append(size)
            size += len(by)
            at = b
        if at < len(text):
            pieces.append(text[at:]), self.starts.append(size), self.ends.append((at, None))
        self.text = "".join(pieces)

    def changed(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.touched, a)
        return k < len(self.touched) and self.touched[k] < b

    def source(self, i: int, end: bool) -> int:
        k = bisect.bisect_right(self.starts, i) - 1
        a, b = self.ends[k]
        return (b if end else a) if b is not None else a + i - self.starts[k] + end


def disguised_spans(text: str) -> list[tuple[int, int, int]]:
    """Finds of the detectors on the rewritten text that hold a rewritten place, as spans of the text."""
    layers: list[_Layer] = []

    def rewritten(changes: list[tuple[int, int, str]]) -> None:
        nonlocal text, low
        if changes:
            layers.append(_Layer(text, changes))
            text = layers[-1].text
            low = _lower(text)

    low = _lower(text)
    rewritten(_look_alikes(text))
    rewritten(_underscored(low))
    changes = _bracketed(low)
    rewritten(changes)
    dots = [at for at, (_, _, by) in zip(layers[-1].touched, changes, strict=True) if by == "."] if changes else []
    rewritten(_spoken(low, dots))
    rewritten(_spelled(low))
    rewritten(_mixed(low))
    rewritten(_numerals(text))
    found = set()
    for a, kind, b in plain_spans(text) if layers else ():
        changed = False
        for layer in reversed(layers):
            changed |= layer.changed(a, b)
            a, b = layer.source(a, False), layer.source(b - 1, True)
        if changed:
            found.add((a, kind, b))
    return sorted(found)


def spans(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, index into KINDS, end, whether a plain detector found it), by start, then kind."""
    if not text:
        return []
    plain = plain_spans(text)
    out = [(*s, True) for s in plain]
    # the greatest end of the plain finds up to each start
    starts, reach = [s[0] for s in plain], list(itertools.accumulate((s[2] for s in plain), max))
    out += [(*s, False) for s in disguised_spans(text) if not (k := bisect.bisect_right(starts, s[0])) or reach[k - 1] < s[2]]
    return sorted(out, key=lambda s: (s[0], s[1], s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": base} for s, k, e, base in spans(t.as_py())] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end, base>>: code points, end exclusive, by start, then kind."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_detect, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are replaced as one, by the
    first one's kind."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        out = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(fresh, out).otherwise(a["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

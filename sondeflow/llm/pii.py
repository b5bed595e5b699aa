"""Personal data, found also behind disguises, with offsets into the source.

Two transducers rewrite a text. The first maps single characters: homoglyphs and full-width forms to ASCII, and invisible
characters to nothing. The second maps tokens: bracketed or spelled "at" and "dot", and runs of spelled digits. Each carries,
for every character it writes, the source span it came from, so their composition maps any span of the normal form back.
The detectors run on the source (base spans, which always stay) and on the normal form (added spans).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeflow.llm.common import from_text, tidy

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The lookbehind and the possessive runs keep these linear; they match what the plain forms match leftmost.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Characters that look like ASCII ones, by script.
_LOOKALIKES = {
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһ": "ABESIJKMHOPCTYXaesijopcyxdqwh",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρυ": "ABEZHIKMNOPTYXoivpu",
    "․‧·。．｡•∙": "........",
    "﹫＠﹢＋‐‑‒–—−": "@@++------",
    "    　": "     ",
}
_CHAR = {a: b for k, v in _LOOKALIKES.items() for a, b in zip(k, v)} | {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
_CHAR |= {chr(base + d): str(d) for base in (0x0660, 0x06F0, 0x0966) for d in range(10)}
_CHAR |= {chr(0x1D7CE + k): str(k % 10) for k in range(50)}
_CHAR |= dict.fromkeys("​‌‍⁠﻿­", "")
_ODD = re.compile("[" + "".join(map(re.escape, _CHAR)) + "]")

_DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT = {w: str(d) for d, w in enumerate(_DIGITS)} | {"oh": "0", "plus": "+"}
_WORD = "|".join((*_DIGITS, "oh"))
_AT = r"[\x20\t]{0,3}[\[({<][\x20\t]{0,3}(?:at|@)[\x20\t]{0,3}[\])}>][\x20\t]{0,3}"
_DOT = r"[\x20\t]{0,3}[\[({<][\x20\t]{0,3}(?:dot|point|\.)[\x20\t]{0,3}[\])}>][\x20\t]{0,3}"
_BARE_DOT = r"(?<=[a-z0-9-])[\x20\t]{1,3}(?:dot|point)[\x20\t]{1,3}(?=[a-z0-9])"
# Last labels of domains that are no common words, needed where an address is only spelled or parted by blanks.
_LAST = "com|org|net|edu|gov|mil|info|biz|io|co|ai|app|dev|tv|uk|de|fr|es|nl|eu|ch|se|dk|fi|pl|pt|cz|ru|ca|au|jp|cn|br|mx|test|example|invalid"
_BETWEEN = rf"(?:{_DOT}|[\x20\t]{{1,3}}dot[\x20\t]{{1,3}})"
_BARE_AT = rf"(?<=[a-z0-9])[\x20\t]{{1,3}}at[\x20\t]{{1,3}}(?=(?:[a-z0-9-]{{1,63}}{_BETWEEN}){{1,4}}(?:{_LAST})\b)"
# "jane at example.com": only where a word for writing stands shortly before. "jane @ example . com": blanks round signs of an address.
_CUED_AT = r"(?<=[a-z0-9])[\x20\t]{1,3}at[\x20\t]{1,3}(?=[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){1,4})"
_SPACED_AT = r"(?<=[a-z0-9_])(?:\x20{1,2}@\x20{0,2}|@\x20{1,2})(?=[a-z0-9-]{1,63}\x20{0,2}\.\x20{0,2}[a-z]{2})"
# Words for writing.
_CUE = re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address)", re.I)
_SPACED_DOT = rf"(?<=[a-z0-9])\x20{{1,2}}\.\x20{{0,2}}(?=(?:{_LAST})\b)|(?<=[a-z0-9])\.\x20{{1,2}}(?=(?:{_LAST})\b)"
_ONE = rf"(?:(?:double|triple)[\x20-]{{1,3}})?(?:{_WORD})\b"
_SPELLED = rf"(?:\bplus[\x20-]{{1,3}})?\b{_ONE}(?:[\x20.-]{{1,3}}{_ONE})+"
_LETTERS = r"(?<=[0-9])[oil]{1,3}(?=[\x20.-]?[0-9])|(?<=[0-9]\.)[oil](?=\.[0-9])|(?<![a-z0-9])[oil](?=[0-9][0-9\x20.-]{6})"
_TOKEN = re.compile(rf"(?P<at>{_AT}|{_BARE_AT}|{_SPACED_AT})|(?P<cued>{_CUED_AT})|(?P<dot>{_DOT}|{_BARE_DOT}|{_SPACED_DOT})|(?P<digits>{_SPELLED})|(?P<letters>{_LETTERS})", re.I)
_HINT = re.compile(rf"\b(?:dot|point|{_WORD})\b|[\[({{<][\x20\t]{{0,3}}(?:at|@|\.)[\x20\t]{{0,3}}[\])}}>]", re.I)
_LETTER_HINT = re.compile(r"[0-9][oilOIL][\x20.-]?[0-9oilOIL]|\b[oilOIL][0-9][0-9\x20.-]|[0-9]\.[oilOIL]\.")
_SPELLED_WORD = re.compile(rf"\b(?:plus|double|triple|{_WORD})\b", re.I)
_NUMERAL = str.maketrans("oOiIlL", "001111")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each at sign outward."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def detect(text: str) -> list[Span]:
    found: list[Span] = [("email", a, b) for a, b in emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Trace:
    """Where the characters of a rewritten text came from: only the places that changed in length are kept, so a long text costs no more than its disguises.

    Each edit is the place of what was written and the place of what it stands for; between edits characters move by a constant. before: the trace of the input.
    """

    def __init__(self, before: Trace | None = None) -> None:
        self.before, self.start, self.rest = before, [], []

    def add(self, start: int, end: int, of: tuple[int, int], after: int) -> None:
        """Characters start to end stand for the input's characters `of`; the input goes on at `after`."""
        self.start.append(start)
        self.rest.append((end, *of, after))

    def _span(self, k: int) -> tuple[int, int]:
        i = bisect_right(self.start, k) - 1
        if i < 0:
            return k, k + 1
        end, a, b, after = self.rest[i]
        return (a, b) if k < end else (k - end + after, k - end + after + 1)

    def low(self, k: int) -> int:
        """Where the source of character k begins."""
        a, _ = self._span(k)
        return self.before.low(a) if self.before else a

    def high(self, k: int) -> int:
        """Where the source of character k ends."""
        _, b = self._span(k)
        return self.before.high(b - 1) if self.before else b


def _rewritten(text: str, pattern: re.Pattern, write, before: Trace | None = None) -> tuple[str, Trace]:
    """One transducer: what it writes, and where its characters came from."""
    out, trace, at, n = [], Trace(before), 0, 0
    for m in pattern.finditer(text):
        s, e = m.span()
        new = write(m)
        out += (text[at:s], new)
        n += s - at
        if len(new) != e - s:
            core = m[0].strip(" \t") if len(new) == 1 else m[0]
            lead = m[0].index(core) if core else 0
            trace.add(n, n + len(new), (s + lead, s + lead + len(core)), e)
        n += len(new)
        at = e
    out.append(text[at:])
    return "".join(out), trace


def _token(m: re.Match) -> str:
    if m["at"]:
        return "@"
    if m["cued"]:
        return "@" if _CUE.search(m.string, max(0, m.start() - 60), m.start()) else m[0]
    if m["dot"]:
        return "."
    if m["letters"]:
        return m[0].translate(_NUMERAL)
    out, times = [], 1
    for w in map(str.lower, _SPELLED_WORD.findall(m[0])):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out.append(_DIGIT[w] * times)
            times = 1
    return "".join(out)


def normalised(text: str) -> tuple[str, Trace] | None:
    """The normal form and where its characters came from; None where no disguise can be."""
    odd = not text.isascii() and _ODD.search(text)
    s, trace = _rewritten(text, _ODD, lambda m: _CHAR[m[0]]) if odd else (text, None)
    spaced = "@" in s and (" @" in s or "@ " in s)
    if spaced or _HINT.search(s) or (" at " in s and _CUE.search(s)) or _LETTER_HINT.search(s):
        return _rewritten(s, _TOKEN, _token, trace)
    return (s, trace) if odd else None


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the normal form adds: not inside a base span of the same kind."""
    base = detect(text)
    if (plain := normalised(text)) is None:
        return base, []
    s, trace = plain
    own = {k: [x[1:] for x in base if x[0] == k] for k in KINDS}
    found = {(kind, trace.low(a), trace.high(b - 1)) for kind, a, b in detect(s)}
    return base, in_order([x for x in found if not _inside(x, own[x[0]])])


def _inside(span: Span, own: list[tuple[int, int]]) -> bool:
    """Whether it lies in one of the spans of its kind, which are in order and don't overlap."""
    i = bisect_right(own, (span[1], float("inf"))) - 1
    return i >= 0 and span[2] <= own[i][1]


def written_out(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    out, at, k = [], 0, 0
    while k < len(found):
        kind, a, b = found[k]
        while k + 1 < len(found) and found[k + 1][1] < b:
            k += 1
            b = max(b, found[k][2])
        out += (text[at:a], f"<{kind.upper()}>")
        at, k = b, k + 1
    return "".join((*out, text[at:]))


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of each document: counts and digest of the base spans, all spans in `spans`, and how many were added.

    docs: doc_id, text; other columns are ignored. A null or empty text has no spans. A null doc_id stays null, repeated rows
    are searched each, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, added = spans(text.as_py() or "")
                kinds = [x[0] for x in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(in_order(base + added)), len(added)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with the spans of the text column replaced; a null text stays null."""

    def kernel(texts: list[bytes]) -> pa.Array:
        new = []
        for raw in texts:
            t = raw.decode()
            base, added = spans(t)
            new.append(redacted(t, in_order(base + added)) if base or added else t)
        return pa.array(new, pa.string())

    return docs.withColumn(text, F.when(F.col(text).isNotNull(), from_text(kernel, "string", F.col(text))))

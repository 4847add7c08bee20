"""Personal data in texts, disguised identifiers included, with spans in the source.

Plain identifiers are found by the base patterns. Texts with signs of a disguise also go through
a chain of transducers (homoglyphs, invisible characters, at/dot words, spelled digits), each of which
keeps the source index of every character it emits. The same patterns run on the normalised text and
their spans are mapped back. Rows without any sign are settled by two linear scans of the batch.

Defined results: a null text counts as empty and has no spans; rows are judged one by one, so repeated
rows and ties need no order; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import session, tidy
from .words import slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Words for @ and . and for the digits 0 to 9 in English, German, French and Spanish.
AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "punkt", "point", "punto")
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Letters of other scripts that look like the Latin letter after them.
LOOKALIKES = "аaеeоoрpсcуyхxіiјjѕsԁdһhԛqԝwАAВBЕEКKМMНHОOРPСCТTХXІIЈJЅSαaοoρpνvιiκkΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX"
#: Characters that stand for "@", "." or "+", and characters without width.
SIGNS = {"﹫": "@", "․": ".", "。": ".", "﹒": ".", "｡": ".", "﹢": "+", " ": " ", "‐": "-", "‑": "-", "–": "-"}
INVISIBLE = "­​‌‍⁠﻿"


def _homoglyphs() -> dict[int, str]:
    table = {ord(a): b for a, b in zip(LOOKALIKES[::2], LOOKALIKES[1::2])} | {ord(a): b for a, b in SIGNS.items()}
    for c in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x2070, 0x208A)):
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and plain.isascii():
            table[c] = plain
    for c in range(0x80, 0x1FFFF):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            table[c] = str(d)
    return table


HOMOGLYPHS = _homoglyphs()
_spelled = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_at, _dot = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_open, _close = r"[\[({<]", r"[\])}>]"
_any_dot = rf"(?:\s*+{_open}\s*+(?:{_dot}|\.)\s*+{_close}\s*+|\s++(?:{_dot})\s++)"
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_BRACKETED_AT = re.compile(rf"[ \t]*+{_open}\s*+(?:{_at}|@)\s*+{_close}[ \t]*+", re.I)
# The default last labels that make a bare "x at y dot z" an address; without them "at the dot in" is one.
TOP_LABELS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "co", "eu", "de", "fr", "uk", "ch", "example", "test", "invalid")


@lru_cache
def _bare_at(labels: tuple[str, ...]) -> re.Pattern:
    return re.compile(rf"(?<=[A-Za-z0-9._%+-])\s++(?:{_at})\s++(?=[A-Za-z0-9-]++(?:(?:\.|{_any_dot})[A-Za-z0-9-]++)*?{_any_dot}(?:{'|'.join(map(re.escape, labels))})\b)", re.I)


_ANY_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_any_dot}(?=[A-Za-z0-9])", re.I)
_SPELLED = re.compile(rf"\b(?:plus[\s-]+)?(?:{_spelled})(?:[\s-]+(?:{_spelled}))*\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_LETTER_DIGIT = re.compile(r"(?<=[0-9])(?:[Oo]+|[lI|]+)(?=[ -]?[0-9])")

#: Rows to which the base patterns, or the transducers, can have anything to say; linear over the batch.
BASE_SIGNS = "[0-9@]"
# what Python's \s has beyond the \s of Arrow's patterns
_blank = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_gap = rf"(?:{_blank}|-)+"
# every rewrite begins with one of these: a bracketed or spaced word, digit words that _spell takes, O or l among digits, a character
DISGUISE_SIGNS = (
    rf"(?i)[\[({{<]{_blank}*(?:{_at}|{_dot}|@|\.){_blank}*[\])}}>]|{_blank}(?:{_dot}){_blank}|(?:(?:^|\W)(?:{_spelled}){_gap}(?:{_spelled}){_gap}(?:{_spelled}))"
    rf"|(?:{_spelled})\.|\.(?:{_spelled})|plus{_gap}(?:{_spelled})"
    r"|[0-9][OolI|]+[ -]?[0-9]|[" + "".join(sorted(map(chr, HOMOGLYPHS))) + INVISIBLE + "]"
)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start and then kind; leftmost, non-overlapping for each kind, in linear time."""
    out, cursor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            cursor = m.end()
        at = text.find("@", max(cursor, at + 1))
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


class Tape:
    """A text with the source range of every character."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, emit) -> None:
        """Replace each match by emit(match); its characters share the match's source range. None keeps it."""
        parts, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = emit(m)
            if new is None or m.start() == m.end():
                continue
            a, b = m.span()
            parts += (self.text[at:a], new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        if at:
            self.text = "".join([*parts, self.text[at:]])
            self.start, self.end = start + self.start[at:], end + self.end[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _spell(m: re.Match, text: str) -> str | None:
    words = [w.lower() for w in _WORD.findall(m[0])]
    plus = words[0] == "plus"
    digits = "".join(DIGIT_WORDS[w] for w in words[plus:])
    dotted = text[m.start() - 1 : m.start()] == "." and text[m.start() - 2 : m.start() - 1].isdigit() or text[m.end() : m.end() + 1] == "." and text[m.end() + 1 : m.end() + 2].isalnum()
    if len(digits) < 3 and not dotted and not plus:
        return None
    return "+" * plus + digits


def disguised_spans(text: str, base: list[tuple[int, int, str]], labels: tuple[str, ...] = TOP_LABELS) -> list[tuple[int, int, str]]:
    """Spans that the patterns find once the text is normalised and that no base span of their kind holds."""
    tape = Tape(text.translate(HOMOGLYPHS))
    tape.rewrite(_INVISIBLE, lambda m: "")
    tape.rewrite(_BRACKETED_AT, lambda m: "@")
    tape.rewrite(_bare_at(labels), lambda m: "@")
    tape.rewrite(_ANY_DOT, lambda m: ".")
    for _ in range(2):  # a digit word may stand beside one that the first round has rewritten
        tape.rewrite(_SPELLED, lambda m: _spell(m, tape.text))
    tape.rewrite(_LETTER_DIGIT, lambda m: "".join("0" if c in "Oo" else "1" for c in m[0]))
    if tape.text == text:
        return []
    out = []
    for a, b, kind in base_spans(tape.text):
        s, e = tape.source(a, b)
        if not any(k == kind and x <= s and e <= y for x, y, k in base):
            out.append((s, e, kind))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(key: str, text: str, labels: tuple[str, ...] = TOP_LABELS):
    def run(batches):
        for batch in slices(batches, text):
            texts = pc.fill_null(batch.column(text), "")
            plain = pc.match_substring_regex(texts, BASE_SIGNS).to_pylist()
            hidden = pc.match_substring_regex(texts, DISGUISE_SIGNS).to_pylist()
            rows = []
            for k in range(len(batch)):
                if not plain[k] and not hidden[k]:
                    rows.append((0, 0, 0, 0, "", ""))
                    continue
                whole = texts[k].as_py()
                base = base_spans(whole) if plain[k] else []
                spans = sorted({*base, *(disguised_spans(whole, base, labels) if hidden[k] else ())}, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
                kinds = [x[2] for x in base]
                rows.append((*map(kinds.count, KINDS), _joined(base), _joined(spans)))
            columns = [list(x) for x in zip(*rows)]
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in columns[4]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(sha, pa.string()), pa.array(columns[5], pa.string())],
                names=[key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return run


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", labels: tuple[str, ...] = TOP_LABELS) -> DataFrame:
    """Per row: counts of base spans by kind, the SHA-256 of the base spans, and all spans (code points, end exclusive).

    labels: last labels of addresses whose "at" has no brackets.
    """
    session(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(_scan(key, text, labels)), f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """`text` with each span of the `spans` column replaced by its kind in brackets; overlaps become one."""
    merged: list[list] = []
    for kind, a, b in (x.split(":") for x in spans.split(",") if x):
        if merged and int(a) < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], int(b))
        else:
            merged.append([int(a), int(b), kind])
    for a, b, kind in reversed(merged):
        text = f"{text[:a]}[{kind}]{text[b:]}"
    return text

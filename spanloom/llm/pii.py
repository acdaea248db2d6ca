"""Personal data: e-mail addresses, IP addresses, card and phone numbers, also in disguise.

The base spans are those of fixed patterns on the text as it is. Then, where a text holds a sign of disguise, transducers
rewrite it: look-alike characters, foreign digits and characters that NFKC makes ASCII become that (one for one), invisible characters go, spelled-out digits become
digits (four in a row, "double five" being two, or any beside figures), and bracketed or spelled "at" and "dot" become @ and full stops. About a spelled "at" both
parts may hold spelled and literal dots, and any word of letters may be the top label (only a well-known one after "point"). Each rewriting carries the source
offsets of every character, so what is then detected maps back to source characters exactly. A span found this way is added if
it holds a rewritten character and no base span of its kind already covers it; base spans always stay.

Null and empty texts have no spans, equal texts equal ones. Positions are in code points, ends exclusive; spans that begin at one place come in the order of
KINDS. Very long texts are searched whole: every pattern runs in time linear in the text. Empty tables give empty results. Extra columns are kept; a column that has the name of the output is replaced.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.bpe import SETTLED, blocks

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Digit runs are taken whole: a match can't start inside one that an earlier start has failed on.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str):
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost and non-overlapping, found from each @."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), in that order."""
    out = []
    if "@" in text:
        out += [(i, 0, j) for i, j in emails(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_LOOKALIKES = {
    "аɑα": "a", "ԁ": "d", "еҽ": "e", "ɡ": "g", "һ": "h", "іι": "i", "ј": "j", "κ": "k", "ⅼ": "l", "ո": "n", "оοσ": "o", "рρ": "p", "ԛ": "q", "ѕ": "s", "ս": "u", "νѵ": "v", "ԝ": "w", "хχ": "x", "уγ": "y",
    "АΑ": "A", "ВΒ": "B", "СϹ": "C", "ЕΕ": "E", "НΗ": "H", "ІΙ": "I", "Ј": "J", "КΚ": "K", "МΜ": "M", "Ν": "N", "ОΟ": "O", "РΡ": "P", "Ѕ": "S", "ТΤ": "T", "ХΧ": "X", "УΥ": "Y", "Ζ": "Z", "сϲ": "c",
    "﹫": "@", "․。｡": ".", "‐‑‒–—−﹣": "-", "﹢": "+",
}
_INVISIBLE = re.compile("[\\u00ad\\u200b-\\u200f\\u2060-\\u2064\\ufeff]")
_DIGIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_ONE_WORD = _WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_DOT = r"(?:dot|punkt|point|punto)"
_AT = r"(?:at|arroba)"
_SEP = r"[\x20,-]{1,2}"
_TIMES = {"double": 2, "triple": 3}
_WORD = rf"(?:(?:(?:double|triple)\x20)?{_WORD})"
_FIGURES = r"[0-9]++(?:\.[0-9]++)*+"
#: Digit words and figures in a row, with dots between them, and a plus before: one number, if _spelled() finds enough in it.
_SPELLED = re.compile(rf"(?:(?<!\w)(?:plus{_SEP})?{_WORD}|(?<!\w)plus{_SEP}{_FIGURES}|(?<![\w.]){_FIGURES})(?!\w)(?:{_SEP}(?:{_DOT}{_SEP})?(?:{_WORD}|{_FIGURES})(?!\w))++", re.I)
_SPELLED_PART = re.compile(rf"(?:(?P<times>double|triple)\x20)?(?P<w>{_ONE_WORD})|(?P<figures>{_FIGURES})|(?P<dot>{_DOT})|(?P<plus>plus)|[\x20,-]+", re.I)
_BRACKETED = re.compile(rf"\x20?[\[({{<]\x20?(?:(?P<at>{_AT}|@)|(?P<dot>{_DOT}|\.))\x20?[\])}}>]\x20?", re.I)
_TOP = "(?:com|org|net|edu|gov|info|biz|dev|app|int|mil|eu|io|ai|co|uk|us|de|fr|es|at|ch|nl|be|it|pl|pt|se|no|dk|fi|ca|au|nz|jp|cn|in|br|ru)"
#: An at, spelled or not, and the labels after it; labels end before the last dot that is none of theirs.
_PLAIN = re.compile(rf"(?:(?P<at>\x20{_AT}\x20)|@)(?P<labels>[A-Za-z0-9-]++(?:(?:\.|\x20{_DOT}\x20)[A-Za-z0-9-]++)++)(?!\w)", re.I)
_PLAIN_DOT = re.compile(rf"\x20({_DOT})\x20", re.I)
_LABEL, _TOP_LABEL = re.compile(r"[A-Za-z]{2,}"), re.compile(_TOP, re.I)
_DOT_LENGTHS = sorted({len(x) + 2 for x in _DOT[3:-1].split("|")})


@functools.cache
def _table() -> dict[int, int]:
    """Characters to the ASCII ones that they look like or stand for, one for one."""
    found = {ord(c): ord(v) for k, v in _LOOKALIKES.items() for c in k}
    found |= dict.fromkeys((*range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000), 0x20)
    found |= {0xFF00 + i: 0x20 + i for i in range(1, 0x5F)} | {0xA0: 0x20}
    for c in range(0x250, 0x20000):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            found.setdefault(c, 0x30 + d)
        elif len(plain := unicodedata.normalize("NFKC", chr(c))) == 1 and plain.isascii():  # mathematical, circled, superscript, full-width ...
            found.setdefault(c, ord(plain))
    return {k: v for k, v in found.items() if k > 0x7F}


class Traced:
    """A text with the source span of each character and whether it was rewritten (nine bytes a character)."""

    def __init__(self, text: str):
        self.text, n = text, len(text)
        self.start, self.end, self.new = np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32), np.zeros(n, bool)

    def translated(self) -> None:
        """Characters become the ASCII ones that they look like or stand for."""
        points = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
        text = self.text.translate(_table())
        self.new |= points(text) != points(self.text)
        self.text = text

    def rewritten(self, pattern: re.Pattern, pieces) -> None:
        """Replaces each match by its pieces: (start, end, new text) within the text."""
        out, start, end, new, at = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            for i, j, s in pieces(m):
                out += [self.text[at:i], s]
                start += [self.start[at:i], np.full(len(s), self.start[i], np.int32)]
                end += [self.end[at:i], np.full(len(s), self.end[j - 1], np.int32)]
                new += [self.new[at:i], np.ones(len(s), bool)]
                at = j
        if at:
            self.text = "".join(out) + self.text[at:]
            self.start, self.end, self.new = (np.concatenate([*x, rest[at:]]) for x, rest in ((start, self.start), (end, self.end), (new, self.new)))


def _spelled(m):
    """Four digit words or more, or any digit word or dot among figures. Separators go, but for those between figures."""
    parts = list(_SPELLED_PART.finditer(m.string, m.start(), m.end()))
    times = lambda p: _TIMES[p["times"].lower()] if p["times"] else 1
    words, figures = sum(times(p) for p in parts if p["w"]), any(p["figures"] for p in parts)
    if words < 4 and not (figures and any(p["w"] or p["dot"] or p["plus"] for p in parts)):
        return
    for k, p in enumerate(parts):
        if p["w"] or p["dot"] or p["plus"]:
            yield p.start(), p.end(), str(_DIGIT_WORDS[p["w"].lower()]) * times(p) if p["w"] else "." if p["dot"] else "+"
        elif not p["figures"] and not (parts[k - 1]["figures"] and parts[k + 1]["figures"]):
            yield p.start(), p.end(), ""


def _marks(m):
    yield m.start(), m.end(), "@" if m["at"] else "."


def _domain(m) -> list[tuple[int, int]] | None:
    """The spelled dots of the domain after an at: up to the last label that is a well-known top one, else to the last of letters alone.

    A "point" is seldom a dot, so only a well-known label may end the domain after it. The labels that follow a spelled dot too many are not taken.
    """
    dots = [(p.start(), p.end(), p[1].lower()) for p in _PLAIN_DOT.finditer(m.string, m.start("labels"), m.end())]
    ends = [*[i for i, _, _ in dots], m.end()]
    best = known = -1
    for k, end in enumerate(ends):
        begin = dots[k - 1][1] if k else m.start("labels")
        label = m.string[max(begin, m.string.rfind(".", begin, end) + 1):end]
        if k == 0 and "." not in m.string[begin:end]:
            continue
        top = _TOP_LABEL.fullmatch(label) is not None
        if top:
            known = k
        if _LABEL.fullmatch(label) and (top or k == 0 or dots[k - 1][2] != "point" or "." in m.string[begin:end]):
            best = k
    best = best if known < 0 else known
    return None if best < 0 else [(i, j) for i, j, _ in dots[:best]]


def _local(text: str, end: int, floor: int) -> list[tuple[int, int]] | None:
    """The spelled dots, last first, of the local part that ends there, or None if there is none."""
    dots, at = [], end
    while True:
        while at > floor and _LOCAL.match(text, at - 1):
            at -= 1
        if at == end:  # what seemed to be a dot has nothing before it
            return dots[:-1] if dots else None
        spelled = next((n for n in _DOT_LENGTHS if at - n >= floor and _PLAIN_DOT.fullmatch(text, at - n, at)), 0)
        if not spelled:
            return dots
        dots.append((at - spelled, at))
        at = end = at - spelled


def _plain():
    """The pieces of _PLAIN's matches, one after the other; a local part starts after the address before it."""
    floor = 0

    def pieces(m):
        nonlocal floor
        after = _domain(m)
        before = None if after is None else _local(m.string, m.start(), floor)
        if before is None:
            return
        floor = m.end()
        for i, j in before[::-1]:
            yield i, j, "."
        if m["at"]:
            yield m.start("at"), m.end("at"), "@"
        for i, j in after:
            yield i, j, "."

    return pieces


def normalised(text: str) -> Traced | None:
    """The rewritten text, or None if nothing is to be rewritten."""
    t = Traced(text)
    if not SETTLED.fullmatch(text):
        t.translated()
        t.rewritten(_INVISIBLE, lambda m: [(m.start(), m.end(), "")])
    t.rewritten(_SPELLED, _spelled)
    t.rewritten(_BRACKETED, _marks)
    t.rewritten(_PLAIN, _plain())
    return t if len(t.text) != len(text) or t.new.any() else None


# Signs of disguise, looked for in lower-cased texts of settled characters; each starts at a rare character or after a space.
_SIGN_DIGITS = re.compile(rf"[^\w](?:{_WORD}){_SEP}(?:{_DOT}{_SEP})?{_WORD}{_SEP}(?:{_DOT}{_SEP})?{_WORD}{_SEP}")
_SIGN_BRACKET = re.compile(rf"[\[({{<]\x20?(?:{_AT}|{_DOT}|@|\.)\x20?[\])}}>]")
_SIGN_PLAIN = re.compile(rf"\x20{_AT}\x20[a-z0-9-]++(?:\.|\x20{_DOT}\x20)[a-z0-9]|@[a-z0-9.-]++\x20{_DOT}\x20[a-z]|[a-z0-9]\x20{_DOT}\x20[a-z0-9._%+-]++@")
_SIGN_FIGURES = re.compile(rf"[0-9]{_SEP}(?:{_DOT}{_SEP})?{_WORD}(?!\w)|[0-9]{_SEP}{_DOT}{_SEP}[0-9]|(?<!\w)(?:{_WORD}|plus){_SEP}(?:{_DOT}{_SEP})?[0-9]")
#: A spelled number of four words has two of these at least, whatever its language.
_DIGIT_START = re.compile(rf"[\x20,-]{_WORD}[\x20,-]")


def disguised(text: str) -> bool:
    """Whether a text may hold something to be rewritten."""
    if not SETTLED.fullmatch(text):
        return True
    low = text.lower()
    if (" at " in low or " arroba " in low or "@" in low) and _SIGN_PLAIN.search(low):
        return True
    if ("(" in low or "[" in low or "{" in low or "<" in low) and _SIGN_BRACKET.search(low):
        return True
    return bool(_DIGIT_START.search(low) and _SIGN_DIGITS.search("\n" + low)) or bool(_SIGN_FIGURES.search(low))


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the rewritten text shows beyond the base spans, in source offsets."""
    if not disguised(text) or (t := normalised(text)) is None:
        return []
    out = []
    for i, rank, j in base_spans(t.text):
        changed = t.new[i:j].any() or (t.start[i + 1:j] != t.end[i:j - 1]).any()
        a, b = int(t.start[i]), int(t.end[j - 1])
        if changed and not any(r == rank and x <= a and b <= y for x, r, y in base):
            out.append((a, rank, b))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]), False)
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(df: DataFrame, text: str = "text", out: str = "pii", keep_text: bool = True) -> DataFrame:
    """df with the spans in order of start, then kind (rank: position in KINDS); base: whether the plain patterns found it."""
    fields = [f for f in df.schema if f.name != out and (keep_text or f.name != text)]
    schema = T.StructType([*fields, T.StructField(out, SPANS, False)])

    def run(batches):
        for batch in batches:
            for part in blocks(batch, text):
                rows = []
                for x in part.column(part.schema.names.index(text)).to_pylist():
                    x = x or ""
                    base = base_spans(x)
                    spans = sorted([(*s, True) for s in base] + [(*s, False) for s in added_spans(x, base)])
                    rows.append([{"start": i, "rank": r, "end": j, "base": b} for i, r, j, b in spans])
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.names.index(f.name)) for f in fields], pa.array(rows, _ARROW)], names=[*[f.name for f in fields], out])

    return df.mapInArrow(run, schema)


def shown(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans) -> str:
    """The text with each span's characters (merged where they overlap) replaced by its kind in angle brackets."""
    out, at = [], 0
    for i, rank, j in sorted((i, r, j) for i, r, j, *_ in spans):
        if i >= at:
            out += [text[at:i], f"<{KINDS[rank]}>"]
        at = max(at, j)
    return "".join(out) + text[at:]

"""Regex: one pattern as Column expressions.

Each method takes a column of text (StringType, or BinaryType if the pattern was built with ``bytes_mode=True``) and returns a lazy Column. Existence, counts,
sums, splits and replacements are Spark's own functions wherever those give the right answer, with the pattern's literals as prefilters
that reach the Parquet reader; spans, captures and windows come from Arrow functions. A null text gives null. Offsets are those of UTF-8 bytes,
ends exclusive (``chars=True`` gives code points). Where an offset that is asked for lies within a character or outside the text, the answer is null.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import regex as _regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.engine import Engine, OffsetError, Offsets
from spanloom.plans.syntax import Alt, Cat, Group, LimitError, Node, Options, PatternError, Repeat, UnsupportedPattern, check_rewrite, escape, parse, quote_meta
from spanloom.plans.translate import plan

__all__ = ["LimitError", "Options", "PatternError", "Regex", "UnsupportedPattern", "check_rewrite", "escape", "quote_meta"]

SPAN = "struct<start:bigint,end:bigint>"
MATCH = "struct<start:bigint,end:bigint,text:string>"
_PA_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


#: Private-use characters that stand for the bounds of a match.
_OPEN, _SHUT = chr(0xE000), chr(0xE001)


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(text: str) -> str:
    """A Java replacement that stands for the text itself."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def mandatory(node: Node, inside: bool = True) -> dict[int, bool]:
    """For each group whether it takes part in every match."""
    if isinstance(node, Group):
        return {node.index: inside} | mandatory(node.part, inside)
    if isinstance(node, Alt):
        return {k: False for p in node.parts for k in mandatory(p, False)} if len(node.parts) > 1 else mandatory(node.parts[0], inside)
    if isinstance(node, Repeat):
        return mandatory(node.part, inside and node.low > 0)
    if isinstance(node, Cat):
        return {k: v for p in node.parts for k, v in mandatory(p, inside).items()}
    return {}


def _static(node: Node) -> int | None:
    """How many groups take part, if every match has as many."""
    if isinstance(node, Group):
        n = _static(node.part)
        return None if n is None else n + 1
    if isinstance(node, Cat):
        each = [_static(p) for p in node.parts]
        return None if None in each else sum(each)
    if isinstance(node, Alt):
        each = {_static(p) for p in node.parts}
        return each.pop() if len(each) == 1 else None
    if isinstance(node, Repeat):
        n = _static(node.part)
        return n if n == 0 or node.low else (0 if node.high == 0 else None)
    return 0


class Regex:
    """A validated pattern; options are those of Options, by keyword."""

    def __init__(self, pattern: str, **options):
        self.source, self.options = pattern, Options(**options)
        self.plan = plan(pattern, self.options)

    # --- about the pattern -------------------------------------------------------------------------------------------------------

    def as_str(self) -> str:
        return self.source

    def capture_names(self) -> list[str | None]:
        """Names of all groups, the whole match first."""
        return list(self.plan.names)

    def captures_len(self) -> int:
        return self.plan.pattern.groups

    def static_captures_len(self) -> int | None:
        """How many groups take part in any match (the whole one included), or None if that varies."""
        n = _static(parse(self.source, self.options).root)
        return None if n is None else n + 1

    def __repr__(self) -> str:
        return f"Regex({self.source!r})"

    # --- helpers ------------------------------------------------------------------------------------------------------------------

    @property
    def _bytes(self) -> bool:
        return self.options.bytes_mode

    def _text(self, c: Column | str) -> Column:
        """The column as characters: in bytes mode one for each byte."""
        c = column(c)
        return F.decode(c, "ISO-8859-1") if self._bytes else c

    def _back(self, c: Column) -> Column:
        return F.encode(c, "ISO-8859-1") if self._bytes else c

    def _arrow(self, result: str, kind: pa.DataType, function: Callable, *columns: Column) -> Column:
        """function(engine, text, offsets, *arguments) over the rows in which nothing is null; null where an offset is none of the text's."""
        source, options, raw = self.source, self.options, self._bytes

        def run(*arrays: pa.Array) -> pa.Array:
            engine, out = Engine(source, options), []
            for row in zip(*[a.to_pylist() for a in arrays]):
                if any(v is None for v in row):
                    out.append(None)
                else:
                    text = row[0].decode("latin-1") if raw else row[0]
                    try:
                        out.append(function(engine, text, Bytes(text) if raw else Offsets(text) if isinstance(text, str) else None, *row[1:]))
                    except OffsetError:
                        out.append(None)
            return pa.array(out, kind)

        return F.arrow_udf(run, result)(*columns)

    # --- search -------------------------------------------------------------------------------------------------------------------

    def is_match(self, c: Column | str) -> Column:
        """Whether there is a match. Literals become string functions; otherwise a text that every match holds is tested first."""
        p, t = self.plan, self._text(c)
        if p.literal is not None:
            whole = F.lit(p.literal)
            if p.anchored_start and p.anchored_end:
                return t == whole
            return t.startswith(whole) if p.anchored_start else t.endswith(whole) if p.anchored_end else t.contains(whole)
        if p.texts and not self._bytes:
            found = t.contains(F.lit(p.texts[0]))
            for x in p.texts[1:]:
                found = found | t.contains(F.lit(x))
            return found
        if p.unsafe:
            slow = lambda x: self._arrow("boolean", pa.bool_(), lambda e, s, _: e.at(s, 0) is not None, x)
            if not p.required:
                return slow(column(c))
            # The automaton runs over the whole of each text that holds what every match holds; the other texts reach it as nulls.
            held = t.contains(F.lit(p.required))
            return F.when(held, slow(F.when(held, column(c)))).otherwise(held)
        test = t.rlike(p.java)
        for known in ([t.startswith(F.lit(p.starts))] if p.starts else []) + ([t.endswith(F.lit(p.ends))] if p.ends else []) + ([t.contains(F.lit(p.required))] if p.required and p.required not in p.starts + "\0" + p.ends else []):
            test = known & test
        return test

    def is_match_at(self, c: Column | str, start: Column | int) -> Column:
        """Whether there is a match from a byte offset on; assertions see the whole text."""
        return self._arrow("boolean", pa.bool_(), lambda e, s, o, i: e.at(s, o.chars(i)) is not None, column(c), _whole(start))

    def is_match_window(self, c: Column | str, start: Column | int, end: Column | int) -> Column:
        """Whether there is a match within two byte offsets; assertions see the whole text."""
        return self._arrow("boolean", pa.bool_(), lambda e, s, o, i, j: e.window(s, o.chars(i), o.chars(j)) is not None, column(c), _whole(start), _whole(end))

    def _around(self, t: Column) -> Column:
        """The text before the first match and that after it, as an array; one entry if there is no match."""
        return F.split(t, self.plan.java, 2)

    def _size(self, t: Column, chars: bool = False) -> Column:
        return (F.length(t) if chars or self._bytes else F.octet_length(t)).cast("bigint")

    def _first(self, t: Column, function: Callable[[Column, Column], Column]) -> Column:
        """function(text before, text of the first match), by Spark's own functions; null without a match."""
        found = F.get(F.transform(F.array(F.struct(self._around(t).alias("a"), F.regexp_extract(t, self.plan.java, 0).alias("m"))), lambda x: F.when(F.size(x["a"]) > 1, function(x["a"][0], x["m"]))), F.lit(0))
        return F.when(self.is_match_text(t), found)

    def is_match_text(self, t: Column) -> Column:
        """What is_match() tests for, over a column of characters."""
        p = self.plan
        return t.contains(F.lit(p.required)) & t.rlike(p.java) if p.required else t.rlike(p.java)

    def find(self, c: Column | str, chars: bool = False) -> Column:
        """The first match's span, null if there is none."""
        if self.plan.builtin:
            return self._first(self._text(c), lambda before, m: F.struct(self._size(before, chars).alias("start"), (self._size(before, chars) + self._size(m, chars)).alias("end")))
        return self._arrow(SPAN, _PA_SPAN, lambda e, s, o: _span(e.at(s, 0), o, chars), column(c))

    def find_at(self, c: Column | str, start: Column | int, chars: bool = False) -> Column:
        return self._arrow(SPAN, _PA_SPAN, lambda e, s, o, i: _span(e.at(s, o.inside(i) if chars else o.chars(i)), o, chars), column(c), _whole(start))

    def find_window(self, c: Column | str, start: Column | int, end: Column | int) -> Column:
        return self._arrow(SPAN, _PA_SPAN, lambda e, s, o, i, j: _span(e.window(s, o.chars(i), o.chars(j)), o, False), column(c), _whole(start), _whole(end))

    def find_text(self, c: Column | str) -> Column:
        """The first match's span and text."""
        if self.plan.builtin and not self._bytes:
            return self._first(column(c), lambda before, m: F.struct(self._size(before).alias("start"), (self._size(before) + self._size(m)).alias("end"), m.alias("text")))
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.binary() if self._bytes else pa.string())])
        return self._arrow(MATCH.replace("string", "binary") if self._bytes else MATCH, kind, self._with_text, column(c))

    @property
    def _with_text(self):
        raw = self._bytes
        return lambda e, s, o: None if (m := e.at(s, 0)) is None else _span(m, o, False) | {"text": s[m[0]:m[1]].encode("latin-1") if raw else s[m[0]:m[1]]}

    def find_text_at(self, c: Column | str, start: Column | int) -> Column:
        """The span and the text of the first match from a byte offset on."""
        raw = self._bytes
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.binary() if raw else pa.string())])
        told = lambda e, s, o, i: None if (m := e.at(s, o.chars(i))) is None else _span(m, o, False) | {"text": s[m[0]:m[1]].encode("latin-1") if raw else s[m[0]:m[1]]}
        return self._arrow(MATCH.replace("string", "binary") if raw else MATCH, kind, told, column(c), _whole(start))

    def find_texts(self, c: Column | str, chars: bool = False) -> Column:
        """array<struct<start, end, text>> of all matches."""
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
        return self._arrow(f"array<{MATCH}>", kind, lambda e, s, o: [_span(m, o, chars) | {"text": s[m[0]:m[1]]} for m in e.spans(s)], column(c))

    def find_capped(self, c: Column | str, cap: int) -> Column:
        """struct<spans, total>: the first spans, cap of them at most, and how many there are."""
        kind = pa.struct([("spans", pa.list_(_PA_SPAN)), ("total", pa.int64())])

        def run(e, s, o):
            spans, total = [], 0
            for m in e.spans(s):
                if total < cap:
                    spans.append(_span(m, o, False))
                total += 1
            return {"spans": spans, "total": total}

        return self._arrow(f"struct<spans:array<{SPAN}>,total:bigint>", kind, run, column(c))

    def find_iter(self, c: Column | str, chars: bool = False, start: Column | int = 0, limit: int | None = None) -> Column:
        """All spans, leftmost first. A limit refuses texts with more matches (the query fails) instead of cutting the answer."""
        spans = self._arrow(f"array<{SPAN}>", pa.list_(_PA_SPAN), lambda e, s, o, i: [_span(m, o, chars) for m in (e.each(s, o.inside(i) if chars else o.chars(i)) if i else e.spans(s))], column(c), _whole(start))
        return spans if limit is None else limited(spans, limit)

    def shortest_match(self, c: Column | str, start: Column | int = 0, end: Column | int | None = None) -> Column:
        """The byte offset at which a match is first established: the least end among the matches with the scan from the left."""
        if end is None:
            return self._arrow("bigint", pa.int64(), lambda e, s, o, i: None if (x := e.earliest(s, o.chars(i))) is None else o.bytes(x), column(c), _whole(start))
        return self._arrow("bigint", pa.int64(), lambda e, s, o, i, j: None if (x := e.earliest(s, o.chars(i), o.chars(j))) is None else o.bytes(x), column(c), _whole(start), _whole(end))

    def selected_end(self, c: Column | str) -> Column:
        """The end of the first match."""
        return self.find(c)["end"]

    # --- reducers -----------------------------------------------------------------------------------------------------------------

    def count(self, c: Column | str) -> Column:
        """Number of matches."""
        p, t = self.plan, self._text(c)
        if p.literal and not p.anchored_start and not p.anchored_end:
            gone = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(p.literal)))
            return F.floor(gone / len(p.literal.encode())).cast("bigint")
        if p.builtin:
            return F.regexp_count(t, F.lit(p.java)).cast("bigint")
        slow = lambda x: self._arrow("bigint", pa.int64(), lambda e, s, _: sum(1 for _ in e.spans(s)), x)
        if p.unsafe:
            return slow(column(c))
        # Java also gives the empty matches right after another match. With each match between two marks they show, and are taken off.
        # A text that holds a mark itself goes to the Arrow function.
        marked = F.regexp_replace(t, F.lit(p.java), F.lit(f"{_OPEN}$0{_SHUT}"))
        fewer = lambda x, part: F.length(x) - F.length(F.replace(x, F.lit(part)))
        fast = F.get(F.transform(F.array(marked), lambda x: fewer(x, _OPEN) - F.floor(fewer(x, _SHUT + _OPEN + _SHUT) / 3)), F.lit(0)).cast("bigint")
        own_marks = t.contains(_OPEN) | t.contains(_SHUT)
        return F.when(own_marks, slow(F.when(own_marks, column(c)))).otherwise(fast)

    def span_sum(self, c: Column | str) -> Column:
        """Matched bytes."""
        p, t = self.plan, self._text(c)
        if p.literal:
            return self.count(c) * len(p.literal if self._bytes else p.literal.encode())
        if p.covers and not self._bytes:
            return F.octet_length(t).cast("bigint")
        if not p.unsafe:  # empty matches add nothing, so it doesn't matter which of them Spark counts
            return self._size(F.array_join(F.regexp_extract_all(t, F.lit(p.java), F.lit(0)), ""))
        return self._arrow("bigint", pa.int64(), lambda e, s, o: sum(-o.bytes(a) + o.bytes(b) for a, b in e.spans(s)), column(c))

    def match_stats(self, c: Column | str) -> Column:
        """struct<count, span_sum> in one pass."""
        p, t = self.plan, self._text(c)
        if p.builtin:
            each = F.array(F.regexp_extract_all(t, F.lit(p.java), F.lit(0)))
            told = F.transform(each, lambda m: F.struct(F.size(m).cast("bigint").alias("count"), self._size(F.array_join(m, "")).alias("span_sum")))
            return F.when(t.isNotNull(), F.get(told, F.lit(0)))

        def stats(e, s, o):
            each = [(o.bytes(a), o.bytes(b)) for a, b in e.spans(s)]
            return {"count": len(each), "span_sum": sum(b - a for a, b in each)}

        return self._arrow("struct<count:bigint,span_sum:bigint>", pa.struct([("count", pa.int64()), ("span_sum", pa.int64())]), stats, column(c))

    def count_captures(self, c: Column | str) -> Column:
        """Groups that take part, summed over all matches, the whole match included."""
        n = self.static_captures_len()
        if n is not None:
            return self.count(c) * n
        return self._arrow("bigint", pa.int64(), lambda e, s, _: sum(sum(x is not None for x in m[::2]) for m in e.each(s)), column(c))

    # --- captures -----------------------------------------------------------------------------------------------------------------

    def captures(self, c: Column | str) -> Column:
        """The groups of the first match: array of spans, null where a group takes no part."""
        return self._arrow(f"array<{SPAN}>", pa.list_(_PA_SPAN), lambda e, s, o: _groups(e.at(s, 0), o), column(c))

    def captures_window(self, c: Column | str, start: Column | int, end: Column | int) -> Column:
        return self._arrow(f"array<{SPAN}>", pa.list_(_PA_SPAN), lambda e, s, o, i, j: _groups(e.window(s, o.chars(i), o.chars(j)), o), column(c), _whole(start), _whole(end))

    def captures_exact_window(self, c: Column | str, start: Column | int, end: Column | int) -> Column:
        """The groups of the match whose span (byte offsets) is known, such as one that find() gave: of the ways to match just that
        stretch, the first by priority. Null where the pattern doesn't match it."""

        def run(e, s, o, i, j):
            a, b = o.chars(i), o.chars(j)
            return _groups(e.exact(s, a, b), o) if a <= b else None

        return self._arrow(f"array<{SPAN}>", pa.list_(_PA_SPAN), run, column(c), _whole(start), _whole(end))

    def captures_iter(self, c: Column | str) -> Column:
        """The groups of all matches."""
        return self._arrow(f"array<array<{SPAN}>>", pa.list_(pa.list_(_PA_SPAN)), lambda e, s, o: [_groups(m, o) for m in e.each(s)], column(c))

    def captures_texts(self, c: Column | str) -> Column:
        """The texts of the groups of all matches, the whole match first; null where a group takes no part."""
        texts = lambda e, s, _: [[None if a is None else s[a:b] for a, b in zip(m[::2], m[1::2])] for m in e.each(s)]
        return self._arrow("array<array<string>>", pa.list_(pa.list_(pa.string())), texts, column(c))

    def captures_iter_window(self, c: Column | str, start: Column | int, end: Column | int) -> Column:
        return self._arrow(f"array<array<{SPAN}>>", pa.list_(pa.list_(_PA_SPAN)), lambda e, s, o, i, j: [_groups(m, o) for m in e.each(s, o.chars(i), o.chars(j))], column(c), _whole(start), _whole(end))

    def captures_struct(self, c: Column | str) -> Column:
        """The texts of the named groups of the first match, as a struct (null fields where a group takes no part; null without a match)."""
        names = [(n, k) for k, n in enumerate(self.plan.names) if n]
        if not names:
            raise PatternError("the pattern has no named groups")
        taken = mandatory(self.plan.root)
        if self.plan.builtin and not self._bytes and all(taken[k] for _, k in names):
            t = column(c)
            return F.when(self.is_match(t), F.struct(*[F.regexp_extract(t, self.plan.java_groups, k).alias(n) for n, k in names]))
        kind = pa.struct([(n, pa.string()) for n, _ in names])
        return self._arrow("struct<" + ",".join(f"`{n}`:string" for n, _ in names) + ">", kind, lambda e, s, _: None if (m := e.at(s, 0)) is None else {n: None if m[2 * k] is None else s[m[2 * k]:m[2 * k + 1]] for n, k in names}, column(c))

    def participation(self, c: Column | str) -> Column:
        """array<boolean>: which groups take part in the first match."""
        return F.transform(self.captures(c), lambda g: g.isNotNull())

    # --- replacing ----------------------------------------------------------------------------------------------------------------

    def replacen(self, c: Column | str, limit: int, replacement: str) -> Column:
        """The text with the first limit matches (0: all) replaced by a text that is taken as it is."""
        p, t = self.plan, self._text(c)
        new = replacement.encode().decode("latin-1") if self._bytes else replacement
        if limit == 0 and p.literal and not p.anchored_start and not p.anchored_end:
            return self._back(F.replace(t, F.lit(p.literal), F.lit(new)))
        if limit == 0 and p.builtin:
            return self._back(F.regexp_replace(t, F.lit(p.java), F.lit(quoted(new))))
        if limit == 1 and p.builtin:
            around = F.get(F.transform(F.array(self._around(t)), lambda a: F.when(F.size(a) > 1, F.concat(a[0], F.lit(new), a[1])).otherwise(t)), F.lit(0))
            return self._back(F.when(self.is_match_text(t), around).otherwise(t))
        return self._rewritten(c, limit, lambda s, m: new)

    def replace(self, c: Column | str, replacement: str) -> Column:
        return self.replacen(c, 1, replacement)

    def replace_all(self, c: Column | str, replacement: str) -> Column:
        return self.replacen(c, 0, replacement)

    def replace_with(self, c: Column | str, function: Callable[[str, tuple[int, int]], str], limit: int = 0) -> Column:
        """As replacen(), with function(text, (start, end) in characters) for each match."""
        return self._rewritten(c, limit, lambda s, m: function(s, (m[0], m[1])))

    def expand(self, c: Column | str, template: str, limit: int = 0) -> Column:
        """As replacen(), with a template: $1, $name, ${ref}, and $$ for a dollar. Groups that take no part or don't exist are empty."""
        parts = template_parts(template)
        names = {n: k for k, n in enumerate(self.plan.names) if n}
        refs = [(s, None) if ref is None else ("", int(ref) if ref.isdigit() else names.get(ref, -1)) for s, ref in parts]
        refs = [(s, k) for s, k in refs if k is None or 0 <= k < self.captures_len()]
        if limit == 0 and self.plan.builtin and not self._bytes:
            # Java takes as many digits as there are groups, so a digit that follows is quoted; groups that take no part are empty there too.
            java = "".join("".join("\\" + x if x.isdigit() else quoted(x) for x in s) if k is None else f"${k}" for s, k in refs)
            return F.regexp_replace(column(c), F.lit(self.plan.java_groups), F.lit(java))
        return self._rewritten(c, limit, lambda s, m: "".join(t if k is None else "" if m[2 * k] is None else s[m[2 * k]:m[2 * k + 1]] for t, k in refs))

    def _rewritten(self, c: Column | str, limit: int, new: Callable) -> Column:
        raw = self._bytes

        def run(e, s, _):
            out, at = [], 0
            for n, m in enumerate(e.each(s), 1):
                out += [s[at:m[0]], new(s, m)]
                at = m[1]
                if n == limit:
                    break
            done = "".join(out) + s[at:]
            return done.encode("latin-1") if raw else done

        return self._arrow("binary" if raw else "string", pa.binary() if raw else pa.string(), run, column(c))

    # --- splitting ----------------------------------------------------------------------------------------------------------------

    def split(self, c: Column | str) -> Column:
        """The fields around all matches, empty ones included."""
        if self.plan.builtin and not self._bytes:
            return F.split(column(c), self.plan.java, -1)
        return self._fields(c, None)

    def splitn(self, c: Column | str, limit: int) -> Column:
        """At most limit fields, the last holding the rest; none at all for 0."""
        if limit == 0:
            kind = "array<binary>" if self._bytes else "array<string>"
            return F.when(column(c).isNotNull(), F.array().cast(kind))
        if self.plan.builtin and not self._bytes:
            return F.split(column(c), self.plan.java, limit)
        return self._fields(c, limit)

    def _fields(self, c: Column | str, limit: int | None) -> Column:
        raw = self._bytes

        def run(e, s, _):
            out, at = [], 0
            if limit != 1:
                for m in e.each(s):
                    out.append(s[at:m[0]])
                    at = m[1]
                    if limit is not None and len(out) == limit - 1:
                        break
            out.append(s[at:])
            return [x.encode("latin-1") for x in out] if raw else out

        return self._arrow("array<binary>" if raw else "array<string>", pa.list_(pa.binary() if raw else pa.string()), run, column(c))

    def steps(self, c: Column | str) -> Column:
        """array<struct<kind, start, end>>: matches ("M") and what lies between them ("R"), in order, covering the text."""
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def run(e, s, o):
            out, at = [], 0
            for m in e.each(s):
                if m[0] > at:
                    out.append({"kind": "R", "start": o.bytes(at), "end": o.bytes(m[0])})
                out.append({"kind": "M", "start": o.bytes(m[0]), "end": o.bytes(m[1])})
                at = m[1]
            if at < len(s):
                out.append({"kind": "R", "start": o.bytes(at), "end": o.bytes(len(s))})
            return out

        return self._arrow("array<struct<kind:string,start:bigint,end:bigint>>", kind, run, column(c))

    # --- lines --------------------------------------------------------------------------------------------------------------------

    def grep(self, c: Column | str, mode: str = "lf") -> Column:
        """array<string>: the lines with a match."""
        return F.filter(lines(c, mode), self._line_test())

    def grep_count(self, c: Column | str, mode: str = "lf") -> Column:
        """Number of lines with a match. A text without what every match holds isn't split at all."""
        p = self.plan
        found = F.size(F.filter(lines(c, mode), self._line_test())).cast("bigint")
        if p.required and not p.unsafe:
            return F.when(column(c).contains(F.lit(p.required)), found).when(column(c).isNotNull(), F.lit(0).cast("bigint"))
        return found

    def grep_captures_count(self, c: Column | str, mode: str = "lf") -> Column:
        """Groups that take part, the whole match included, summed over all matches of each line."""
        n = self.static_captures_len()
        if n is not None and self.plan.builtin and not self._bytes:
            each = F.transform(lines(c, mode), lambda x: F.regexp_count(x, F.lit(self.plan.java)).cast("bigint"))
            return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x) * n
        if self._bytes:
            raise UnsupportedPattern("lines of bytes; decode them first")
        total = lambda e, rows, _: sum(sum(x is not None for x in m[::2]) for line in rows for m in e.each(line))
        return self._arrow("bigint", pa.int64(), total, lines(c, mode))

    def _line_test(self) -> Callable[[Column], Column]:
        if self._bytes:
            raise UnsupportedPattern("lines of bytes; decode them first")
        if self.plan.unsafe:
            raise UnsupportedPattern("this pattern needs the automaton; explode the lines and filter them by is_match")
        return self.is_match

    def __getstate__(self):
        return {"source": self.source, "options": self.options}

    def __setstate__(self, state):
        self.__init__(state["source"], **vars(state["options"]))


class Bytes:
    """Offsets of a text with one character for each byte."""

    def __init__(self, text: str):
        self.n = len(text)

    def bytes(self, char: int) -> int:
        return char

    def chars(self, byte: int) -> int:
        if not 0 <= byte <= self.n:
            raise OffsetError("offset outside the text")
        return byte

    inside = chars


def _whole(value: Column | int) -> Column:
    return F.lit(value).cast("bigint") if isinstance(value, int) else value.cast("bigint")


def _span(m, offsets, chars: bool):
    if m is None:
        return None
    return {"start": m[0], "end": m[1]} if chars else {"start": offsets.bytes(m[0]), "end": offsets.bytes(m[1])}


def _groups(m, offsets):
    return None if m is None else [None if a is None else {"start": offsets.bytes(a), "end": offsets.bytes(b)} for a, b in zip(m[::2], m[1::2])]


def limited(spans: Column, limit: int) -> Column:
    """The array, or a failure of the query where it has more than limit entries."""
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= limit, spans).otherwise(F.raise_error(F.lit(f"more than {limit} matches")))


def lines(c: Column | str, mode: str = "lf") -> Column:
    """A text's lines without their ends. lf: a line feed ends a line, and a carriage return right before it is dropped; crlf: so does a lone carriage
    return; otherwise the one character that ends lines. An empty text has no lines, and nothing follows a last line end."""
    t = column(c)
    if mode == "lf":
        parts = F.split(t, "\n", -1)
    elif mode == "crlf":
        parts = F.split(t, "\r\n|\r|\n", -1)
    elif len(mode) == 1:
        parts = F.split(t, _regex.escape(mode) if mode not in "\n" else "\n", -1)
    else:
        raise PatternError("mode must be lf, crlf or one character")
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    if mode != "lf":
        return whole
    ended = F.size(F.split(t, "\n", -1)) - 1
    # A last line without a line feed keeps its carriage return.
    return F.transform(whole, lambda x, i: F.when((i < ended) & x.endswith("\r"), F.left(x, F.length(x) - 1)).otherwise(x))


_TEMPLATE = _regex.compile(r"\$(?:(\$)|\{([^}]*)\}|([0-9A-Za-z_]+))")


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """(literal text, None) and ("", reference) in turn. An unbraced name is as long as letters, digits and underscores go on."""
    out, at = [], 0
    for m in _TEMPLATE.finditer(template):
        out.append((template[at:m.start()], None))
        out.append(("$", None) if m[1] else ("", m[2] if m[2] is not None else m[3]))
        at = m.end()
    return [*out, (template[at:], None)]

"""Many patterns over one text: which of them match (RegexSet), and one stream of matches in which earlier patterns win ties (OrderedMany)."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.engine import Engine, Offsets
from spanloom.functions.pattern import Bytes, LimitError, Options, Regex, column

MAX_PATTERNS = 4096
MAX_SOURCE = 16 << 20


def _checked(patterns: Sequence[str], max_patterns: int) -> list[str]:
    patterns = list(patterns)
    if len(patterns) > max_patterns:
        raise LimitError(f"{len(patterns)} patterns, beyond {max_patterns}")
    if sum(len(p.encode()) for p in patterns) > MAX_SOURCE:
        raise LimitError("the patterns are longer than 16 MiB together")
    return patterns


class RegexSet:
    """All patterns that match, without offsets. Patterns keep their places even if equal; an empty set is valid."""

    def __init__(self, patterns: Sequence[str], max_patterns: int = MAX_PATTERNS, **options):
        self.patterns = _checked(patterns, max_patterns)
        self.members = []
        for i, p in enumerate(self.patterns):
            try:
                self.members.append(Regex(p, **options))
            except ValueError as e:
                raise type(e)(f"pattern {i}: {e}") from None

    def __len__(self) -> int:
        return len(self.members)

    def is_match(self, c: Column | str) -> Column:
        found = F.lit(False)
        for r in self.members:
            found = found | r.is_match(c)
        return F.when(column(c).isNotNull(), found)

    def is_match_at(self, c: Column | str, start: Column | int) -> Column:
        return F.when(column(c).isNotNull(), F.size(self.matches_at(c, start)) > 0)

    def matches(self, c: Column | str) -> Column:
        """array<int>: places of the patterns that match, ascending."""
        each = [F.when(r.is_match(c), F.lit(i)) for i, r in enumerate(self.members)]
        return F.when(column(c).isNotNull(), F.array_compact(F.array(*each)) if each else F.array().cast("array<int>"))

    def matches_at(self, c: Column | str, start: Column | int) -> Column:
        at = [r.is_match_at(c, start) for r in self.members]
        # The members share the text and the offset, so all are null or none is.
        return F.when(at[0].isNotNull(), F.array_compact(F.array(*[F.when(x, F.lit(i)) for i, x in enumerate(at)]))) if at else F.when(column(c).isNotNull(), F.array().cast("array<int>"))

    def matches_added(self, flags: Column | str, c: Column | str) -> Column:
        """Places already found together with those that match."""
        return F.array_sort(F.array_union(column(flags), self.matches(c)))

    def flags(self, c: Column | str) -> Column:
        """array<boolean>, one for each pattern."""
        return F.when(column(c).isNotNull(), F.array(*[r.is_match(c) for r in self.members]) if self.members else F.array().cast("array<boolean>"))

    # What can be asked of matches()

    @staticmethod
    def matched_any(found: Column | str) -> Column:
        return F.size(column(found)) > 0

    def matched_all(self, found: Column | str) -> Column:
        return F.size(column(found)) == len(self)

    @staticmethod
    def matched(found: Column | str, place: int) -> Column:
        return F.array_contains(column(found), place)

    @staticmethod
    def matched_count(found: Column | str) -> Column:
        return F.size(column(found))


class OrderedMany:
    """One stream over several patterns: the earliest start wins, ties go to the earlier pattern, and each keeps its own end. ids are payload only."""

    def __init__(self, patterns: Sequence[str], ids: Sequence[int] | None = None, max_patterns: int = MAX_PATTERNS, **options):
        self.patterns = _checked(patterns, max_patterns)
        self.ids = list(range(len(self.patterns))) if ids is None else list(ids)
        if len(self.ids) != len(self.patterns):
            raise ValueError("as many ids as patterns are needed")
        self.members = [Regex(p, **options) for p in self.patterns]
        self.options = Options(**options)
        # The alternation of all, each in a group of its own, has the same priorities. Names would clash, so groups are counted.
        self.firsts, n = [], 1
        for r in self.members:
            self.firsts.append(n)
            n += r.captures_len()
        self.whole = Regex("|".join(f"({_unnamed(p)})" for p in self.patterns), **options) if self.patterns else None

    def _run(self, c: Column | str, result: str, kind: pa.DataType, function) -> Column:
        if self.whole is None:
            return F.when(column(c).isNotNull(), F.lit(0 if result == "bigint" else None).cast(result) if result == "bigint" else F.array().cast(result))
        source, options, firsts = self.whole.source, self.options, self.firsts

        def run(texts: pa.Array) -> pa.Array:
            e, out = Engine(source, options), []
            for x in texts.to_pylist():
                if x is None:
                    out.append(None)
                    continue
                text = x.decode("latin-1") if options.bytes_mode else x
                o = Bytes(text) if options.bytes_mode else Offsets(text)
                out.append(function(((next(i for i, g in enumerate(firsts) if m[2 * g] is not None), m) for m in e.each(text)), o))
            return pa.array(out, kind)

        return F.arrow_udf(run, result)(column(c))

    def spans(self, c: Column | str, cap: int | None = None) -> Column:
        """array<struct<pattern_id, ordinal, start, end>>; with a cap only so many of the first (total() tells how many there are)."""
        ids = self.ids
        kind = pa.list_(pa.struct([("pattern_id", pa.int64()), ("ordinal", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        spans = self._run(c, "array<struct<pattern_id:bigint,ordinal:int,start:bigint,end:bigint>>", kind, lambda each, o: [{"pattern_id": ids[i], "ordinal": i, "start": o.bytes(m[0]), "end": o.bytes(m[1])} for i, m in each])
        return spans if cap is None else F.slice(spans, 1, cap)

    def total(self, c: Column | str) -> Column:
        """How many spans there are, whatever the cap."""
        return self.count(c)

    def count(self, c: Column | str) -> Column:
        if self.whole is not None and self.whole.plan.builtin:
            return self.whole.count(c)
        return self._run(c, "bigint", pa.int64(), lambda each, _: sum(1 for _ in each))

    def span_sum(self, c: Column | str) -> Column:
        if self.whole is not None and self.whole.plan.builtin:
            return self.whole.span_sum(c)
        return self._run(c, "bigint", pa.int64(), lambda each, o: sum(o.bytes(m[1]) - o.bytes(m[0]) for _, m in each))

    def match_stats(self, c: Column | str) -> Column:
        """struct<count, span_sum>, in one pass where the patterns permit."""
        if self.whole is not None and self.whole.plan.builtin:
            return self.whole.match_stats(c)
        return F.when(column(c).isNotNull(), F.struct(self.count(c).alias("count"), self.span_sum(c).alias("span_sum")))

    def count_captures(self, c: Column | str) -> Column:
        """Groups that take part, over all matches: the whole match and the winner's own groups."""
        firsts, sizes = self.firsts, [r.captures_len() for r in self.members]
        return self._run(c, "bigint", pa.int64(), lambda each, _: sum(sum(m[2 * g] is not None for g in range(firsts[i], firsts[i] + sizes[i])) for i, m in each))


class LiteralSet:
    """Thousands of plain texts looked for in one pass by a trie with failure links (Aho-Corasick), built once in each worker. At most MAX_SOURCE bytes of them."""

    def __init__(self, texts: Sequence[str], max_texts: int = 1 << 20):
        self.texts = tuple(_checked(texts, max_texts))
        if "" in self.texts:
            raise LimitError("an empty text is found everywhere")

    def matches(self, c: Column | str) -> Column:
        """array<int>: places of the texts that occur, ascending; equal texts keep their places."""
        return self._run(c, "array<int>", pa.list_(pa.int32()), lambda trie, x: sorted({i for _, places in trie.iter(x) for i in places}))

    def is_match(self, c: Column | str) -> Column:
        return self._run(c, "boolean", pa.bool_(), lambda trie, x: next(iter(trie.iter(x)), None) is not None)

    def count(self, c: Column | str) -> Column:
        """All occurrences, overlapping ones and those of equal texts included."""
        return self._run(c, "bigint", pa.int64(), lambda trie, x: sum(len(places) for _, places in trie.iter(x)))

    def _run(self, c: Column | str, result: str, kind: pa.DataType, function) -> Column:
        texts = self.texts

        def run(values: pa.Array) -> pa.Array:
            trie = _trie(texts)
            return pa.array([None if x is None else function(trie, x) if trie else function(_Nothing, x) for x in values.to_pylist()], kind)

        return F.arrow_udf(run, result)(column(c))


class _Nothing:
    @staticmethod
    def iter(_):
        return iter(())


@functools.lru_cache(maxsize=4)
def _trie(texts: tuple[str, ...]):
    import ahocorasick

    places: dict[str, list[int]] = {}
    for i, x in enumerate(texts):
        places.setdefault(x, []).append(i)
    if not places:
        return None
    trie = ahocorasick.Automaton()
    for x, found in places.items():
        trie.add_word(x, tuple(found))
    trie.make_automaton()
    return trie


def _unnamed(pattern: str) -> str:
    """The pattern with its named groups made plain ones, which keep their numbers."""
    out, at, inside = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at:at + 2])
            at += 2
            continue
        if c == "[":
            inside += 1
        elif c == "]" and inside and not (out and out[-1] in ("[", "^") and pattern[at - 1] in "[^"):
            inside -= 1
        elif c == "(" and not inside and (pattern.startswith("(?P<", at) or pattern.startswith("(?<", at)):
            out.append("(")
            at = pattern.index(">", at) + 1
            continue
        out.append(c)
        at += 1
    return "".join(out)

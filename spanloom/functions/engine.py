"""What runs within Arrow functions: spans, captures and windows of one pattern over a batch of texts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import regex

from spanloom.plans.automaton import Scanner, machine, scanner
from spanloom.plans.syntax import Options
from spanloom.plans.translate import plan

Slots = list


@functools.lru_cache(maxsize=256)
class Engine:
    """A compiled pattern. The regex module runs what is safe on it, the automata the rest; answers are the same."""

    def __init__(self, source: str, options: Options):
        self.plan = plan(source, options)
        self.groups = self.plan.pattern.groups
        self.machine = machine(self.plan)
        self.compiled = None if self.plan.unsafe else regex.compile(self.plan.python)

    @property
    def scanner(self) -> Scanner:
        return scanner(self.plan)

    def at(self, text: str, start: int) -> Slots | None:
        """Slots (start and end of each group, None where it takes no part) of the first match from start on; assertions see the whole text."""
        if self.compiled is None:
            return self.scanner.search(text, start)
        m = self.compiled.search(text, start)
        if m is None:
            return None
        return [v for k in range(self.groups) for v in ((None, None) if m.start(k) < 0 else m.span(k))]

    def exact(self, text: str, start: int, end: int) -> Slots | None:
        """Slots of the first way by priority to match just text[start:end]; assertions see the whole text."""
        return machine(self.plan).search(text, start, end, whole=True)

    def window(self, text: str, start: int, end: int) -> Slots | None:
        """As at(), for a match within text[start:end]."""
        return self.at(text, start) if end >= len(text) else self.scanner.search(text, start, end)

    def earliest(self, text: str, start: int, end: int | None = None) -> int | None:
        """Where a match is first established, scanning from the left."""
        found = self.scanner.search(text, start, end, earliest=True)
        return None if found is None else found[1]

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Start and end of each match, as each() gives them."""
        if self.compiled is None:
            first = self.scanner.span
        else:
            search = self.compiled.search
            first = lambda text, at: None if (m := search(text, at)) is None else m.span()
        n, at, last = len(text), 0, -1
        while at <= n and (m := first(text, at)):
            if m[0] == m[1] == last:
                at = last + 1
                if at > n or not (m := first(text, at)):
                    return
            yield m
            at = last = m[1]

    def each(self, text: str, start: int = 0, end: int | None = None) -> Iterator[Slots]:
        """All matches in turn: none overlaps another, and none is empty right after another."""
        n = len(text) if end is None else min(end, len(text))
        at, last = start, -1
        while at <= n:
            m = self.window(text, at, n)
            if m is None:
                return
            if m[0] == m[1] == last:
                at = last + 1
                m = self.window(text, at, n) if at <= n else None
                if m is None:
                    return
            yield m
            at = last = m[1]


class OffsetError(ValueError):
    """An offset at which no character of the text starts or ends."""


class Offsets:
    """Character offsets of a text to UTF-8 byte offsets, and back. Where they differ, one array of all byte offsets is made when first asked for."""

    def __init__(self, text: str):
        self.text, self.plain = text, text.isascii()

    @functools.cached_property
    def table(self) -> np.ndarray:
        c = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros(len(c) + 1, np.int64)
        np.cumsum(1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000), out=out[1:])
        return out

    def bytes(self, char: int) -> int:
        return char if self.plain else int(self.table[char])

    def chars(self, byte: int) -> int:
        """OffsetError where the byte offset lies within a character, beyond the text or before it."""
        if self.plain:
            return self.inside(byte)
        at = int(np.searchsorted(self.table, byte))
        if byte < 0 or at == len(self.table) or self.table[at] != byte:
            raise OffsetError("offset outside the text or within a character")
        return at

    def inside(self, char: int) -> int:
        """OffsetError where the character offset lies beyond the text or before it."""
        if not 0 <= char <= len(self.text):
            raise OffsetError("offset outside the text")
        return char

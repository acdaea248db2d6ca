"""Spans of a regular expression in a text column, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.llm.common import let

#: Running sums over long arrays go by blocks of so many entries.
BLOCK = 256


def running_sums(values: Column) -> Column:
    """array<long> of the sums of all entries before each one; blockwise, so the work grows with the power 1.5 at most."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def summed(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda sums: let(F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b))), lambda starts: spread(v, starts)))

    def spread(v: Column, starts: Column) -> Column:
        block = lambda i: F.floor(i / BLOCK).cast("int")
        return F.transform(v, lambda _, i: F.get(starts, block(i)) + total(F.slice(v, block(i) * BLOCK + 1, (i % BLOCK).cast("int"))))

    return let(values, lambda v: F.when(F.size(v) > 0, summed(v)).otherwise(F.array().cast("array<bigint>")))


def found(text: Column, pattern: str, *groups: int) -> Column:
    """array<struct<start, end, match, g1, ...>> of the leftmost non-overlapping matches, in code points.

    The pattern must not match the empty string and its matches must not depend on where a search began. The gaps
    between matches give their places; each pass runs the same matcher over the whole text.
    """
    all_of = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    kind = "struct<start:bigint,end:bigint,match:string" + "".join(f",g{g}:string" for g in groups) + ">"

    def placed(matches: Column, gaps: Column, before: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(gaps, i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"))

        return F.transform(matches, span)

    def all_spans(matches: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.transform(matches, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("long"))
            return let(running_sums(steps), lambda before: placed(matches, gaps, before))

        return let(F.split(text, pattern, -1), with_gaps)

    def adding(name: str):
        return lambda x, y: x.withField(name, y)

    spans = let(all_of(0), lambda m: F.when(F.size(m) > 0, all_spans(m)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,match:string>>")))
    for g in groups:
        spans = F.zip_with(spans, all_of(g), adding(f"g{g}"))
    return spans.cast(f"array<{kind}>")

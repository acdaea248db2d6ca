"""DataFrame operators over patterns: matches and lines as rows, grep, reducers by group, and documents joined with tables of patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.pattern import LimitError, PatternError, Regex, lines
from spanloom.functions.sets import MAX_SOURCE, LiteralSet, RegexSet

#: A pattern table is compared with every document, so it must be small; larger ones are refused.
MAX_PATTERN_ROWS = 4096
MAX_LITERAL_ROWS = 1 << 18
REDUCERS = ("search", "count", "span_sum", "grep_count", "count_captures")


def regex(pattern: Regex | str) -> Regex:
    return pattern if isinstance(pattern, Regex) else Regex(pattern)


def filter_matches(df: DataFrame, c: str, pattern: Regex | str) -> DataFrame:
    """The rows whose text has a match; literals of the pattern are pushed down to the reader."""
    return df.where(regex(pattern).is_match(c))


def explode_matches(df: DataFrame, c: str, pattern: Regex | str, chars: bool = False) -> DataFrame:
    """One row for each match: the columns of df but the text, with match_no, start, end and match_text."""
    r = regex(pattern)
    keep = [x for x in df.columns if x not in (c, "match_no", "start", "end", "match_text")]
    if r.options.bytes_mode:
        return df.select(*keep, F.posexplode(r.find_iter(c)).alias("match_no", "s")).select(*keep, "match_no", "s.start", "s.end")
    return df.select(*keep, F.posexplode(r.find_texts(c, chars)).alias("match_no", "s")).select(*keep, "match_no", "s.start", "s.end", F.col("s.text").alias("match_text"))


def explode_texts(df: DataFrame, c: str, pattern: Regex | str) -> DataFrame:
    """One row for each match's text, by Spark's own functions; only for patterns that never match the empty text."""
    r = regex(pattern)
    if not r.plan.builtin or r.options.bytes_mode:
        raise PatternError("this pattern needs explode_matches")
    keep = [x for x in df.columns if x not in (c, "match_no", "match_text")]
    return df.select(*keep, F.posexplode(F.regexp_extract_all(F.col(c), F.lit(r.plan.java), F.lit(0))).alias("match_no", "match_text"))


def explode_lines(df: DataFrame, c: str, mode: str = "lf") -> DataFrame:
    """One row for each line: the columns of df but the text, with line_no (from 1) and line."""
    keep = [x for x in df.columns if x not in (c, "line_no", "line")]
    return df.select(*keep, F.posexplode(lines(c, mode)).alias("_p", "line")).select(*keep, (F.col("_p") + 1).cast("bigint").alias("line_no"), "line")


def grep(df: DataFrame, c: str, pattern: str, ignore_case: bool = False, word: bool = False, invert: bool = False, mode: str = "lf") -> DataFrame:
    """The lines that match (or, inverted, don't), with their numbers. Texts without a match are dropped before their lines are split."""
    source = rf"\b(?:{pattern})\b" if word else pattern
    r = Regex(source, case_insensitive=ignore_case)
    whole = df
    # A match within a line is one within its text, unless an assertion takes a line's ends for the text's.
    inner = Regex(pattern, case_insensitive=ignore_case)
    if not invert and not inner.plan.unsafe and not inner.plan.contextual:
        whole = df.where(inner.is_match(c))
    test = r.is_match("line")
    return explode_lines(whole, c, mode).where(~test if invert else test)


def grep_captures(df: DataFrame, c: str, pattern: Regex | str, mode: str = "lf") -> DataFrame:
    """For each matching line its named groups as columns: line_no, then one column for each name."""
    r = regex(pattern)
    rows = explode_lines(df, c, mode).where(r.is_match("line"))
    names = [n for n in r.capture_names() if n]
    keep = [x for x in rows.columns if x not in ("line", *names)]
    return rows.withColumn("_c", r.captures_struct("line")).select(*keep, *[F.col(f"_c.{n}").alias(n) for n in names])


def grep_all_captures(df: DataFrame, c: str, pattern: Regex | str, mode: str = "lf") -> DataFrame:
    """For each match of each line: line_no, match_no (from 0 within the line) and groups, an array of the groups' texts, null where one takes no part."""
    r = regex(pattern)
    rows = explode_lines(df, c, mode)
    if not r.plan.unsafe:
        rows = rows.where(r.is_match("line"))
    keep = [x for x in rows.columns if x not in ("line", "match_no", "groups")]
    return rows.select(*keep, F.posexplode(r.captures_texts("line")).alias("match_no", "groups"))


def reduce_by(df: DataFrame, keys: Sequence[str], c: str, pattern: Regex | str) -> DataFrame:
    """For each group: docs, matching_docs, matches and matched_bytes. One pass over each text, then a pre-aggregated sum."""
    stats = df.select(*keys, regex(pattern).match_stats(c).alias("s"))
    return stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("docs"),
        F.coalesce(F.sum((F.col("s.count") > 0).cast("bigint")), F.lit(0)).alias("matching_docs"),
        F.coalesce(F.sum("s.count"), F.lit(0)).alias("matches"),
        F.coalesce(F.sum("s.span_sum"), F.lit(0)).alias("matched_bytes"),
    )


def operations(df: DataFrame, c: str, members: Mapping[str, tuple[str, Regex | str]]) -> DataFrame:
    """Several reducers over one scan: members are name: (reducer, pattern), each a column of the result."""
    out: list[Column] = []
    for name, (what, pattern) in members.items():
        if what not in REDUCERS:
            raise PatternError(f"unknown reducer {what!r}")
        r = regex(pattern)
        out.append((r.is_match(c) if what == "search" else getattr(r, what)(c)).alias(name))
    return df.select("*", *out)


def pattern_counts(df: DataFrame, c: str, patterns: Sequence[str], keys: Sequence[str] = (), **options) -> DataFrame:
    """(keys, pattern_id, matches, matching_docs): all patterns in one pass over the texts, partial sums before the shuffle."""
    members = RegexSet(patterns, **options).members
    counted = df.select(*keys, *[r.count(c).alias(f"_{i}") for i, r in enumerate(members)])
    sums = counted.groupBy(*keys).agg(*[F.struct(F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias("m"), F.coalesce(F.sum((F.col(f"_{i}") > 0).cast("bigint")), F.lit(0)).alias("d")).alias(f"_{i}") for i in range(len(members))])
    each = F.posexplode(F.array(*[F.col(f"_{i}") for i in range(len(members))])).alias("pattern_id", "x")
    return sums.select(*keys, each).select(*keys, "pattern_id", F.col("x.m").alias("matches"), F.col("x.d").alias("matching_docs"))


def _rows(table: DataFrame, column: str) -> list:
    """The table's rows, of which the driver holds MAX_PATTERN_ROWS at most."""
    rows = table.limit(MAX_PATTERN_ROWS + 1).collect()
    if len(rows) > MAX_PATTERN_ROWS:
        raise PatternError(f"more than {MAX_PATTERN_ROWS} patterns")
    for row in rows:
        if row[column] is not None and Regex(row[column]).plan.unsafe:
            raise PatternError(f"{row[column]!r} needs the automaton, which joins can't run")
    return rows


def join_patterns(df: DataFrame, c: str, patterns: DataFrame, column: str = "pattern", how: str = "inner") -> DataFrame:
    """Documents with the rows of a pattern table that match them: inner, leftsemi (any matches) or leftanti (none does).

    The table has at most MAX_PATTERN_ROWS rows. Each distinct pattern is one test in the scan of the documents, with its literals first, so a pattern
    is compiled once and no document is compared row by row; the documents aren't shuffled. The rows of the table come back by their number,
    from a broadcast of that size.
    """
    rows = _rows(patterns, column)
    members = {row[column]: Regex(row[column]) for row in rows if row[column] is not None}
    number = {p: i for i, p in enumerate(members)}
    if how in ("leftsemi", "leftanti"):
        found = F.lit(False)
        for r in members.values():
            found = found | F.coalesce(r.is_match(c), F.lit(False))
        return df.where(found if how == "leftsemi" else ~found)
    if how != "inner":
        raise PatternError("how must be inner, leftsemi or leftanti")
    return _with_rows(df, F.array_compact(F.array(*[F.when(r.is_match(c), F.lit(number[p])) for p, r in members.items()])) if members else F.array().cast("array<int>"), patterns, rows, [number.get(row[column]) for row in rows])


def _with_rows(df: DataFrame, found: Column, table: DataFrame, rows: list, numbers: list) -> DataFrame:
    """df with the rows of the table (at hand, with a number each) whose numbers are in the array found."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    numbered = table.sparkSession.createDataFrame([(*row, n) for row, n in zip(rows, numbers)], f"{kind}, _number int")
    name, taken = "_found", {x.lower() for x in (*df.columns, *table.columns, "_number")}
    while name in taken:
        name = "_" + name
    each = df.withColumn(name, F.explode(found))
    return each.join(F.broadcast(numbered), each[name] == numbered["_number"]).drop(each[name], numbered["_number"])


def join_literals(df: DataFrame, c: str, texts: DataFrame, column: str = "text") -> DataFrame:
    """Documents with the rows of a table whose text (of column) they contain, all texts in one pass over each document.

    The table has at most MAX_LITERAL_ROWS rows and 16 MiB of text, both checked before it comes to the driver. Null and empty texts join nothing.
    """
    some = texts.where(F.length(column) > 0)
    n, size = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    if n > MAX_LITERAL_ROWS or size > MAX_SOURCE:
        raise LimitError(f"{n} texts of {size} bytes, beyond {MAX_LITERAL_ROWS} or {MAX_SOURCE}")
    rows = some.collect()
    return _with_rows(df, LiteralSet([row[column] for row in rows]).matches(c), some, rows, list(range(len(rows))))


def regex_redux(df: DataFrame, c: str, variants: Sequence[str], substitutions: Sequence[tuple[str, str]], clean: str = r">.*\n|\n") -> DataFrame:
    """The composite task: length of the text, of the cleaned text, each variant's count in it, and its length after all substitutions."""
    cleaned = Regex(clean).replace_all(c, "")
    done = F.col("_clean")
    for pattern, text in substitutions:
        done = Regex(pattern).replace_all(done, text)
    rows = df.withColumn("_clean", cleaned)
    out = rows.select("*", F.octet_length(c).cast("bigint").alias("original_bytes"), F.octet_length("_clean").cast("bigint").alias("clean_bytes"), *[Regex(v).count("_clean").alias(f"variant_{i}") for i, v in enumerate(variants)], F.octet_length(done).cast("bigint").alias("final_bytes"))
    return out.drop("_clean")


def top_matches(df: DataFrame, c: str, pattern: Regex | str, k: int) -> DataFrame:
    """The k most frequent match texts: (match_text, n)."""
    return explode_texts(df.select(c), c, pattern).groupBy("match_text").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "match_text").limit(k)

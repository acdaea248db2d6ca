"""Secret scans: keyword, access-key and hex rules, and sliding-window entropy (DataFrame functions only).

Besides the three rules, any long unbroken string (base-64 like characters) is a candidate, and so is any long run of hexadecimal
digits, also within such a string. What an allow-list or a rule covers is blanked out of a candidate: spans of the rules, UUIDs and placeholders.
The pieces left that are as long as a window are judged, unless they have no digit or no letter. The character class of a piece fixes window and
threshold. A window slides over the piece with the counts of its characters (twelve 5-bit counts in each of seven numbers) and the sum of c log c over
them; a step changes two counts and the sum by them alone, so the Shannon entropy of each window follows at once. The span from the
first to the last window that reaches the threshold is reported with kind "entropy".

Null and empty texts have no spans; positions are in code points, ends exclusive. Spans that begin at one place come in the order of KINDS. Equal rows give
equal spans, empty tables an empty result. Very long texts are scanned whole. Extra columns are kept, whatever their names; a column that
has the name of an output is replaced. Each document is worked off within its row: nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, let, or_empty
from spanloom.llm.spans import found

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What each long enough match of ASSIGN holds; it is cheaper to look for.
ASSIGNED = r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: For HEX with its least length; runs are maximal either way, and the short ones needn't be built.
LONG_HEX = r"[0-9a-f]{16,}"
#: Maximal runs of 24 characters or more. The look-behind keeps the matcher from trying each place within a shorter one.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"
#: Maximal runs of hexadecimal digits as long as their window, wherever they stand.
HEX_RUN = r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Window and least bits for each class of characters.
CLASSES = {"hex": (20, 3.0), "base64": (24, 3.9)}
#: The allow-list: what matches it is no part of a secret. Each has the length that it is blanked out with.
UUID = r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])"
PLACEHOLDERS = ("example", "sample", "placeholder", "changeme", "abcdefghij", "0123456789", "xxxxxx")
ALLOWED = ((UUID, 36), *((f"(?i){x}", len(x)) for x in PLACEHOLDERS))
#: Pieces of one character class: no digit, or no letter.
ONE_CLASS = "^[^0-9]*$|^[^A-Za-z]*$"

#: Characters of candidates lie from "+" (43) to "z" (122). A count has BITS bits, so FIELDS of them fit into one number, and WORDS numbers hold all.
FIRST, BITS, FIELDS, WORDS = 43, 5, 12, 7


def _c_log_c(window: int) -> Column:
    return F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])


def _field(code: Column) -> Column:
    """The value of one in the count of a character (its code less FIRST) within its number."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (code % FIELDS) * BITS)


def _number(code: Column) -> Column:
    return F.floor(code / FIELDS).cast("int")


def _count(counts: Column, code: Column) -> Column:
    return F.call_function("shiftright", F.get(counts, _number(code)), (code % FIELDS) * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def entropy_span(piece: Column, window: int, least: float) -> Column:
    """struct<first, last> of the offsets of the first and the last window that has at least so many bits; nulls if none has."""
    f = _c_log_c(window)
    # bits = log2(window) - sum / window, so the sum may be at most this
    most = window * (math.log2(window) - least) + 1e-9
    none = F.lit(None).cast("int")

    def state(s: Column, counts: Column, i: Column, first: Column, last: Column = none) -> Column:
        hit = F.when(s <= most, i)
        return F.struct(s.alias("s"), counts.alias("counts"), F.coalesce(first, hit).cast("int").alias("first"), F.coalesce(hit, last).cast("int").alias("last"))

    def slid(codes: Column) -> Column:
        head = F.slice(codes, 1, window)
        no_counts = F.array(*[F.lit(0).cast("bigint")] * WORDS)
        counted = F.aggregate(head, no_counts, lambda counts, c: F.transform(counts, lambda n, k: n + F.when(_number(c) == k, _field(c)).otherwise(0)))
        start = let(counted, lambda counts: state(F.aggregate(F.array_distinct(head), F.lit(0.0), lambda a, c: a + F.get(f, _count(counts, c))), counts, F.lit(0), none))

        def step(was: Column, i: Column) -> Column:
            """i: the offset of the window that comes; the character at i - 1 leaves, that at i + window - 1 is new."""
            gone, new = F.get(codes, i - 1), F.get(codes, i + window - 1)
            out, come = _count(was["counts"], gone), _count(was["counts"], new)
            s = was["s"] + F.get(f, out - 1) - F.get(f, out) + F.get(f, come + 1) - F.get(f, come)
            counts = F.transform(was["counts"], lambda n, k: n - F.when(_number(gone) == k, _field(gone)).otherwise(0) + F.when(_number(new) == k, _field(new)).otherwise(0))
            moved = gone != new
            return let(F.when(moved, s).otherwise(was["s"]), lambda x: state(x, F.when(moved, counts).otherwise(was["counts"]), i, was["first"], was["last"]))

        n = F.size(codes)
        offsets = F.when(n > window, F.sequence(F.lit(1), n - window)).otherwise(F.array().cast("array<int>"))
        return F.when(n >= window, F.aggregate(offsets, start, step))

    return let(F.transform(F.split(piece, ""), lambda c: F.ascii(c) - FIRST), slid)


def blanked(candidate: Column, base: Column) -> Column:
    """A candidate's text with spaces for what the rules have reported (spans of base) or the allow-list names."""
    near = F.filter(base, lambda b: (b["start"] < candidate["end"]) & (candidate["start"] < b["end"]))

    def cut(text: Column, b: Column) -> Column:
        start = F.greatest(b["start"] - candidate["start"], F.lit(0)).cast("int")
        end = F.least(b["end"] - candidate["start"], F.length(text)).cast("int")
        return F.concat(F.substring(text, F.lit(1), start), F.repeat(F.lit(" "), end - start), F.substring(text, end + 1, F.length(text)))

    text = F.aggregate(near, candidate["match"], cut)
    for pattern, length in ALLOWED:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(" " * length))
    return text


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with secrets: array<struct<start, end, kind, rank>> in order of start, then kind."""
    t = or_empty(text)
    span = lambda kind: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,rank:int,kind:string>>")
    # The cheap tests spare the passes of most documents.
    assign = F.when(t.rlike(ASSIGNED) & t.rlike(ASSIGN), F.transform(F.filter(found(t, ASSIGN, 2), lambda x: F.length(x["g2"]) >= 12), span("assign"))).otherwise(empty)
    access = F.when(t.contains("AKIA"), F.transform(F.filter(found(t, ACCESS), lambda x: F.length(x["match"]) >= 18), span("access"))).otherwise(empty)
    hexes = F.when(t.rlike(LONG_HEX), F.transform(found(t, LONG_HEX), span("hex"))).otherwise(empty)
    b, r, n = fresh(df, "_base", "_runs", "_long")
    base = df.drop("secrets").withColumn(b, F.concat(assign, access, hexes))
    rank = F.lit(KINDS.index("entropy"))

    def entropy(pattern: str, kind: str) -> Column:
        window, least = CLASSES[kind]

        def judged(piece: Column, offset: Column) -> Column:
            bounds = lambda hit: F.struct((offset + piece["start"] + hit["first"]).alias("start"), (offset + piece["start"] + hit["last"] + window).alias("end"), rank.alias("rank"), F.lit("entropy").alias("kind"))
            return let(entropy_span(piece["match"], window, least), bounds)

        def fit(piece: Column) -> Column:
            other = piece["match"].rlike("^[0-9A-Fa-f]+$") if kind == "base64" else F.lit(False)  # judged as a hexadecimal run
            return ~piece["match"].rlike(ONE_CLASS) & ~other

        def one(candidate: Column) -> Column:
            pieces = F.filter(found(blanked(candidate, F.col(b)), pattern), fit)
            return F.filter(F.transform(pieces, lambda piece: judged(piece, candidate["start"])), lambda x: x["start"].isNotNull())

        return F.when(t.rlike(pattern), F.flatten(F.transform(found(t, pattern), one))).otherwise(empty)

    both = base.withColumns({r: entropy(HEX_RUN, "hex"), n: entropy(CANDIDATE, "base64")})
    # A run within what its candidate shows is no finding of its own.
    runs = F.filter(F.col(r), lambda x: ~F.exists(F.col(n), lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])))
    return both.withColumn("secrets", F.array_sort(F.concat(F.col(b), runs, F.col(n)))).drop(b, r, n)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Document fingerprints: bottom-k sketches of shingle hashes (DataFrame functions only).

A sketch is the k smallest distinct shingle hashes in ascending order. The hashes are 48 bits of xxHash64 over the hashes of five successive
lower-cased words; a text of fewer words is one shingle, and one without words has none. Two sketches merge by the k smallest of both, so a text's
parts (cut with an overlap of four words) can be sketched apart. Null texts are empty. Equal texts have equal sketches. Very long texts are
sketched whole.

next_rows() pairs each document with the next one by id without a global sort. The ids' quantiles (one pre-aggregated sketch, BUCKETS values at
most on the driver) part the rows into buckets of even numbers of rows, however the ids are spread; an id that holds many rows, null
included, is parted again by a hash of the text. Each bucket is ordered by itself, and only the buckets' first rows' ids (one row each) are ordered in one task.
An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, let

K, WORDS = 128, 5
SPACE = float(1 << 48)
#: Buckets at most, and rows that one should hold.
BUCKETS, BUCKET_ROWS = 20_000, 64


def mins(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k smallest distinct shingle hashes of a text, ascending."""
    hashed = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x))
    cut = lambda h: F.shiftrightunsigned(h, 16)

    def shingles(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (words - 1), F.lit(0)))
        windows = F.transform(starts, lambda h, i: cut(F.xxhash64(h, *[F.get(w, i + j) for j in range(1, words)])))
        whole = F.array(cut(F.xxhash64(F.array_join(w.cast("array<string>"), " "))))
        return F.when(F.size(w) >= words, windows).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(let(hashed, shingles))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(m: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(m) < k, F.size(m).cast("double")).otherwise((k - 1) * SPACE / F.element_at(m, -1))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the k smallest of both that lie in both; exact if both are whole. Two empty sets are alike."""
    shared = lambda both: F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both)
    return let(merged(a, b, k), lambda both: F.when(F.size(both) == 0, 1.0).otherwise(shared(both)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from the resemblance and the counts; an empty set lies in any."""
    j, n, m = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (n + m) / (1 + j) / n))


def shown(m: Column, k: int = K) -> Column:
    """A sketch as text: 'count of hashes:hashes in hexadecimal'."""
    return F.concat(F.size(m).cast("string"), F.lit(":"), F.array_join(F.transform(m, lambda h: F.lpad(F.hex(h), 12, "0")), ","))


def _bucket(key: Column, h: Column, bounds: list[int], null_buckets: int) -> Column:
    """The bucket of a row: as many bounds as lie below its key; rows of a key that m bounds equal are spread over m buckets by their hash h, and rows
    without a key over null_buckets before all others. Buckets are in the order of (key, null first, h)."""
    # The bounds in groups, so that about twice the square root of their number are compared with each key.
    size = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i:i + size] for i in range(0, len(bounds), size)]
    long_array = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values]) if values else F.array().cast("array<bigint>")
    lasts, all_groups = long_array([g[-1] for g in groups]), F.array(*map(long_array, groups)) if groups else F.array().cast("array<array<bigint>>")

    def below(test) -> Column:
        """How many bounds pass a test that holds for the lower ones."""
        whole = F.size(F.filter(lasts, test))
        return let(whole, lambda g: g * size + F.coalesce(F.size(F.filter(F.get(all_groups, g), test)), F.lit(0)))

    # -2**63 / 2**64 = -0.5, and the greatest hash rounds up to 0.5
    part = lambda m: F.least(F.floor((h.cast("double") / float(1 << 64) + 0.5) * m).cast("int"), m - 1)
    lower, upper = below(lambda x: x < key), below(lambda x: x <= key)
    spread = let(F.struct(lower.alias("lo"), upper.alias("hi")), lambda x: x["lo"] + part(F.greatest(x["hi"] - x["lo"], F.lit(1))))
    return F.when(key.isNull(), part(F.lit(null_buckets)) - null_buckets).otherwise(spread).cast("int")


def next_rows(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """df (key, text) with mins, next_text and next_mins: the row's sketch, and the text and the sketch of the row that follows.

    Rows are ordered by key (null first), those of one key by a hash of the text and then by the text; the first follows the last. A row goes
    to its bucket in the one shuffle that texts take, and a copy of each bucket's first row (BUCKETS and as many again for null keys at most) to the end
    of the bucket before.
    """
    numbers = df.select(F.col(key).cast("long").alias("key"))
    rows, nulls = numbers.agg(F.count(F.lit(1)), F.count_if(F.col("key").isNull())).first()
    n = min(BUCKETS, (rows - nulls) // BUCKET_ROWS)
    bounds = numbers.agg(F.percentile_approx("key", [i / (n + 1) for i in range(1, n + 1)], 20 * max(n, 500)).alias("q")).first()["q"] if n else []
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    put = df.select(key, text).withColumn("_h", h)
    put = put.withColumn("_b", _bucket(F.col(key).cast("long"), F.col("_h"), bounds, max(1, min(BUCKETS, nulls // BUCKET_ROWS))))
    firsts = put.groupBy("_b").agg(F.min(F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("key"), "_h")).alias("f"))
    order = Window.orderBy(F.col("_b").desc())
    before = Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = firsts.select(F.col("f.key").alias("_first"), F.col("f._h").alias("_first_h"), F.coalesce(F.lead("_b").over(order), F.last("_b").over(before)).alias("_to"))
    found = put.join(F.broadcast(ring), put[key].eqNullSafe(ring["_first"]) & (put["_h"] == ring["_first_h"])).groupBy("_to", "_h").agg(F.min(F.coalesce(text, F.lit(""))).alias(text))
    ends = found.select(F.lit(None).cast(df.schema[key].dataType).alias(key), text, "_h", F.col("_to").alias("_b"), F.lit(1).alias("_end"))
    rows_ = put.withColumn("_end", F.lit(0)).unionByName(ends).repartition("_b").withColumn("mins", mins(F.col(text), k))
    inner = Window.partitionBy("_b").orderBy("_end", F.col(key).asc_nulls_first(), "_h", text)
    led = rows_.withColumns({"next_text": F.lead(text).over(inner), "next_mins": F.lead("mins").over(inner)})
    return led.where("_end = 0").drop("_b", "_h", "_end")

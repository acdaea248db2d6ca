"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each source gets a share of all words by its weight; no source more than ``max_repeat`` times its own words, and what
it can't use is shared out again by weight. A source whose target is r times its size takes every document floor(r)
times and some of them once more: those whose hash lies below the source's threshold. The thresholds come from
nested histograms and no document is sorted: words are summed by source and the first BITS bits of the hash; the
bucket in which the running sum passes what is needed is the boundary; only its documents are summed by the next bits,
LEVELS times. The last boundary bucket (one document in 2**36, as a rule) is taken if that brings the sum nearer.

Documents' rows never move: histograms are pre-aggregated, one source may hold any share of the rows, and only the table
of sources (one row each) is joined back; it is broadcast if it has at most BROADCAST_SOURCES rows.

Nulls: a null source is a source of its own, last in order; a null text has no words. A document of no words is taken
as its hash says. Rows with the same key have the same hash and are taken together; where the key is null, the text's
hash stands in. Empty tables give empty results. Columns of the input are kept; those with the name of an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, fresh, materialise, without

LEVELS, BITS = 3, 12
BROADCAST_SOURCES = 100_000
OUTPUTS = ("size", "source_size", "target", "copies")


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: str, text: str) -> Column:
    """36 bits of the MD5 of the key's decimal digits."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.md5(F.col(text)), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, LEVELS * BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) with one row for each source.

    The sources are ordered by code point, nulls last, to deal out the weights. Those whose cap is small for their
    weight are capped; sorted by cap / weight they are a prefix, so running sums give the level at which the rest is shared.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1) % len(weights)
    dealt = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (number + 1).cast("int")).cast("long"))
    dealt = dealt.withColumn("cap", F.col("source_size") * max_repeat).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    rank = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = dealt.select(
        "*",
        F.row_number().over(rank).alias("position"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
    )
    free = F.min(F.when(F.col("ratio") > F.col("left").cast("double") / F.col("w_left"), F.struct("position", "left", "w_left"))).over(everything)
    return ranked.withColumn("free", free).select(
        "source",
        "source_size",
        F.when(F.col("free").isNull() | (F.col("position") < F.col("free.position")), F.col("cap").cast("double"))
        .otherwise((F.col("w") * F.col("free.left")).cast("double") / F.col("free.w_left"))
        .alias("target"),
    )


def thresholds(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(source, source_size, target, base, threshold) for rows (source, size, h); rows should be stored, they are read LEVELS + 1 times."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialise(
        targets(sources, weights, max_repeat)
        .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("needed", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("threshold", F.lit(0).cast("long")),
        "mix-plan",
    )
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * BITS
        inside = rows if level == 0 else attach(rows, plan.select("source", "threshold")).where(F.shiftright("h", shift + BITS) == F.col("threshold"))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n")).where("n > 0")
        running = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        met = attach(running, plan.select("source", "needed")).where("upto > needed")
        boundary = met.groupBy("source").agg(F.min(F.struct("bucket", "upto", "n")).alias("b")).withColumnRenamed("source", "s")
        plan = plan.join(boundary, plan["source"].eqNullSafe(boundary["s"]), "left").drop("s")
        last = level == LEVELS - 1
        nearer = (F.col("b.upto") - F.col("needed")) < (F.col("needed") - (F.col("b.upto") - F.col("b.n")))
        edge = F.col("b.bucket") + F.when(nearer, 1).otherwise(0) if last else F.col("b.bucket")
        plan = plan.withColumn("threshold", F.coalesce(edge, F.lit(0))).withColumn("needed", F.coalesce(F.col("needed") - (F.col("b.upto") - F.col("b.n")), F.lit(0.0))).drop("b")
        plan = materialise(plan, f"mix-level{level}")
    return plan.select("source", "source_size", "target", "base", "threshold")


def attach(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """rows with the columns of their source's row. Broadcast up to a checked number of sources; beyond it Spark joins (and splits hot sources) itself."""
    right = per_source.withColumnRenamed("source", "_source")
    if right.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return rows.join(right, rows["source"].eqNullSafe(right["_source"])).drop("_source")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """df with size, source_size, target (words of the source's share) and copies (how often the mix takes the row, 0 to max_repeat)."""
    df = without(df, *[c for c in OUTPUTS if c not in (key, text, source)])
    plan = thresholds(_narrow(df, key, text, source), weights, max_repeat)
    h, s = fresh(df, "_h", "_s")
    return _copies(df.withColumns({"size": size_of(text), h: hash_of(key, text), s: F.col(source)}), plan, h, s)


def _narrow(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return materialise(df.select(F.col(source).alias("source"), size_of(text).alias("size"), hash_of(key, text).alias("h")), "mix-sizes")


def _copies(df: DataFrame, plan: DataFrame, h: str, s: str) -> DataFrame:
    """df with source_size, target and copies, without its columns h (hash) and s (source)."""
    p, base, threshold = fresh(df, "_p", "_base", "_threshold")
    right = plan.select(F.col("source").alias(p), "source_size", "target", F.col("base").alias(base), F.col("threshold").alias(threshold))
    if right.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    joined = df.join(right, F.col(s).eqNullSafe(F.col(p)))
    return joined.withColumn("copies", F.col(base) + F.when(F.col(h) < F.col(threshold), 1).otherwise(0)).drop(s, p, h, base, threshold)


def mix_keys(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """As mix(), but only the key and the outputs; the texts are read once."""
    rows = materialise(df.select(F.col(key), F.col(source).alias("source"), size_of(text).alias("size"), hash_of(key, text).alias("h")), "mix-sizes")
    plan = thresholds(rows, weights, max_repeat)
    return _copies(rows.withColumn("_s", F.col("source")), plan, "h", "_s")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say, without the outputs of mix()."""
    (copy,) = fresh(mixed, "_copy")
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(copy, *OUTPUTS)


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '')), 1, 9))::BIGINT AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), dealt AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM sources
), ranked AS (
  SELECT *, row_number() OVER o AS position, cap::DOUBLE / w AS ratio,
         sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest
  FROM dealt WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)
), free AS (
  SELECT position AS f, rest AS f_rest, w_rest AS f_w FROM ranked WHERE ratio > rest::DOUBLE / w_rest ORDER BY position LIMIT 1
), plan AS (
  SELECT source, source_size,
         CASE WHEN f IS NULL OR position < f THEN cap::DOUBLE ELSE (w * f_rest)::DOUBLE / f_w::DOUBLE END AS target
  FROM ranked LEFT JOIN free ON true
), based AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM plan
), running AS (
  SELECT r.source, r.h, r.n, sum(r.n) OVER (PARTITION BY r.source ORDER BY r.h) AS upto, b.target - b.base * b.source_size AS needed
  FROM (SELECT source, h, sum(size) AS n FROM rows GROUP BY source, h) r JOIN based b ON r.source IS NOT DISTINCT FROM b.source WHERE r.n > 0
), edge AS (
  SELECT source, min(h + CASE WHEN upto - needed < needed - (upto - n) THEN 1 ELSE 0 END) AS threshold
  FROM (SELECT * FROM running WHERE upto > needed QUALIFY row_number() OVER (PARTITION BY source ORDER BY h) = 1) GROUP BY source
)
SELECT r.doc_id, r.size, b.source_size, b.target, (r.size * (b.base + CASE WHEN r.h < coalesce(e.threshold, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rows r JOIN based b ON r.source IS NOT DISTINCT FROM b.source LEFT JOIN edge e ON r.source IS NOT DISTINCT FROM e.source
"""

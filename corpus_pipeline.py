"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet and rereads it for the next stage. All stages
but the last return the columns of documents, extra columns included, whatever their names. Every stage takes null ids, texts, languages and sources, equal rows,
empty and very long texts and empty tables; its docstring says what they give. There is no SQL for the whole: the language model, the signatures and
the merges can't be told in it. The tests hold the stages against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, line_dedup, mixing, near_dup, quality, sorted_ids
from spanloom.llm.common import fresh, materialise, table
from spanloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose perplexity lies outside their language's band.

    Rows that are equal in id, language and text are judged alike. Rejected rows are told by a hash, so no text is shuffled. Null and empty texts have too few
    words and go; a null language is a language of its own; an empty table stays empty.
    """
    (row,) = fresh(docs, "_row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "lang", "text"))
    rejected = quality.judge(keyed.select(F.col(row).alias("row"), "lang", "text"), key="row").where(~F.col("kept")).select("row")
    return sorted_ids.rows_with(keyed, row, sorted_ids.store(rejected, "row"), wanted=False).select(*docs.columns)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of runs of lines, corrects n_chars, and drops documents of which nothing is left.

    Null texts stay, documents with a null id count as the last; of equal rows none repeats the other.
    """
    # The whole row travels as one value, so that no column can clash with the operator's own.
    done = line_dedup.dedup(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_rest")))
    changed = F.size("removed") > 0
    left = done.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))).otherwise(F.col("_rest.n_chars")) if "n_chars" in docs.columns else None}
    return left.select(*[own[c].alias(c) if c in own else F.col("_rest")[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies (five words, similarity 0.8).

    Documents with a null id, a null text or no words link with nothing and stay; so do all rows of an id that is kept.
    """
    return near_dup.survivors(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources wants it (weights 5, 2, 1; three times at most).

    A null source is a source of its own; documents without words are taken as their hash says; equal rows are taken together.
    """
    rows = docs.select("doc_id", "text", "source", F.struct("*").alias("_all"))
    return mixing.repeated(mixing.mix(rows)).select("_all.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text; null texts have none."""
    path = vocabulary("byte_bpe_50k.json")
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded="decoded")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("quality", quality_rules), ("line_dedup", line_repeats), ("near_dup", near_copies), ("mixing", source_mix), ("bpe", token_ids)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

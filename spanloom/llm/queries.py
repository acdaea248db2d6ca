"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import shared_dir, table
from spanloom.llm.mixing import ORACLE as mixing_sql
from spanloom.llm.warc import ORACLE as warc_sql


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the files are installed beside Python, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from spanloom.llm import bpe

    path = path or vocabulary("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import mixing

    mixed = mixing.mix_keys(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import near_dup

    grouped = near_dup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
    return grouped.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import line_dedup

    done = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), "text")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import warc

    folder = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    got = warc.read(spark, folder)
    return got.select("page_id", F.col("declared_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.length("payload").cast("long").alias("stored_bytes"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import pii

    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("pii", lambda s: s["base"])
    count = lambda k: F.size(F.filter("pii", lambda s: s["base"] & (s["rank"] == k))).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(pii.shown(base).cast("binary"), 256).alias("base_sha256"), pii.shown(F.col("pii")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import quality

    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select("doc_id", *quality.FEATURES, "base_failed", "kept", F.col("bits").alias("bits_per_char"), "low", "high")


def op8_token_records(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    from spanloom.llm import token_records

    folder = shared_dir(spark, "token-records")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = token_records.write(docs, folder, path or vocabulary("word_bpe_49k.json"), end_id=1)
    got = token_records.digest(token_records.read(spark, folder))
    # The order of a file's records is their offsets; the running sum within a file and the files before it make start.
    from pyspark.sql import Window

    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("offset")) - F.col("n_tokens")
    return got.withColumn("within", before).join(token_records.starts(index), "part").select(
        "doc_id", (F.col("before") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import fingerprints as fp

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = fp.next_rows(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 4)))"), F.expr("substring(next_text, 1, int(floor(n_chars / 4)))"))
    )
    both = both.withColumn("edited_mins", fp.mins(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fp.shown(F.col("mins")).alias("fingerprint"),
        fp.shown(F.col("edited_mins")).alias("edited_fingerprint"),
        fp.resemblance(F.col("mins"), F.col("edited_mins")).alias("near_edited"),
        fp.resemblance(F.col("mins"), F.col("next_mins")).alias("near_next"),
        fp.containment(F.col("edited_mins"), F.col("mins")).alias("edited_contained"),
        fp.distinct_count(F.col("mins")).alias("n_shingles_estimate"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm import secrets

    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_near_dup": op3_near_dup,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_token_records": op8_token_records,
    "op9_fingerprints": op9_fingerprints,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing_sql,
    "op5_warc": warc_sql,
}

"""Reading text corpora and writing what was found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files and folders whose names begin with a dot are left out unless asked for.
_HIDDEN = r"(^|/)\.[^/.]"


def files(spark: SparkSession, path: str | list[str], hidden: bool = False, pattern: str = "*") -> DataFrame:
    """(path, modified, length, content): whole files as bytes, folders searched through."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    df = df.select("path", F.col("modificationTime").alias("modified"), "length", "content")
    return df if hidden else df.where(~F.col("path").rlike(_HIDDEN))


def texts(spark: SparkSession, path: str | list[str], hidden: bool = False, pattern: str = "*") -> DataFrame:
    """(path, text): whole files as UTF-8 text."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df if hidden else df.where(~F.col("path").rlike(_HIDDEN))


def lines(spark: SparkSession, path: str | list[str], hidden: bool = False, pattern: str = "*") -> DataFrame:
    """(path, line): one row for each line. Large files are split among tasks, so lines carry no numbers; see operators.explode_lines for those."""
    df = spark.read.text(path, lineSep="\n", recursiveFileLookup=True, pathGlobFilter=pattern)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\r\z", "").alias("line"))
    return df if hidden else df.where(~F.col("path").rlike(_HIDDEN))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def grep_lines(found: DataFrame, path: str = "path") -> DataFrame:
    """(value): 'path:line number:line' for rows of operators.grep."""
    parts: list[Column] = [F.col(path).cast("string"), F.col("line_no").cast("string"), F.col("line")]
    return found.select(F.concat_ws(":", *parts).alias("value"))


def write_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes a table of one text column as files of lines."""
    df.write.mode(mode).text(path)

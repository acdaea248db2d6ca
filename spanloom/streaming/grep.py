"""The stateless operators on streams: lines are searched as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.pattern import Regex


def line_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """(line) of files as they appear in a folder."""
    stream = spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).text(path)
    return stream.select(F.regexp_replace("value", r"\r\z", "").alias("line"))


def grep_stream(lines: DataFrame, pattern: str, ignore_case: bool = False, word: bool = False) -> DataFrame:
    """The lines of a stream that match."""
    return lines.where(Regex(rf"\b(?:{pattern})\b" if word else pattern, case_insensitive=ignore_case).is_match("line"))

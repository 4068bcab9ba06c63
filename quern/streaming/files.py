"""Token counts over a stream of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import c_tokens as C


def stream_units(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(unit_id, src, arrived): text files of a folder, whole, as they arrive."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.col("_metadata.file_path").alias("unit_id"), F.col("value").alias("src"), F.col("_metadata.file_modification_time").alias("arrived"))


def token_counts(units: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Tokens by name and event-time window; lexing keeps no state, so only the counts do."""
    cut = units.withWatermark("arrived", late).select("arrived", F.explode(F.regexp_extract_all(C.mark_headers(F.col("src")), F.lit(C.LEXEME), F.lit(0))).alias("src"))
    named = cut.select("arrived", C.token_name(C.unmarked(F.col("src")), C.class_of(F.col("src"))).alias("tname")).where("tname IS NOT NULL")
    return named.groupBy(F.window("arrived", window), "tname").count()

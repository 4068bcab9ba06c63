"""C files in and relations out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_units(spark: SparkSession, path: str, pattern: str = "*.{c,h}") -> DataFrame:
    """(unit_id, src) of the files under `path`; line ends are left as they are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("unit_id"), F.decode("content", "UTF-8").alias("src"))


def utf8_status(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(unit_id, ok, code) of binary sources: invalid_utf8 where bytes are no UTF-8, which read_units() replaces by U+FFFD."""
    ok = F.coalesce(F.is_valid_utf8(files[content_col].cast("string")), F.lit(True))
    return files.select(files[id_col].alias("unit_id"), ok.alias("ok"), F.when(~ok, "invalid_utf8").alias("code"))


def units_from(df: DataFrame, id_col: str, src_col: str) -> DataFrame:
    """Units from any table with a source column; a null source counts as empty."""
    return df.select(df[id_col].alias("unit_id"), F.coalesce(df[src_col], F.lit("")).alias("src"))


def write_relations(relations: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each relation as Parquet in a folder of its own."""
    for name, df in relations.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def token_json(tokens: DataFrame) -> DataFrame:
    """(unit_id, json): the token list of each unit with kind, tname, src and span, in order."""
    span = F.struct("start", "end", "line", "col").alias("span")
    leaf = F.struct(F.lit("token").alias("kind"), "tname", "src", span)
    rows = tokens.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("tok_ix", leaf.alias("leaf")))).alias("x"))
    return rows.select("unit_id", F.to_json(F.transform("x", lambda t: t["leaf"])).alias("json"))

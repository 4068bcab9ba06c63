"""Typedef names bound in the order of their declarations.

`typedef T U;` binds U where T is a type already, and T where it is not, so what a declaration binds
depends on all before it. Declarations that name no other word are settled at once; then rounds
settle each one whose word is bound before it, or which nothing open before it could still bind.
Only file-scope typedefs take part, one small row each, and the rounds end when none is open: as
many as the longest chain of declarations that wait for each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.tables import dropped, written
from .declarations import declarations, symbols, without_attributes


def typedef_parts(marked: DataFrame) -> DataFrame:
    """(unit_id, ix, name, word) of each declarator of each file-scope typedef: ix ends the declaration; word is the first plain word before the first declarator's name, null where there is none."""
    made = declarations(marked).where("is_typedef").select("unit_id", "decl_ix", F.col("last_ix").alias("ix"))
    named = symbols(marked).join(made, ["unit_id", "decl_ix"]).select("unit_id", "decl_ix", "part", "ix", "name", "tok_ix")
    plain = without_attributes(marked).where("NOT in_body AND braces = 0 AND parens = 0 AND brackets = 0 AND part = 0 AND tname IN ('ID', 'TYPEDEF_NAME', 'MACRO_NAME')").where("coalesce(prev, '') NOT IN ('struct', 'union', 'enum')")
    first = plain.groupBy("unit_id", "decl_ix").agg(F.min(F.struct("tok_ix", "src")).alias("x"))
    rows = named.join(first, ["unit_id", "decl_ix"], "left")
    word = F.when((F.col("part") == 0) & (F.col("x.tok_ix") < F.col("tok_ix")), F.col("x.src"))
    return rows.select("unit_id", "ix", "name", word.alias("word"))


def ordered_typedefs(parts: DataFrame, predefined: list[str] = ()) -> DataFrame:
    """(unit_id, name, bind_ix) of each name that `parts` (unit_id, ix, name, word) bind, with the end of the first declaration that does; predefined names are types from the start."""
    known = F.col("word").isin(*predefined) if predefined else F.lit(False)
    parts = written(parts, "typedefs")
    settled = F.col("word").isNull() | known
    bound = parts.where(settled).select("unit_id", "ix", "name")
    left = written(parts.where(~settled), "typedefs")
    tables = [parts, left]
    while left.limit(1).count():
        first = bound.groupBy("unit_id", F.col("name").alias("word")).agg(F.min("ix").alias("_bound"))
        # What is open might bind its own name or its word.
        might = left.select("unit_id", "ix", F.explode(F.array("name", "word")).alias("word")).groupBy("unit_id", "word").agg(F.min("ix").alias("_open"))
        asked = left.join(first, ["unit_id", "word"], "left").join(might, ["unit_id", "word"], "left")
        is_known, is_open = F.coalesce(F.col("_bound") < F.col("ix"), F.lit(False)), F.coalesce(F.col("_open") < F.col("ix"), F.lit(False))
        decided = written(asked.select("unit_id", "ix", "name", "word", is_known.alias("known"), (is_known | ~is_open).alias("done")), "typedefs")
        bound = bound.unionByName(decided.where("done").select("unit_id", "ix", F.when(F.col("known"), F.col("name")).otherwise(F.col("word")).alias("name")))
        left = decided.where("NOT done").select("unit_id", "ix", "name", "word")
        tables.append(decided)
    out = written(bound.groupBy("unit_id", "name").agg(F.min("ix").alias("bind_ix")), "typedefs")
    for table in tables:
        dropped(table)
    return out


def with_typedefs(tokens: DataFrame, bound: DataFrame) -> DataFrame:
    """`tokens` whose identifiers after their name's bind_ix are TYPEDEF_NAME."""
    told = tokens.join(bound.withColumnRenamed("name", "src"), ["unit_id", "src"], "left")
    free = F.col("tname").isin("ID", "MACRO_NAME") & F.col("dir_id").isNull() & (F.col("tok_ix") > F.col("bind_ix"))
    return told.withColumn("tname", F.when(F.coalesce(free, F.lit(False)), "TYPEDEF_NAME").otherwise(F.col("tname"))).select(tokens.columns)

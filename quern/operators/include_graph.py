"""Which units a unit includes, directly and through others.

Header names are resolved by folder, then edges are followed by semi-naive rounds: each joins only
the pairs that the round before found new. Rounds are as many as the longest shortest chain of
includes. A header that very many units include is met by many pairs in a round, so the edges of
such headers are copied to several shares and the pairs dealt among them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.tables import dropped, written

#: Units that include a header beyond which its edges are copied, and the number of copies.
POPULAR = 10_000
SHARES = 32


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _plain(path: Column) -> Column:
    """A path without empty and . steps; each .. takes the step before it, where there is one."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when((s == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def include_edges(units: DataFrame, includes: DataFrame, folders: Sequence[str] = ()) -> DataFrame:
    """(unit_id, line, header_name, header_kind, target) of each include of `includes`; target is a unit_id of `units`, or null where none is there.

    unit_id is the unit's path. A local name is looked for in the folder of its unit, then in
    `folders` in their order; a system name in `folders` alone; macro names stay unresolved.
    """
    asked = includes.select(F.col("unit_id").cast("string").alias("unit_id"), "line", "header_name", "header_kind")
    own = F.when(F.col("header_kind") == "local", F.array(F.struct(F.lit(0).alias("rank"), _folder(F.col("unit_id")).alias("folder")))).otherwise(F.array().cast("array<struct<rank:int,folder:string>>"))
    others = F.when(F.col("header_kind") != "macro", F.array(*(F.struct(F.lit(k + 1).alias("rank"), F.lit(f).alias("folder")) for k, f in enumerate(folders))).cast("array<struct<rank:int,folder:string>>")).otherwise(F.array().cast("array<struct<rank:int,folder:string>>"))
    absolute = F.col("header_name").startswith("/")
    spelled = lambda x: F.when(absolute | (x["folder"] == ""), F.col("header_name")).otherwise(F.concat(x["folder"], F.lit("/"), F.col("header_name")))
    places = F.transform(F.concat(own, others), lambda x: F.struct(x["rank"].alias("rank"), _plain(spelled(x)).alias("path")))
    known = units.select(F.col("unit_id").cast("string").alias("_unit")).distinct().withColumn("path", _plain(F.col("_unit")))
    tried = asked.withColumn("_try", F.explode_outer(places)).select("unit_id", "line", "header_name", "header_kind", "_try.rank", "_try.path")
    found = tried.join(known, "path", "left").groupBy("unit_id", "line", "header_name", "header_kind")
    return found.agg(F.min(F.when(F.col("_unit").isNotNull(), F.struct("rank", F.col("_unit").alias("unit")))).alias("x")).select("unit_id", "line", "header_name", "header_kind", F.col("x.unit").alias("target"))


def include_closure(edges: DataFrame, popular: int = POPULAR, shares: int = SHARES) -> DataFrame:
    """(unit_id, target, depth) of each unit that is reached from another over `edges` (unit_id, target), with the least number of steps.

    A unit that reaches itself is on a cycle: it has a row with target = unit_id. Unresolved targets
    and repeated edges count for nothing. Every round is a written table; pairs are as many as the result.
    """
    edges = written(edges.where("target IS NOT NULL").select("unit_id", "target").distinct(), "edges")
    often = edges.groupBy("target").count().where(F.col("count") > popular).select(F.col("target").alias("_popular"))
    marked = edges.join(often, edges["target"] == often["_popular"], "left").select("unit_id", "target", F.col("_popular").isNotNull().alias("popular"))
    steps = marked.join(often.withColumnRenamed("_popular", "_source"), F.col("unit_id") == F.col("_source"), "left")
    copies = F.explode(F.when(F.col("_source").isNotNull(), F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.lit(0))))
    steps = written(steps.select(F.col("unit_id").alias("via"), F.col("target").alias("next"), F.col("popular").alias("next_popular"), copies.alias("share")), "steps")
    reached = new = written(marked.select("unit_id", "target", "popular", F.lit(1).alias("depth")), "reached")
    parts = [reached]
    depth = 1
    while new.limit(1).count():
        depth += 1
        share = F.when(F.col("popular"), F.pmod(F.xxhash64("unit_id"), F.lit(shares)).cast("int")).otherwise(F.lit(0))
        joined = new.select("unit_id", F.col("target").alias("via"), share.alias("share")).join(steps, ["via", "share"]).groupBy("unit_id", F.col("next").alias("target")).agg(F.first("next_popular").alias("popular"))
        new = written(joined.join(reached.select("unit_id", "target"), ["unit_id", "target"], "left_anti").select("unit_id", "target", "popular", F.lit(depth).alias("depth")), "reached")
        parts.append(new)
        reached = reached.unionByName(new)
    dropped(edges)
    dropped(steps)
    return reached.select("unit_id", "target", "depth")

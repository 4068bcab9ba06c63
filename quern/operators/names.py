"""What each name in an expression refers to, within its unit and across units; names that nothing declares or nothing uses.

Every place that could declare a name gives a candidate with a rank, and one aggregate over all of
them takes the first of the least rank. Only names that their own unit doesn't declare are looked
for in other units: once a unit, against a table with one row a name, whose rows are copied for
names that very many units ask for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..blocks.facade import F
from ..sources.tables import written
from .declarations import enumerators, parameters, symbols
from .inner import local_symbols
from .regions import code_regions
from .trees import bracketed, expressions

#: Units that ask for a name beyond which its row is copied, and the number of copies.
POPULAR = 10_000
SHARES = 32
_RANKS = {0: "macro", 1: "local", 2: "parameter", 3: "file"}


def local_scopes(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, name, tok_ix, from_ix, end_ix) of each local declarator: it is known from its name to the end of the block, or of the for statement, that holds it."""
    own = bracketed(marked)
    held = own.where("in_body").select("unit_id", "tok_ix", F.col("holder.kind").alias("_kind"), (F.col("holder.tok_ix") - 1).alias("_word"), "holder.close_ix")
    loops = code_regions(own).where("kind = 'for'").select("unit_id", F.col("first_ix").alias("_word"), F.col("last_ix").alias("_loop"))
    found = local_symbols(own).join(held, ["unit_id", "tok_ix"]).join(loops, ["unit_id", "_word"], "left")
    end = F.when(F.col("_kind") == "control", F.col("_loop")).otherwise(F.col("close_ix"))
    return found.select("unit_id", "decl_ix", "name", "tok_ix", F.col("tok_ix").alias("from_ix"), F.coalesce(end, F.lit((1 << 62))).alias("end_ix"))


def linkage(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, part, name, tok_ix, decl_kind, is_static, defines) of each file-scope declarator that is no typedef; defines: a body, or an object without extern."""
    own = marked.where("dir_id IS NULL AND NOT in_attribute AND NOT in_body AND braces = 0 AND parens = 0 AND part = 0")
    words = own.groupBy("unit_id", "decl_ix").agg(*(F.max((F.col("src") == w).cast("int")).alias(f"_{w}") for w in ("static", "extern", "typedef")))
    rows = symbols(marked).join(words, ["unit_id", "decl_ix"], "left").where("coalesce(_typedef, 0) = 0")
    defines = (F.col("decl_kind") == "function_definition") | ~F.col("shape").isin("function") & (F.coalesce("_extern", F.lit(0)) == 0)
    return rows.select("unit_id", "decl_ix", "part", "name", "tok_ix", "decl_kind", (F.coalesce("_static", F.lit(0)) == 1).alias("is_static"), defines.alias("defines"))


def name_uses(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, name) of each name in an expression, but those of members."""
    return expressions(marked).where("kind = 'name' AND coalesce(side, '') <> 'member'").select("unit_id", "decl_ix", F.col("node_ix").alias("tok_ix"), F.col("op").alias("name"))


def in_units(marked: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, name, rank, target, here) of each name in an expression, by its own unit alone, and with rank -1 of each outer definition."""
    held = bracketed(marked) if held is None else held
    uses = written(name_uses(held), "uses")
    found = linkage(marked)
    key = ["unit_id", "decl_ix", "tok_ix", "name"]
    given = lambda df, rank, target, order: df.select(*key, F.lit(rank).alias("rank"), order.alias("place"), target.alias("target"))
    macros = marked.where("tname = 'MACRO_NAME'").select("unit_id", "decl_ix", "tok_ix", F.col("src").alias("name"))
    known = local_scopes(held).select("unit_id", "decl_ix", "name", F.col("tok_ix").alias("at"), "from_ix", "end_ix")
    local = uses.join(known, ["unit_id", "decl_ix", "name"]).where("from_ix <= tok_ix AND tok_ix <= end_ix")
    param = uses.join(parameters(marked).where("name IS NOT NULL").select("unit_id", "decl_ix", "name").distinct(), ["unit_id", "decl_ix", "name"])
    consts = enumerators(marked).select("unit_id", "name", F.col("owner_ix").alias("at"), F.lit(True).alias("here"))
    in_file = found.select("unit_id", "name", F.col("tok_ix").alias("at"), F.col("defines").alias("here")).unionByName(consts)
    first = in_file.groupBy("unit_id", "name").agg(F.min("at").alias("at"), F.max("here").alias("here"))
    file = uses.join(first, ["unit_id", "name"]).where("at <= tok_ix")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    every = given(macros, 0, none, zero).unionByName(given(local, 1, F.col("at"), -F.col("at"))).unionByName(given(param, 2, none, zero)).unionByName(file.select(*key, F.lit(3).alias("rank"), zero.alias("place"), F.col("at").alias("target"), "here"), allowMissingColumns=True)
    every = every.unionByName(uses.select(*key, F.lit(4).alias("rank"), zero.alias("place"), none.alias("target")), allowMissingColumns=True)
    best = every.groupBy(*key).agg(F.min(F.struct("rank", "place", "target", "here")).alias("x"), F.max(F.col("rank") == 4).alias("used")).where("used")
    best = best.select(*key, "x.rank", "x.target", F.coalesce("x.here", F.lit(True)).alias("here"))
    outer = found.where("defines AND NOT is_static").select(*key, F.lit(-1).alias("rank"), none.alias("target"), F.lit(True).alias("here"))
    return best.unionByName(outer)


def across_units(rows: DataFrame, popular: int = POPULAR, shares: int = SHARES) -> DataFrame:
    """resolved() from what in_units() gave of all units."""
    key = ["unit_id", "decl_ix", "tok_ix", "name"]
    rows = written(rows, "names-in-units")
    best, found = rows.where("rank >= 0"), rows.where("rank < 0")
    # What the unit doesn't define itself is asked of all units, once a unit and name.
    asked = best.where("rank = 4 OR rank = 3 AND NOT here").select("unit_id", "name").distinct()
    outer = found.groupBy("name").agg(F.min(F.struct(F.col("unit_id").alias("unit"), F.col("tok_ix").alias("at"))).alias("outer"))
    often = asked.groupBy("name").count().where(F.col("count") > popular).select("name", F.lit(True).alias("_often"))
    copies = F.explode(F.when(F.col("_often"), F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array(F.lit(0))))
    outer = outer.join(often, "name", "left").select("name", "outer", copies.alias("_share"))
    share = F.when(F.col("_often"), F.pmod(F.xxhash64("unit_id"), F.lit(shares)).cast("int")).otherwise(F.lit(0))
    answers = asked.join(F.broadcast(often) if often.count() <= 10_000 else often, "name", "left").withColumn("_share", share).join(outer, ["name", "_share"]).select("unit_id", "name", "outer")
    rows = best.join(answers, ["unit_id", "name"], "left")
    by_rank = F.create_map(*[F.lit(x) for pair in _RANKS.items() for x in pair])
    other = F.col("outer").isNotNull() & ((F.col("rank") == 4) | (F.col("outer.unit") != F.col("unit_id")))
    scope = F.when(other, "extern").otherwise(F.coalesce(by_rank[F.col("rank")], F.lit("undefined")))
    target_unit = F.when(other, F.col("outer.unit")).when(F.col("rank") < 4, F.col("unit_id"))
    return rows.select(*key, scope.alias("scope"), target_unit.alias("target_unit"), F.when(other, F.col("outer.at")).otherwise(F.col("target")).alias("target_ix"))


def resolved(marked: DataFrame, held: DataFrame | None = None, popular: int = POPULAR, shares: int = SHARES) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, name, scope, target_unit, target_ix) of each name in an expression.

    scope: macro, local, parameter, file (declared before its use in the same unit, enumerators too),
    extern (defined with outer linkage in another unit; target_unit is the least such), or undefined.
    A prototype or extern object of the unit itself that another unit defines is extern too, and so
    is what a unit, be it the same, defines but its own file has not declared before the use.
    target_ix: the token that declares the name, null for macros and for undefined names. Of several
    locals in scope the last one counts, of several declarations in a file the first. held:
    bracketed(marked), where it is written.
    """
    return across_units(in_units(marked, held), popular, shares)


def unused(marked: DataFrame, uses: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(unit_id, name, tok_ix, scope) of what nothing refers to: locals, static functions and objects, and outer definitions that no unit uses (main is used). uses: what resolved() gave."""
    local = local_scopes(marked if held is None else held).select("unit_id", "name", "tok_ix", F.lit("local").alias("scope"))
    found = linkage(marked).where("defines AND name <> 'main'")
    own = local.unionByName(found.where("is_static").select("unit_id", "name", "tok_ix", F.lit("static").alias("scope")))
    met = uses.where("target_ix IS NOT NULL").select(F.col("target_unit").alias("unit_id"), F.col("target_ix").alias("tok_ix")).distinct()
    alone = own.join(met, ["unit_id", "tok_ix"], "left_anti")
    named = uses.where("scope IN ('file', 'extern')").select("name").distinct()
    return alone.unionByName(found.where("NOT is_static").join(named, "name", "left_anti").select("unit_id", "name", "tok_ix", F.lit("outer").alias("scope")))

"""Regions of a source as nested intervals of tokens, and which of them lie in which.

A region is (first_ix, last_ix) in the order of its unit's tokens: pre-order by first_ix, an ancestor
where its interval holds another one. Containment is an equi-join: an interval is filed under the
smallest dyadic cell [k 2^h, (k+1) 2^h) that holds it, and an inner one asks the cells that hold its
first token, one for each h in use. Intervals under one cell all reach over its middle, and those of
well-formed sources are then nested in each other, so a question meets as many rows as regions are
nested, not as many as a unit has. Cells of a unit are dealt apart, so a large unit is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..blocks.facade import F, Window
from .declarations import declarations, symbols
from .preprocessor import conditional_lines, directives
from .trees import CONTROL, _declaration, _flag, _upto, bracketed

KINDS = ("declaration", "function", "block", "members", "enumerators", "list", "if", "else", "while", "for", "do", "switch", "call", "subscript", "branch")


def branch_regions(lines: DataFrame) -> DataFrame:
    """(unit_id, kind, name, first_ix, last_ix, group_ix, branch_ix, condition, depth) of each branch of each closed conditional group: from its directive to before the next one of its group; name is the directive."""
    marks = conditional_lines(lines).where("group_ix IS NOT NULL")
    after = F.lead("tok_ix").over(Window.partitionBy("unit_id", "group_ix").orderBy("tok_ix"))
    rows = marks.withColumn("_after", after).where("directive <> 'endif'")
    return rows.select("unit_id", F.lit("branch").alias("kind"), F.col("directive").alias("name"), F.col("tok_ix").alias("first_ix"), (F.col("_after") - 1).alias("last_ix"), "group_ix", "branch_ix", "condition", "depth")


def code_regions(marked: DataFrame) -> DataFrame:
    """(unit_id, kind, name, first_ix, last_ix) of each block, tag body, list, statement with a head, call and subscript.

    A statement goes to the first semicolon or closing brace of a block after it, on its own level,
    that no else follows, and for a do no while that ends one; name is a call's callee.
    """
    own = bracketed(marked)
    last = F.last(F.when(F.col("src").isin("do", "while"), F.col("src")), ignorenulls=True).over(_upto(_declaration("in_ix"), -1))
    own = own.withColumn("_tail", _flag((F.col("src") == "while") & (last == "do")))
    body = _flag(F.col("mate.kind") == "block") & _flag(F.col("mate.prev") != "(")
    ends = ((F.col("src") == ";") & (F.coalesce("holder.kind", F.lit("block")) == "block") | body) & ~_flag(F.col("next") == "else")
    own = own.withColumns({"_ends": _flag(ends), "_to_tail": F.coalesce(F.lead("_tail").over(_declaration()), F.lit(False))})
    back = _upto(Window.partitionBy("unit_id", "decl_ix", "in_ix").orderBy(F.desc("tok_ix")), -1)
    end = F.last(F.when(F.col("_ends") & ~F.col("_to_tail"), F.col("tok_ix")), ignorenulls=True).over(back)
    own = own.withColumn("_end", end)
    word = F.when(F.col("src").isin(*CONTROL, "do", "else") & F.col("in_body") & ~F.col("_tail"), F.col("src"))
    bracket = F.when(F.col("kind").isin("block", "members", "enumerators", "list", "call", "subscript"), F.col("kind"))
    kind = F.coalesce(bracket, word)
    used = F.when(F.col("in_body"), F.col("item_ix").isNull() | F.col("item_value")).otherwise(F.col("in_value"))
    own = own.where(~F.col("kind").isin("call", "subscript") | F.col("kind").isNull() | used)
    name = F.when((F.col("kind") == "call") & F.col("prev_t").isin("ID", "MACRO_NAME"), F.col("prev"))
    last_ix = F.when(bracket.isNotNull(), F.col("close_ix")).otherwise(F.col("_end"))
    return own.where(kind.isNotNull()).select("unit_id", kind.alias("kind"), name.alias("name"), F.col("tok_ix").alias("first_ix"), last_ix.alias("last_ix")).where("last_ix IS NOT NULL")


def regions(marked: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(unit_id, kind, name, first_ix, last_ix) of all regions of the units; brackets that nothing closes have none. held: bracketed(marked), where it is written."""
    columns = ["unit_id", "kind", "name", "first_ix", "last_ix"]
    functions = symbols(marked).where("part = 0").select("unit_id", "decl_ix", F.col("name").alias("name"))
    own = declarations(marked).where("decl_kind <> 'directive'").join(functions, ["unit_id", "decl_ix"], "left")
    whole = own.select("unit_id", F.when(F.col("decl_kind") == "function_definition", "function").otherwise("declaration").alias("kind"), "name", "first_ix", "last_ix")
    return code_regions(marked if held is None else held).select(columns).unionByName(branch_regions(directives(marked)).select(columns)).unionByName(whole)


def _height(a: Column, b: Column) -> Column:
    """The h of the smallest dyadic cell that holds both."""
    apart = a.bitwiseXOR(b)
    return F.when(apart == 0, 0).otherwise(F.length(F.bin(apart)))


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs of a row of `inner` and one of `outer` (both with unit_id, first_ix, last_ix) whose interval holds it, as structs; an interval holds itself."""
    filed = outer.select("unit_id", _height(F.col("first_ix"), F.col("last_ix")).alias("_h"), F.struct(*outer.columns).alias("outer"))
    filed = filed.withColumn("_cell", F.expr("shiftright(outer.first_ix, _h)"))
    heights = [r[0] for r in filed.select("_h").distinct().collect()]  # up to 64
    asks = inner.select("unit_id", F.struct(*inner.columns).alias("inner"), F.explode(F.array(*map(F.lit, heights)).cast("array<int>")).alias("_h"))
    asks = asks.withColumn("_cell", F.expr("shiftright(inner.first_ix, _h)"))
    found = asks.join(filed, ["unit_id", "_h", "_cell"])
    return found.where("outer.first_ix <= inner.first_ix AND inner.last_ix <= outer.last_ix").select("unit_id", "inner", "outer")


def ancestors(found: DataFrame) -> DataFrame:
    """(unit_id, first_ix, last_ix, kind, name, outer_first_ix, outer_last_ix, outer_kind, outer_name): each region of `found` with each one that holds it, but itself."""
    pairs = within(found, found).where("inner <> outer AND NOT (inner.first_ix = outer.first_ix AND inner.last_ix = outer.last_ix AND inner.kind < outer.kind)")
    columns = ("first_ix", "last_ix", "kind", "name")
    return pairs.select("unit_id", *(F.col(f"inner.{c}").alias(c) for c in columns), *(F.col(f"outer.{c}").alias(f"outer_{c}") for c in columns))


def branch_members(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, decl_kind, group_ix, branch_ix, branch_kind, condition, ordinal, depth, path) of each declaration in each branch that holds it, the outermost first.

    ordinal counts the branches around a declaration from 0, depth is how many there are, path are
    the directives with their conditions down to this one. Only closed groups at file scope hold
    anything; a declaration that goes on past the end of a branch is not in it.
    """
    own = declarations(marked).where("decl_kind <> 'directive'").select("unit_id", "decl_ix", "decl_kind", "first_ix", "last_ix")
    found = within(own, branch_regions(directives(marked))).select("unit_id", "inner.decl_ix", "inner.decl_kind", F.col("outer.first_ix").alias("_at"), "outer.group_ix", "outer.branch_ix", F.col("outer.name").alias("branch_kind"), "outer.condition")
    order = Window.partitionBy("unit_id", "decl_ix").orderBy("_at")
    path = F.collect_list(F.concat_ws(" ", "branch_kind", F.nullif("condition", F.lit("")))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    depth = F.count("*").over(Window.partitionBy("unit_id", "decl_ix"))
    return found.withColumns({"ordinal": (F.row_number().over(order) - 1).cast("long"), "depth": depth, "path": path}).drop("_at")

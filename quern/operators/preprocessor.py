"""Preprocessor lines, macro events, and conditional groups. Conditions are never evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import c_tokens as C

CONDITIONALS = ("if", "ifdef", "ifndef", "elif", "elifdef", "elifndef", "else", "endif")
OPENERS = ("if", "ifdef", "ifndef")
BRANCHES = ("elif", "elifdef", "elifndef", "else")


def directives(tokens: DataFrame) -> DataFrame:
    """One row for each directive line: its kind, name, first token, and the tokens after its name."""
    line = tokens.where("dir_id IS NOT NULL AND tname <> 'PP_NEWLINE'").groupBy("unit_id", "dir_id").agg(
        F.array_sort(F.collect_list(F.struct("tok_ix", "tname", "src", "start", "end"))).alias("line"), F.min("tok_ix").alias("tok_ix"), F.min("line").alias("at_line"), F.min("braces").alias("braces")
    )
    name = F.get("line.src", 1)
    body = F.slice("line", 3, F.greatest(F.size("line") - 2, F.lit(0)))
    kind = (
        F.when(name.isin(*CONDITIONALS), "conditional_directive").when(name == "define", "define_directive").when(name == "undef", "undef_directive")
        .when(name.isin("include", "include_next", "embed"), "include_directive").when(name.isin("pragma", "error", "warning", "line"), F.concat(name, F.lit("_directive"))).otherwise("unknown_directive")
    )
    return line.select("unit_id", "dir_id", "tok_ix", F.col("at_line").alias("line"), "braces", kind.alias("kind"), name.alias("directive"), body.alias("body"))


def _spelled(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda t: t["src"]), " ")


def defines(lines: DataFrame) -> DataFrame:
    """Macro definitions: name, kind, parameters, variadic, body text. A ( that touches the name makes it function-like."""
    name, after = F.get("body", 0), F.get("body", 1)
    is_function = F.coalesce((after["src"] == "(") & (after["start"] == name["end"]), F.lit(False))
    close = F.array_position(F.transform("body", lambda t: t["src"]), ")").cast("int")
    listed = F.when(is_function & (close > 0), F.slice("body", 3, F.greatest(close - 3, F.lit(0)))).otherwise(F.slice("body", 1, 0))
    params = F.transform(F.filter(listed, lambda t: t["tname"].isin("ID", "MACRO_NAME", "TYPEDEF_NAME")), lambda t: t["src"])
    rest = F.when(is_function, F.slice("body", F.greatest(close + 1, F.lit(1)), F.size("body"))).otherwise(F.slice("body", 2, F.size("body")))
    return lines.where("kind = 'define_directive' AND size(body) > 0").select(
        "unit_id", "dir_id", "tok_ix", name["src"].alias("macro_name"), name["tok_ix"].alias("name_ix"), F.when(is_function, "function-like").otherwise("object-like").alias("macro_kind"),
        params.alias("macro_params"), F.exists(listed, lambda t: t["src"] == "...").alias("macro_variadic"), _spelled(rest).alias("macro_body"),
    )


def includes(lines: DataFrame) -> DataFrame:
    """Included headers as an edge table; never resolved."""
    head = F.get("body", 0)
    kind = F.when(head["src"].startswith("<"), "system").when(head["src"].startswith('"'), "local").otherwise("macro")
    name = F.when(kind != "macro", F.expr("substring(body[0].src, 2, length(body[0].src) - 2)")).otherwise(_spelled(F.col("body")))
    return lines.where("kind = 'include_directive'").select("unit_id", "dir_id", "line", F.col("directive").alias("include_form"), kind.alias("header_kind"), name.alias("header_name"))


def macro_events(lines: DataFrame) -> DataFrame:
    """(unit_id, name, ix, op): a name is a macro from just after its define to its next undef."""
    made = defines(lines).select("unit_id", F.col("macro_name").alias("name"), F.col("name_ix").alias("ix"), F.lit("define").alias("op"))
    gone = lines.where("kind = 'undef_directive' AND size(body) > 0").select("unit_id", F.col("body")[0]["src"].alias("name"), F.col("body")[0]["tok_ix"].alias("ix"), F.lit("undef").alias("op"))
    return made.union(gone)


def macro_uses(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """(unit_id, tok_ix, name, is_macro) of every identifier outside directives: an as-of lookup of the last event of its name."""
    uses = tokens.where("tname = 'ID' AND dir_id IS NULL").select("unit_id", F.col("src").alias("name"), F.col("tok_ix").alias("ix"), F.lit(None).cast("string").alias("op"))
    order = Window.partitionBy("unit_id", "name").orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    seen = macro_events(lines).union(uses).withColumn("last", F.last("op", ignorenulls=True).over(order))
    return seen.where("op IS NULL").select("unit_id", F.col("ix").alias("tok_ix"), "name", F.coalesce(F.col("last") == "define", F.lit(False)).alias("is_macro"))


def conditional_lines(lines: DataFrame) -> DataFrame:
    """File-scope conditional directives with their depth and the directive that opens their group.

    A stray #endif can't take the depth below zero: the running sum is lifted by its lowest point.
    """
    order = Window.partitionBy("unit_id").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.where("kind = 'conditional_directive' AND braces = 0")
    step = F.when(F.col("directive").isin(*OPENERS), 1).when(F.col("directive") == "endif", -1).otherwise(0)
    own = own.withColumn("_sum", F.sum(step).over(order)).withColumn("_low", F.least(F.min("_sum").over(order), F.lit(0)))
    after = F.col("_sum") - F.col("_low")
    lifted = F.lag("_low", 1, 0).over(Window.partitionBy("unit_id").orderBy("tok_ix")) != F.col("_low")
    depth = after + F.when((F.col("directive") == "endif") & ~lifted, 1).otherwise(0)
    own = own.withColumns({"depth": F.when(lifted, 0).otherwise(depth), "stray": lifted})
    level = Window.partitionBy("unit_id", "depth").orderBy("tok_ix")
    opener = F.last(F.when(F.col("directive").isin(*OPENERS), F.col("tok_ix")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("group_ix", F.when(~F.col("stray") & (F.col("depth") > 0), opener))
    group = Window.partitionBy("unit_id", "group_ix").orderBy("tok_ix")
    branch = F.sum(F.when(F.col("directive").isin(*BRANCHES), 1).otherwise(0)).over(group)
    closed = F.max(F.when(F.col("directive") == "endif", F.col("tok_ix"))).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return own.select("unit_id", "tok_ix", "line", "directive", _spelled(F.col("body")).alias("condition"), "depth", F.when(closed.isNotNull(), F.col("group_ix")).alias("group_ix"), F.when(closed.isNotNull(), branch).alias("branch_ix"))


def conditional_branches(declarations: DataFrame, lines: DataFrame) -> DataFrame:
    """(unit_id, group_ix, branch_ix, branch_kind, condition, n_decls) for each branch of each closed group.

    n_decls counts the declarations directly in the branch; those of inner groups count there.
    """
    marks = conditional_lines(lines)
    events = marks.select("unit_id", "tok_ix", "depth", "group_ix", "branch_ix", "directive").union(
        declarations.where("decl_kind <> 'directive'").select("unit_id", F.col("first_ix").alias("tok_ix"), F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string"))
    )
    order = Window.partitionBy("unit_id").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, -1)
    # A declaration is in the group of the last directive before it, or outside that group after its #endif.
    last = F.last(F.when(F.col("directive").isNotNull(), F.struct("depth", "group_ix", "branch_ix", "directive", "tok_ix")), ignorenulls=True).over(order)
    held = events.withColumn("last", last).where("directive IS NULL AND last IS NOT NULL").select("unit_id", F.col("tok_ix").alias("decl_ix"), "last")
    inside = held.where("last.directive <> 'endif'").select("unit_id", F.col("last.group_ix").alias("group_ix"), F.col("last.branch_ix").alias("branch_ix"))
    # After an inner #endif: the branch of the enclosing level that was last begun.
    outer = held.where("last.directive = 'endif'").select("unit_id", "decl_ix", (F.col("last.depth") - 1).alias("depth"))
    begun = marks.where("directive <> 'endif' AND group_ix IS NOT NULL").select("unit_id", "depth", F.col("tok_ix").alias("at"), "group_ix", "branch_ix")
    resumed = outer.where("depth > 0").join(begun, ["unit_id", "depth"]).where("at < decl_ix").groupBy("unit_id", "decl_ix").agg(F.max(F.struct("at", "group_ix", "branch_ix")).alias("x")).select("unit_id", "x.group_ix", "x.branch_ix")
    counts = inside.union(resumed).where("group_ix IS NOT NULL").groupBy("unit_id", "group_ix", "branch_ix").agg(F.count("*").alias("n_decls"))
    heads = marks.where("directive <> 'endif' AND group_ix IS NOT NULL").select("unit_id", "group_ix", "branch_ix", F.col("directive").alias("branch_kind"), "condition", "depth")
    return heads.join(counts, ["unit_id", "group_ix", "branch_ix"], "left").fillna({"n_decls": 0})

"""Source text to lexemes and tokens, with places, bracket depths and directive lines.

Each unit is one row (unit_id, src). Units are dealt by unit_id before they are taken apart, so
all windows of a unit follow without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions import c_tokens as C


def _unit() -> WindowSpec:
    return Window.partitionBy("unit_id").orderBy("ix")


def _before() -> WindowSpec:
    return _unit().rowsBetween(Window.unboundedPreceding, -1)


def _so_far() -> WindowSpec:
    return _unit().rowsBetween(Window.unboundedPreceding, 0)


def lexemes(units: DataFrame) -> DataFrame:
    """(unit_id, ix, src, cls, start, end, line, col); every character of every unit is in one lexeme.

    start and end count code points from 0; line and col count from 1. A null or empty source has none.
    Sources that share a unit_id are one unit, one after the other in order of their text. A unit is
    one share of work.
    """
    nth = F.row_number().over(Window.partitionBy("unit_id").orderBy("src")) - 1
    cut = units.select("unit_id", "src", nth.cast("long").alias("_nth")).select("unit_id", "_nth", F.posexplode(F.regexp_extract_all(C.mark_headers(F.col("src")), F.lit(C.LEXEME), F.lit(0))).alias("ix", "src"))
    cut = cut.select("unit_id", (F.col("_nth") * (1 << 32) + F.col("ix")).alias("ix"), C.unmarked(F.col("src")).alias("src"), C.class_of(F.col("src")).alias("cls"))
    lines = F.length("src") - F.length(F.replace("src", F.lit("\n"), F.lit("")))
    cut = cut.withColumns({"size": F.length("src"), "_lines": lines})
    cut = cut.withColumns({"end": F.sum("size").over(_so_far()), "_line": F.sum("_lines").over(_so_far())})
    after_break = F.when(F.col("_lines") > 0, F.col("end") - F.length(F.substring_index("src", "\n", -1)))
    cut = cut.withColumn("_from", F.coalesce(F.max(after_break).over(_before()), F.lit(0)))
    start = F.col("end") - F.col("size")
    return cut.select("unit_id", F.col("ix").cast("long").alias("ix"), "src", "cls", start.alias("start"), "end", (1 + F.col("_line") - F.col("_lines")).alias("line"), (1 + start - F.col("_from")).alias("col"))


def _opens_directive() -> Column:
    """A # with nothing but blanks before it on its line; a continued line is a line of its own, a comment is not a blank."""
    is_break = lambda c: c.isNull() | c.isin("newline", "line_cont")
    one, two = F.lag("cls", 1).over(_unit()), F.lag("cls", 2).over(_unit())
    return F.col("src").isin("#", "%:") & (is_break(one) | (one == "space") & is_break(two))


def marked_lexemes(units: DataFrame) -> DataFrame:
    """Lexemes with tname and dir_id: the ordinal of the directive line that a lexeme belongs to, else null."""
    cut = lexemes(units).withColumn("_opens", _opens_directive())
    # A line is open until a line end stands between its # and a lexeme.
    cut = cut.withColumns({"_nth": F.sum(F.col("_opens").cast("int")).over(_so_far()), "_at": F.last(F.when(F.col("_opens"), F.col("ix")), ignorenulls=True).over(_so_far()), "_end": F.last(F.when(F.col("cls") == "newline", F.col("ix")), ignorenulls=True).over(_before())})
    inside = F.col("_at").isNotNull() & (F.col("_end").isNull() | (F.col("_end") < F.col("_at")))
    name = F.when(F.col("_opens") & inside, "PP_HASH").when((F.col("cls") == "newline") & inside, "PP_NEWLINE").otherwise(C.token_name(F.col("src"), F.col("cls")))
    # A # that opens while a directive is open is an ordinary one.
    return cut.select("*", F.when(inside, F.col("_nth")).alias("dir_id"), name.alias("tname")).drop("_opens", "_nth", "_at", "_end")


def _depth(opening: str, closing: str) -> Column:
    """Open brackets around a token; both brackets of a pair count as outside."""
    outside = F.col("dir_id").isNull()
    step = F.when(outside & (F.col("src") == opening), 1).when(outside & (F.col("src") == closing), -1).otherwise(0)
    return F.sum(step).over(_so_far()) - F.when(step == 1, 1).otherwise(0)


def tokens(units: DataFrame) -> DataFrame:
    """Real tokens in order: lexemes without blanks and trivia.

    tok_ix, braces, parens, brackets (open ones around the token, outside directives), prev and
    next (spelling of the neighbours), and leading: the comments and continued lines before it.
    """
    real = F.col("tname").isNotNull() & ~F.col("cls").isin(*C.TRIVIA)
    cut = marked_lexemes(units).where(~F.col("cls").isin(*C.BLANK) | (F.col("tname") == "PP_NEWLINE"))
    cut = cut.withColumn("_upto", F.coalesce(F.sum(real.cast("int")).over(_before()), F.lit(0)))
    group = Window.partitionBy("unit_id", "_upto").orderBy("ix")
    trivia = F.collect_list(F.when(~real, F.struct("tname", "src", "start", "end"))).over(group.rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("leading", trivia).where(real | (F.col("cls").isin("error", "open_comment")))
    return cut.select(
        "unit_id", "ix", (F.row_number().over(_unit()) - 1).cast("long").alias("tok_ix"), "tname", "src", "cls", "start", "end", "line", "col", "dir_id", "leading",
        _depth("{", "}").alias("braces"), _depth("(", ")").alias("parens"), _depth("[", "]").alias("brackets"),
        F.lag("src").over(_unit()).alias("prev"), F.lead("src").over(_unit()).alias("next"), F.lag("cls").over(_unit()).alias("prev_cls"),
    )


def parse_status(units: DataFrame) -> DataFrame:
    """(unit_id, ok, code, pos): the first lexical error or unbalanced bracket of each unit; bad input is data, not an exception."""
    found = tokens(units)
    header = F.col("dir_id").isNotNull() & F.col("prev").isin("include", "include_next", "embed") & ((F.col("src") == "<") | (F.col("cls") == "error") & (F.col("src") == '"'))
    code = F.when(header, "unterminated_header_name").when(F.col("cls") == "open_comment", "unterminated_comment").when(F.col("cls") == "error", F.when(F.col("src") == '"', "unterminated_string").when(F.col("src") == "'", "unterminated_char").otherwise("unexpected_character"))
    errors = found.where(code.isNotNull()).groupBy("unit_id").agg(F.min(F.struct(F.col("start").alias("pos"), code.alias("code"))).alias("error"))
    step = lambda a, b: F.sum(F.when(F.col("src") == a, 1).when(F.col("src") == b, -1).otherwise(0))
    code_tokens = found.where(F.col("dir_id").isNull())
    sums = code_tokens.groupBy("unit_id").agg(step("{", "}").alias("b"), step("(", ")").alias("p"), step("[", "]").alias("k"), F.min(F.least("braces", "parens", "brackets")).alias("low"))
    odd = (F.coalesce("b", F.lit(0)) != 0) | (F.coalesce("p", F.lit(0)) != 0) | (F.coalesce("k", F.lit(0)) != 0) | (F.coalesce("low", F.lit(0)) < 0)
    all_units = units.select("unit_id").join(errors, "unit_id", "left").join(sums, "unit_id", "left")
    return all_units.select("unit_id", (F.col("error").isNull() & ~odd).alias("ok"), F.coalesce("error.code", F.when(odd, "unbalanced_brackets")).alias("code"), F.col("error.pos").alias("pos"))

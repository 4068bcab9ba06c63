"""What stands inside brackets: conditions, type names, array sizes, asm operands, and the words before declarators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..blocks.facade import F, Window
from ..functions import c_tokens as C
from .declarations import in_declaration, symbols


def with_close(marked: DataFrame, opening: str, closing: str, depth: str) -> DataFrame:
    """close_ix on each opening bracket: at one depth of a declaration, opening and closing brackets alternate."""
    level = Window.partitionBy("unit_id", "decl_ix", depth, F.col("src").isin(opening, closing)).orderBy("tok_ix")
    return marked.withColumn("close_ix", F.when((F.col("src") == opening) & F.col("dir_id").isNull(), F.lead("tok_ix").over(level)))


def _spelled(grouped, *extra: Column) -> DataFrame:
    return grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_ix", "src"))), lambda t: t["src"]), " ").alias("text"), *extra)


def conditions(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, word, place, text) of if, while, switch and for: place 0 holds the condition; a for has places 0 to 2."""
    words = ("if", "while", "switch", "for")
    own = with_close(marked, "(", ")", "parens").where("in_body AND dir_id IS NULL")
    close = F.lead("close_ix").over(in_declaration())
    head = F.last(F.when(F.col("src").isin(*words) & (F.col("next") == "("), F.struct("tok_ix", F.col("src").alias("word"), close.alias("close"), "parens")), ignorenulls=True).over(in_declaration().rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_head", F.lag(head, 0).over(in_declaration())).where("_head IS NOT NULL AND tok_ix > _head.tok_ix + 1 AND tok_ix < _head.close")
    mark = (F.col("src") == ";") & (F.col("parens") == F.col("_head.parens") + 1)
    group = Window.partitionBy("unit_id", "decl_ix", "_head.tok_ix").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("place", F.sum(mark.cast("int")).over(group)).where(~mark)
    return _spelled(own.groupBy("unit_id", "decl_ix", F.col("_head.tok_ix").alias("head_ix"), F.col("_head.word").alias("word"), F.col("place").cast("long").alias("place")))


def type_names(marked: DataFrame) -> DataFrame:
    """Type names in brackets: casts, compound literals, and operands of sizeof and alignof. Needs identifiers told apart."""
    measure = ("sizeof", "alignof", "_Alignof", "__alignof", "__alignof__")
    own = with_close(marked, "(", ")", "parens").withColumn("_type", F.col("next").isin(*C.TYPE_WORDS, *C.QUALIFIERS) | (F.lead("tname").over(in_declaration()) == "TYPEDEF_NAME"))
    after = Window.partitionBy("unit_id", "decl_ix").orderBy("tok_ix")
    opens = (F.col("src") == "(") & F.col("_type") & F.col("close_ix").isNotNull() & (F.col("in_body") | F.col("in_value")) & ~(F.lag("tname").over(after).isin("ID", "MACRO_NAME") | F.col("prev").isin(")", "]", "for"))
    head = F.last(F.when(opens, F.struct("tok_ix", "close_ix", "prev")), ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumns({"_head": head, "_opens": opens}).where("_head IS NOT NULL AND tok_ix > _head.tok_ix AND tok_ix <= _head.close_ix AND dir_id IS NULL")
    last = F.col("tok_ix") == F.col("_head.close_ix")
    rows = own.groupBy("unit_id", "decl_ix", F.col("_head.tok_ix").alias("open_ix"), F.col("_head.prev").alias("_before")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~last, F.struct("tok_ix", "src")))), lambda t: t["src"]), " ").alias("type_name"), F.max(F.when(last, F.col("next"))).alias("_after")
    )
    kind = F.when(F.col("_before").isin(*measure), F.concat(F.lit("operand of "), F.col("_before"))).when(F.col("_after") == "{", "compound_literal").otherwise("cast")
    return rows.select("unit_id", "decl_ix", "open_ix", kind.alias("kind"), "type_name")


def array_sizes(marked: DataFrame) -> DataFrame:
    """Array brackets of file-scope declarators: their ordinal after the name, and what is in them."""
    named = symbols(marked).select("unit_id", "decl_ix", "part", "name", F.col("tok_ix").alias("name_ix"))
    own = with_close(marked.where("dir_id IS NULL AND NOT in_body AND NOT in_attribute AND NOT in_value AND braces = 0 AND parens = 0"), "[", "]", "brackets").join(named, ["unit_id", "decl_ix", "part"]).where("tok_ix > name_ix")
    order = Window.partitionBy("unit_id", "decl_ix", "part").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("src") == "[") & (F.col("brackets") == 0)
    own = own.withColumns({"ordinal": F.sum(opens.cast("int")).over(order) - 1, "_close": F.last(F.when(opens, F.col("close_ix")), ignorenulls=True).over(order)}).where("ordinal >= 0 AND tok_ix <= _close")
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~opens & (F.col("tok_ix") < F.col("_close")), F.struct("tok_ix", "src")))), lambda t: t["src"]), " ")
    return own.groupBy("unit_id", "decl_ix", "part", "name", F.col("ordinal").cast("long").alias("ordinal")).agg(inside.alias("size"))


def specifiers(marked: DataFrame) -> DataFrame:
    """Words before the first declarator of each file-scope declaration, in order, with their role."""
    first = symbols(marked).groupBy("unit_id", "decl_ix").agg(F.min("tok_ix").alias("name_ix"))
    own = marked.where("dir_id IS NULL AND NOT in_attribute AND NOT in_body AND braces = 0 AND parens = 0 AND brackets = 0 AND part = 0").join(first, ["unit_id", "decl_ix"], "left").where("name_ix IS NULL OR tok_ix < name_ix")
    role = F.when(F.col("src").isin(*C.STORAGE), "storage").when(F.col("src").isin(*C.QUALIFIERS), "qualifier").when(F.col("src").isin(*C.FUNCTION_SPECIFIERS), "function").when(F.col("src").isin(*C.TYPE_WORDS), "type").when(F.col("tname") == "TYPEDEF_NAME", "typedef_name").when(F.col("prev").isin("struct", "union", "enum") & (F.col("tname") == "ID"), "tag")
    own = own.withColumn("role", role).where("role IS NOT NULL")
    return own.select("unit_id", "decl_ix", (F.row_number().over(in_declaration()) - 1).cast("long").alias("ordinal"), F.col("src").alias("word"), "role")


def member_uses(marked: DataFrame) -> DataFrame:
    """Accesses by . and ->: the word before, the operator, the member."""
    own = marked.where("dir_id IS NULL").withColumn("_after", F.lag("tname").over(in_declaration()).isin("ID", "MACRO_NAME") | F.col("prev").isin(")", "]"))
    return own.where("(in_body OR in_value) AND _after").where(F.col("src").isin(".", "->")).select("unit_id", "decl_ix", "tok_ix", F.col("prev").alias("object"), F.col("src").alias("op"), F.col("next").alias("member_name"))


def asm_operands(marked: DataFrame) -> DataFrame:
    """Operands and clobbers of asm blocks: section (1 outputs, 2 inputs, 3 clobbers, 4 labels), ordinal, constraint, value."""
    own = marked.where("dir_id IS NULL").withColumn("_asm", F.last(F.when(F.col("src").isin(*C.ASM_WORDS), F.struct("tok_ix", "parens")), ignorenulls=True).over(in_declaration().rowsBetween(Window.unboundedPreceding, 0)))
    block = Window.partitionBy("unit_id", "decl_ix", "_asm.tok_ix").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    over = F.max(((F.col("src") == ";") & (F.col("parens") == F.col("_asm.parens"))).cast("int")).over(block)
    own = own.where("_asm IS NOT NULL").withColumn("_over", over).where("_over = 0 AND parens > _asm.parens")
    direct = F.col("parens") == F.col("_asm.parens") + 1
    colon, comma = (F.col("src") == ":") & direct, (F.col("src") == ",") & direct
    own = own.withColumn("section", F.sum(colon.cast("int")).over(block))
    part = Window.partitionBy("unit_id", "decl_ix", "_asm.tok_ix", "section").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("ordinal", F.sum(comma.cast("int")).over(part)).where(~colon & ~comma & (F.col("section") > 0))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("tok_ix", "src")))), lambda t: t["src"]), " ")
    # A name in square brackets stands before the constraint.
    label = direct & (F.col("src").isin("[", "]") | (F.col("brackets") > 0))
    value = ~(direct & (F.col("cls") == "string")) & ~(F.col("src").isin("(", ")") & direct) & ~label
    name = F.max(F.when(label & ~F.col("src").isin("[", "]"), F.col("src"))).alias("operand_name")
    rows = own.groupBy("unit_id", "decl_ix", F.col("_asm.tok_ix").alias("asm_ix"), "section", "ordinal").agg(name, F.max(F.when(direct & (F.col("cls") == "string"), F.col("src"))).alias("constraint"), joined(value).alias("value"))
    return rows.withColumns({"section": F.col("section").cast("long"), "ordinal": F.col("ordinal").cast("long")})

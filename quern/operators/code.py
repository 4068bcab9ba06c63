"""Statements, expressions and annotations inside declarations, from windows over the tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..blocks.facade import F, Window
from ..functions import c_tokens as C
from .declarations import in_declaration, symbols

_OPERANDS = ("LIT_INT", "LIT_FLOAT", "LIT_CHAR", "LIT_STRING", "ID", "TYPEDEF_NAME", "MACRO_NAME")


def functions(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, function) of each function definition."""
    return symbols(marked).where("decl_kind = 'function_definition' AND part = 0").select("unit_id", "decl_ix", F.col("name").alias("function"))


def statements(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, kind, depth) of each statement that a word or a brace begins in a function body."""
    word = {
        "if": "if_statement", "while": "while_statement", "do": "do_statement", "switch": "switch_statement", "for": "for_statement",
        "case": "labeled_statement", "default": "labeled_statement", "return": "jump_statement", "break": "jump_statement", "continue": "jump_statement", "goto": "jump_statement",
        **dict.fromkeys(C.ASM_WORDS, "asm_statement"),
    }
    named = F.create_map(*[F.lit(x) for pair in word.items() for x in pair])
    begins = F.coalesce(F.col("prev"), F.lit(";")).isin(";", "{", "}", ")", ":", "else", "do")
    label = (F.col("tname") == "ID") & (F.col("next") == ":") & begins
    # The while of a do statement follows its body: a closing brace or a semicolon whose do is open at that depth.
    level = Window.partitionBy("unit_id", "decl_ix", "braces").orderBy("tok_ix")
    last = F.last(F.when(F.col("src").isin("do", "while"), F.col("src")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, -1))
    own = marked.where("dir_id IS NULL").withColumn("_tail", (F.col("src") == "while") & (F.coalesce(last, F.lit("")) == "do")).where("in_body")
    kind = F.when(F.col("_tail"), None).when(label, "labeled_statement").when((F.col("src") == "{") & begins & ~(F.col("prev") == "="), "compound_statement").otherwise(named[F.col("src")])
    return own.withColumn("kind", kind).where("kind IS NOT NULL AND parens = 0").select("unit_id", "decl_ix", "tok_ix", "kind", F.col("src").alias("word"), F.col("braces").alias("depth"))


def jumps(marked: DataFrame) -> DataFrame:
    """Jump statements: kind, and the label of a goto."""
    return marked.where("in_body AND dir_id IS NULL").where(F.col("src").isin("return", "break", "continue", "goto")).select("unit_id", "decl_ix", "tok_ix", F.col("src").alias("jump_kind"), F.when(F.col("src") == "goto", F.col("next")).alias("label_name"))


def labels(marked: DataFrame) -> DataFrame:
    """Labels: case (with its whole value, of a range too), default, and named ones."""
    own = marked.where("dir_id IS NULL AND in_body")
    named = (F.col("tname") == "ID") & (F.col("next") == ":") & F.col("prev").isin(";", "{", "}", ")", ":")
    kind = F.when(F.col("src") == "case", "case").when((F.col("src") == "default") & (F.col("next") == ":"), "default").when(named, "identifier")
    own = own.withColumn("_kind", kind)
    so_far = in_declaration().rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_head", F.last(F.when(F.col("_kind").isNotNull(), F.struct("tok_ix", "parens", "_kind")), ignorenulls=True).over(so_far))
    # The colon that ends a value is the one without a question mark of its own.
    step = F.when(F.col("parens") == F.col("_head.parens"), F.when(F.col("src") == ":", 1).when(F.col("src") == "?", -1).otherwise(0)).otherwise(0)
    own = own.where("_head IS NOT NULL").withColumn("_ends", F.sum(step).over(Window.partitionBy("unit_id", "decl_ix", "_head.tok_ix").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)))
    done = F.max((F.col("_ends") > 0).cast("int")).over(Window.partitionBy("unit_id", "decl_ix", "_head.tok_ix").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_done", done).where(F.col("_kind").isNotNull() | (F.col("_head._kind") == "case") & (F.col("_done") == 0))
    value = (F.col("_head._kind") == "case") & F.col("_kind").isNull()
    rows = own.groupBy("unit_id", "decl_ix", F.col("_head.tok_ix").alias("tok_ix"), F.col("_head._kind").alias("label_kind")).agg(
        F.array_sort(F.collect_list(F.when(value, F.struct("tok_ix", "src")))).alias("words"), F.max(F.when(F.col("_kind") == "identifier", F.col("src"))).alias("name")
    )
    name = F.when(F.col("label_kind") == "case", F.array_join(F.transform("words", lambda t: t["src"]), " ")).otherwise(F.col("name"))
    return rows.select("unit_id", "decl_ix", "tok_ix", "label_kind", name.alias("label_name"))


def _after_operand() -> Column:
    """Whether an operand ends just before a token; this tells binary from prefix operators."""
    return F.lag("tname").over(in_declaration()).isin(*_OPERANDS) | F.col("prev").isin(")", "]") | F.lag("tname").over(in_declaration()).isin("KW_TRUE", "KW_FALSE", "KW_NULLPTR")


def operators(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, part, tok_ix, op, kind, precedence, depth) of each operator in a body or an initialiser, but commas: see comma_operators()."""
    own = marked.where("dir_id IS NULL AND NOT in_attribute").withColumn("_binary", _after_operand()).where("in_body OR in_value")
    strength = F.create_map(*[F.lit(x) for pair in C.PRECEDENCE.items() for x in pair])
    pure = F.col("src").isin("++", "--", "!", "~", "sizeof") | F.col("src").isin("alignof", "_Alignof", "__alignof", "__alignof__") & (F.col("next") != "(")
    binary = F.col("src").isin(*[o for o in C.PRECEDENCE if o != ","]) & F.col("_binary")
    prefix = F.col("src").isin("+", "-", "*", "&") & ~F.col("_binary") | pure
    kind = F.when(F.col("src") == "?", "conditional_expression").when(binary & (strength[F.col("src")] == 2), "assignment_expression").when(binary, "binary_expression").when(F.col("src").isin("++", "--") & F.col("_binary"), "postfix_unary_expression").when(prefix, "unary_expression").when(F.col("src").isin(".", "->") & F.col("_binary"), "member_expression")
    rows = own.withColumn("kind", kind).where("kind IS NOT NULL")
    return rows.select("unit_id", "decl_ix", "part", "tok_ix", F.col("src").alias("op"), "kind", F.when(F.col("kind").isin("binary_expression", "assignment_expression", "conditional_expression"), strength[F.col("src")]).alias("precedence"), (F.col("parens") + F.col("brackets")).alias("depth"))


def root_operators(marked: DataFrame) -> DataFrame:
    """The operator at the root of each file-scope initialiser: the weakest outside brackets; the last of its strength, or the first of those that group from the right."""
    own = operators(marked).where("precedence IS NOT NULL AND depth = 0").join(marked.where("in_value").select("unit_id", "tok_ix"), ["unit_id", "tok_ix"])
    place = F.when(F.col("precedence").isin(*C.RIGHT_TO_LEFT), F.col("tok_ix")).otherwise(-F.col("tok_ix"))
    return own.groupBy("unit_id", "decl_ix", "part").agg(F.min(F.struct("precedence", place.alias("place"), "op", "kind")).alias("x")).select("unit_id", "decl_ix", "part", "x.op", "x.kind")


def literals(marked: DataFrame) -> DataFrame:
    """Literals and the constants true, false and nullptr outside directives; strings that touch are one literal of joined spelling."""
    own = marked.where("dir_id IS NULL AND (tname LIKE 'LIT_%' OR tname IN ('KW_TRUE', 'KW_FALSE', 'KW_NULLPTR'))").withColumn("_first", ~((F.col("tname") == "LIT_STRING") & (F.col("prev_cls") == "string")))
    own = own.withColumn("_group", F.sum(F.col("_first").cast("int")).over(Window.partitionBy("unit_id").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)))
    rows = own.groupBy("unit_id", "_group").agg(F.min("tok_ix").alias("tok_ix"), F.first("tname").alias("literal_kind"), F.array_sort(F.collect_list(F.struct("tok_ix", "src"))).alias("x"))
    return rows.select("unit_id", "tok_ix", "literal_kind", F.array_join(F.transform("x", lambda t: t["src"]), "").alias("value"))


def attributes(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, attribute_form, attribute_prefix, attribute_name, has_arguments, arguments) of each attribute."""
    own = marked.where("in_attribute AND dir_id IS NULL")
    whole = Window.partitionBy("unit_id", "decl_ix", "attr_ix").orderBy("tok_ix")
    first, base = F.first("src").over(whole), F.first("parens").over(whole)
    form = F.when(first.isin(*C.GCC_ATTRIBUTE), "gcc").when(first.isin(*C.MSVC_ATTRIBUTE), "msvc").otherwise("c23")
    own = own.withColumns({"attribute_form": form, "_depth": F.col("parens") - base, "_two": F.lag("src", 2).over(in_declaration()), "_three": F.lag("src", 3).over(in_declaration())})
    inside = F.when(form == "gcc", F.col("_depth") == 2).when(form == "msvc", F.col("_depth") == 1).otherwise(F.col("_depth") == 0)
    scoped = (F.col("prev") == ":") & (F.col("_two") == ":")
    name = F.col("tname").isin("ID", "TYPEDEF_NAME", "MACRO_NAME") | F.col("tname").startswith("KW_")
    named = inside & (F.col("prev").isin("(", ",", "[") | scoped) & name & ~F.coalesce(F.col("next") == ":", F.lit(False))
    own = own.withColumns({"_named": F.coalesce(named, F.lit(False)), "_scoped": scoped})
    # What is deeper than a name, up to the next name, is in its brackets.
    own = own.withColumn("_name", F.last(F.when(F.col("_named"), F.struct("tok_ix", "_depth")), ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    rows = own.where("_name IS NOT NULL").groupBy("unit_id", "decl_ix", F.col("_name.tok_ix").alias("tok_ix"), "attribute_form").agg(
        F.max(F.when(F.col("_named"), F.struct(F.when(F.col("_scoped"), F.col("_three")).alias("prefix"), "src", (F.col("next") == "(").alias("has")))).alias("x"),
        F.array_sort(F.collect_list(F.when(F.col("_depth") > F.col("_name._depth"), F.struct("tok_ix", "src")))).alias("words"),
    )
    text = F.when(F.col("x.has"), F.array_join(F.transform("words", lambda t: t["src"]), " "))
    return rows.select("unit_id", "decl_ix", "tok_ix", "attribute_form", F.col("x.prefix").alias("attribute_prefix"), F.col("x.src").alias("attribute_name"), F.col("x.has").alias("has_arguments"), text.alias("arguments"))


def initializer_items(marked: DataFrame) -> DataFrame:
    """Items of brace initialisers at file scope: ordinal in their list, designator (.name and [index] in as many steps as it has) or null."""
    own = marked.where("dir_id IS NULL AND in_value AND NOT in_body")
    so_far = Window.partitionBy("unit_id", "decl_ix", "part").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_inner", F.col("braces") + (F.col("src") == "{").cast("int"))
    list_ix = F.last(F.when(F.col("src") == "{", F.col("tok_ix")), ignorenulls=True).over(Window.partitionBy("unit_id", "decl_ix", "part", "_inner").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0))
    begins = ((F.col("src") == "{") & (F.col("next") != "}")) | ((F.col("src") == ",") & (F.col("parens") == 0) & (F.col("brackets") == 0) & (F.col("next") != "}") & (F.col("braces") > 0))
    own = own.withColumns({"list_ix": list_ix, "_begins": begins})
    own = own.withColumn("_item", F.last(F.when(F.col("_begins"), F.struct("tok_ix", "next", "list_ix")), ignorenulls=True).over(so_far)).where("_item IS NOT NULL")
    value = F.max(((F.col("src") == "=") & (F.col("parens") == 0) & (F.col("brackets") == 0)).cast("int")).over(Window.partitionBy("unit_id", "decl_ix", "part", "_item.tok_ix").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_step", F.col("_item.next").isin(".", "[") & (value == 0) & ~F.col("_begins"))
    rows = own.where("_begins OR _step").groupBy("unit_id", "decl_ix", "part", F.col("_item.list_ix").alias("list_ix"), F.col("_item.tok_ix").alias("tok_ix")).agg(F.array_sort(F.collect_list(F.when(F.col("_step"), F.struct("tok_ix", "src")))).alias("words"))
    ordinal = F.row_number().over(Window.partitionBy("unit_id", "decl_ix", "part", "list_ix").orderBy("tok_ix")) - 1
    return rows.select("unit_id", "decl_ix", "part", "list_ix", ordinal.cast("long").alias("ordinal"), F.when(F.size("words") > 0, F.array_join(F.transform("words", lambda t: t["src"]), "")).alias("designator"))


def generic_associations(marked: DataFrame) -> DataFrame:
    """Associations of _Generic selections: kind (type or default) and the words before the colon."""
    own = marked.where("dir_id IS NULL").withColumn("_sel", F.last(F.when(F.col("src") == "_Generic", F.struct("tok_ix", "parens")), ignorenulls=True).over(in_declaration().rowsBetween(Window.unboundedPreceding, 0)))
    own = own.where("_sel IS NOT NULL AND parens = _sel.parens + 1")
    sel = Window.partitionBy("unit_id", "decl_ix", "_sel.tok_ix").orderBy("tok_ix")
    own = own.withColumn("_arm", F.sum((F.col("src") == ",").cast("int")).over(sel.rowsBetween(Window.unboundedPreceding, 0)))
    arm = Window.partitionBy("unit_id", "decl_ix", "_sel.tok_ix", "_arm").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_value", F.max((F.col("src") == ":").cast("int")).over(arm)).where("_arm > 0 AND _value = 0 AND src <> ','")
    rows = own.groupBy("unit_id", "decl_ix", F.col("_sel.tok_ix").alias("generic_ix"), "_arm").agg(F.array_sort(F.collect_list(F.struct("tok_ix", "src"))).alias("x"))
    text = F.array_join(F.transform("x", lambda t: t["src"]), " ")
    return rows.select("unit_id", "decl_ix", "generic_ix", F.col("_arm").cast("long").alias("ordinal"), F.when(text == "default", "default").otherwise("type").alias("association_kind"), text.alias("type_name"))


def asm_blocks(marked: DataFrame) -> DataFrame:
    """Asm statements and declarations: qualifiers, and the template's strings joined."""
    own = marked.where("dir_id IS NULL").withColumn("_asm", F.last(F.when(F.col("src").isin(*C.ASM_WORDS), F.struct("tok_ix", "parens")), ignorenulls=True).over(in_declaration().rowsBetween(Window.unboundedPreceding, 0))).where("_asm IS NOT NULL")
    block = Window.partitionBy("unit_id", "decl_ix", "_asm.tok_ix").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    colons = F.sum(((F.col("src") == ":") & (F.col("parens") == F.col("_asm.parens") + 1)).cast("int")).over(block)
    over = F.max(((F.col("src") == ";") & (F.col("parens") == F.col("_asm.parens"))).cast("int")).over(block)
    own = own.withColumns({"_section": colons, "_over": over}).where("_over = 0")
    inner = F.col("parens") == F.col("_asm.parens") + 1
    return own.groupBy("unit_id", "decl_ix", F.col("_asm.tok_ix").alias("asm_ix")).agg(
        F.array_sort(F.collect_set(F.when((F.col("parens") == F.col("_asm.parens")) & F.col("src").isin("volatile", "__volatile__", "inline", "goto"), F.col("src")))).alias("qualifiers"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("_section") == 0) & inner & (F.col("tname") == "LIT_STRING"), F.struct("tok_ix", "src")))), lambda t: t["src"]), "").alias("template"),
        F.max(F.when(inner, F.col("_section"))).cast("long").alias("n_sections"),
    )

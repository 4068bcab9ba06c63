"""What stands inside bodies and brackets: local declarations, expression statements, calls, subscripts, commas, qualifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec

from ..blocks.facade import F, Window
from ..functions import c_tokens as C
from .declarations import _is_name, _shape, in_declaration, symbols, without_attributes

_CONTROL = ("if", "while", "for", "switch")
_BOUNDARY = (";", "{", "}")
_NAMES = ("ID", "MACRO_NAME")


def _so_far(*keys: str) -> WindowSpec:
    return Window.partitionBy("unit_id", "decl_ix", *keys).orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)


def _earlier(*keys: str) -> WindowSpec:
    return Window.partitionBy("unit_id", "decl_ix", *keys).orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, -1)


def _spelled(words: str | Column, sep: str = " ") -> Column:
    return F.array_join(F.transform(words, lambda w: w["src"]), sep)


def _words(which: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(which, F.struct("tok_ix", "src"))))


def _with_opener(cut: DataFrame, bracket: str, depth: str, name: str) -> DataFrame:
    """`name`: the token that opens the bracket which directly holds each token; null outside such brackets. An opening one counts as held by itself."""
    opener = F.struct("tok_ix", "prev", "prev_t", "parens", "brackets", "braces", F.col("before.prev").alias("head"))
    opens = F.col("src") == bracket
    cut = cut.withColumn("_level", F.col(depth) + opens.cast("int"))
    return cut.withColumn(name, F.last(F.when(opens, opener), ignorenulls=True).over(_so_far("_level"))).drop("_level")


def _code(marked: DataFrame) -> DataFrame:
    """Tokens of code with prev_t, and before: for a token after a closing parenthesis, what stands around the opening one."""
    own = without_attributes(marked).withColumn("prev_t", F.lag("tname").over(in_declaration()))
    level = Window.partitionBy("unit_id", "decl_ix", "parens", F.col("src").isin("(", ")")).orderBy("tok_ix")
    inner_type = F.col("next").isin(*C.TYPE_WORDS, *C.QUALIFIERS) | (F.lead("tname").over(in_declaration()) == "TYPEDEF_NAME")
    own = own.withColumn("_typed", F.coalesce(inner_type, F.lit(False)))
    mate = F.when(F.col("src") == ")", F.lag(F.struct("tok_ix", "prev", "prev_t", "_typed")).over(level))
    own = own.withColumn("_mate", mate)
    return own.withColumn("before", F.lag("_mate").over(in_declaration())).drop("_mate", "_typed")


def with_items(marked: DataFrame) -> DataFrame:
    """Tokens of code with the local declaration that holds them.

    item_ix: its first token, null outside; item_part, item_value as at file scope; at_item: outside
    brackets within it; brace, block: the brace that directly holds a token, and whether it is a block's;
    in_block: directly in a block, outside other brackets. Tokens that have these columns stay as they are.
    """
    if "item_ix" in marked.columns:
        return marked
    own = _with_opener(_code(marked), "{", "braces", "brace")
    # After a closing parenthesis a brace is a block where that belongs to a control word, or is the body itself; else it holds a literal.
    is_block = F.col("brace.prev").isin(";", "{", "}", ":", "else", "do", "(") | (F.col("brace.prev") == ")") & (F.col("brace.head").isin(*_CONTROL) | (F.col("brace.braces") == 0))
    own = own.withColumn("block", F.coalesce(is_block, F.lit(False)))
    own = own.withColumn("in_block", F.coalesce(F.col("in_body") & F.col("block") & (F.col("parens") == F.col("brace.parens")) & (F.col("brackets") == F.col("brace.brackets")), F.lit(False)))
    old_style = F.col("in_body") & (F.col("braces") == 0) & (F.col("parens") == 0) & F.col("prev").isin(")", ";")
    for_init = F.col("in_body") & (F.col("prev") == "(") & (F.lag("src", 2).over(in_declaration()) == "for")
    place = F.col("in_block") & F.col("prev").isin(";", "{", "}", ":") | old_style | for_init
    word = F.col("src").isin(*C.DECLARATION_STARTS) | (F.col("tname") == "TYPEDEF_NAME") | (F.col("tname") == "ID") & (F.lead("tname").over(in_declaration()) == "ID")
    own = own.withColumn("_starts", F.coalesce(place & word, F.lit(False)))
    own = own.withColumn("_item", F.last(F.when(F.col("_starts"), F.struct("tok_ix", "braces", "parens", "brackets")), ignorenulls=True).over(_so_far()))
    level = (F.col("braces") == F.col("_item.braces")) & (F.col("parens") == F.col("_item.parens")) & (F.col("brackets") == F.col("_item.brackets"))
    own = own.withColumns({"_at": F.col("_item.tok_ix"), "_level": F.coalesce(level, F.lit(False))})
    over = F.max((F.col("_level") & (F.col("src") == ";")).cast("int")).over(_earlier("_at"))
    own = own.withColumn("item_ix", F.when(F.coalesce(over, F.lit(0)) == 0, F.col("_at")))
    own = own.withColumn("at_item", F.col("item_ix").isNotNull() & F.col("_level"))
    comma = (F.col("at_item") & (F.col("src") == ",")).cast("int")
    own = own.withColumn("item_part", F.coalesce(F.sum(comma).over(_earlier("item_ix")), F.lit(0)))
    value = F.max((F.col("at_item") & (F.col("src") == "=")).cast("int")).over(_earlier("item_ix", "item_part"))
    return own.withColumn("item_value", F.coalesce(value == 1, F.lit(False))).drop("_starts", "_at", "_level")


def local_symbols(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, item_ix, part, name, tok_ix, storage, shape, pointer_depth) of each declarator in a body, in the head of a for, or among old-style parameters."""
    follow = (";", ",", "=", "[", "(", ")", ":", *C.ATTRIBUTE_OPENERS, *C.ASM_WORDS)
    own = with_items(marked).where("item_ix IS NOT NULL AND NOT item_value AND braces = _item.braces AND brackets = _item.brackets")
    own = own.withColumns({"next2": F.lead("src", 2).over(in_declaration()), "parens": F.col("parens") - F.col("_item.parens")})
    storage = F.first(F.when(F.col("src").isin(*C.STORAGE), F.col("src")), ignorenulls=True).over(Window.partitionBy("unit_id", "decl_ix", "item_ix"))
    rows = own.withColumn("storage", storage).groupBy("unit_id", "decl_ix", "item_ix", F.col("item_part").alias("part")).agg(
        F.min(F.when(_is_name(follow) & (F.col("tok_ix") > F.col("item_ix")), F.struct("tok_ix", "src", "next", "next2", "parens"))).alias("x"),
        F.collect_list(F.when(F.col("src") == "*", F.struct("tok_ix", "parens"))).alias("stars"), F.max("storage").alias("storage"),
    ).where("x IS NOT NULL")
    pointers = F.size(F.filter("stars", lambda t: t["tok_ix"] < F.col("x.tok_ix")))
    return rows.select("unit_id", "decl_ix", "item_ix", "part", F.col("x.src").alias("name"), F.col("x.tok_ix").alias("tok_ix"), "storage", _shape().alias("shape"), pointers.alias("pointer_depth"))


def calls(marked: DataFrame) -> DataFrame:
    """(unit_id, caller, callee, callee_kind, is_macro, n_args) of each call in a function body or an initialiser.

    callee_kind: name or member, with the name; else null is the name, and the callee is a call, a
    subscript, or indirect: an expression in brackets that is no type.
    """
    own = _code(marked).withColumn("prev2", F.lag("src", 2).over(in_declaration()))
    of_mate = (
        F.when(F.col("before.prev_t").isin(*_NAMES) | F.col("before.prev").isin(")", "]"), "call").when(F.col("before._typed") | F.col("before.prev_t").startswith("KW_"), None).otherwise("indirect")
    )
    kind = F.when(F.col("prev_t").isin(*_NAMES), F.when(F.col("prev2").isin(".", "->"), "member").otherwise("name")).when(F.col("prev") == "]", "subscript").when(F.col("prev") == ")", of_mate)
    own = own.withColumn("_kind", F.when((F.col("in_body") | F.col("in_value")) & (F.col("src") == "("), kind))
    # Tokens directly in a bracket belong to the last bracket that was opened at their level.
    own = own.withColumn("_level", F.col("parens") + F.col("src").isin("(", ")").cast("int"))
    own = own.withColumn("_open", F.last(F.when(F.col("src") == "(", F.struct("tok_ix", "brackets", "braces")), ignorenulls=True).over(_so_far("_level")))
    comma = (F.col("src") == ",") & (F.col("brackets") == F.col("_open.brackets")) & (F.col("braces") == F.col("_open.braces"))
    rows = own.where("_open IS NOT NULL").groupBy("unit_id", "decl_ix", "_open.tok_ix").agg(
        F.max(F.when(F.col("src") == "(", F.struct("_kind", F.when(F.col("_kind").isin("name", "member"), F.col("prev")).alias("callee"), (F.col("prev_t") == "MACRO_NAME").alias("is_macro"), (F.col("next") == ")").alias("empty")))).alias("x"),
        F.count_if(comma).alias("commas"),
    ).where("x._kind IS NOT NULL")
    named = symbols(marked).where("decl_kind = 'function_definition' AND part = 0").select("unit_id", "decl_ix", F.col("name").alias("caller"))
    n_args = F.when(F.col("x.empty"), 0).otherwise(F.col("commas") + 1).cast("long")
    return rows.join(named, ["unit_id", "decl_ix"], "left").select("unit_id", "caller", "x.callee", F.col("x._kind").alias("callee_kind"), F.coalesce("x.is_macro", F.lit(False)).alias("is_macro"), n_args.alias("n_args"))


def subscripts(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, object, index) of each subscript in a body or a value: the word before it, and what is in it. Sizes of arrays and designators are none."""
    own = with_items(marked).withColumns({"prev2": F.lag("src", 2).over(in_declaration()), "prev3": F.lag("src", 3).over(in_declaration())})
    operand = F.col("prev_t").isin(*_NAMES, "LIT_STRING") | F.col("prev").isin(")", "]")
    declares = F.col("at_item") & ~F.col("item_value")
    # The brackets after a first .name or [index] of an initialiser are designators; so are those that touch them.
    chain = F.col("src").isin("[", "]", ".") | F.col("prev").isin("[", ".")
    list_start = F.col("prev").isin("{", ",") & F.col("src").isin(".", "[") & (F.col("brace.tok_ix").isNotNull())
    own = own.withColumn("_mark", F.when(list_start, "designator").when(F.col("src") == "=", "value").when(F.col("src") == ",", "value"))
    state = F.last("_mark", ignorenulls=True).over(_so_far())
    own = own.withColumn("_subscript", F.coalesce((F.col("src") == "[") & operand & (F.col("in_body") | F.col("in_value")) & ~declares & ~F.coalesce((state == "designator") & (F.col("brackets") == 0), F.lit(False)), F.lit(False)))
    own = own.withColumn("_levels", F.sequence(F.lit(1).cast("long"), F.col("brackets") + (F.col("src") == "[").cast("int"))).where(F.col("brackets") + (F.col("src") == "[").cast("int") > 0)
    # A token is in every bracket around it; an opening one marks its own level.
    cut = own.select("unit_id", "decl_ix", "tok_ix", "src", "prev", "brackets", "_subscript", F.explode("_levels").alias("_level"))
    marks = (F.col("src") == "[") & (F.col("_level") == F.col("brackets") + 1)
    cut = cut.withColumns({"_marks": marks, "_open": F.last(F.when(marks, F.struct("tok_ix", "prev", "_subscript")), ignorenulls=True).over(_so_far("_level"))})
    rows = cut.where("_open._subscript").groupBy("unit_id", "decl_ix", F.col("_open.tok_ix").alias("tok_ix"), F.col("_open.prev").alias("object")).agg(_words(~F.col("_marks")).alias("words"))
    return rows.select("unit_id", "decl_ix", "tok_ix", "object", _spelled("words").alias("index"))


def comma_operators(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, depth) of each comma that is an operator: in a subscript, in brackets that are no list, or between the expressions of a statement."""
    own = _with_opener(_with_opener(with_items(marked), "(", "parens", "paren"), "[", "brackets", "bracket")
    at = lambda name: F.coalesce(F.col(f"{name}.tok_ix"), F.lit(-1).cast("long"))
    innermost = F.greatest(at("paren"), at("bracket"), at("brace"))
    keyword = F.col("paren.prev").isin(*_CONTROL, "return", "case", "do", "else")
    grouping = keyword | ~(F.col("paren.prev_t").isin("ID", "MACRO_NAME", "TYPEDEF_NAME") | F.col("paren.prev_t").startswith("KW_") | F.col("paren.prev").isin(")", "]"))
    separates = F.col("at_item")
    inside = F.when(innermost == at("bracket"), F.lit(True)).when(innermost == at("paren"), grouping & ~separates).otherwise(F.col("in_block") & ~separates)
    own = own.where("in_body OR in_value").where((F.col("src") == ",") & (innermost >= 0))
    # A list in braces is no block: it has no semicolon of its own, as every block with a comma has.
    ends = with_items(marked).where("src = ';' AND brace IS NOT NULL").select("unit_id", "decl_ix", F.col("brace.tok_ix").alias("_brace")).distinct()
    own = own.withColumns({"_inside": inside, "_in_brace": innermost == at("brace"), "_brace": F.col("brace.tok_ix")}).where("_inside")
    return own.join(ends.withColumn("_ends", F.lit(True)), ["unit_id", "decl_ix", "_brace"], "left").where("NOT _in_brace OR _ends").select("unit_id", "decl_ix", "tok_ix", (F.col("parens") + F.col("brackets")).alias("depth"))


def expression_statements(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, first, depth) of each statement in a block that is an expression; an empty one after another statement counts."""
    state = F.last(F.when(F.col("src").isin("case", "default", "?", *_BOUNDARY), F.col("src")), ignorenulls=True).over(_earlier())
    own = with_items(marked).withColumns({"_state": state, "_name": (F.col("prev_t") == "ID") & F.lag("src", 2).over(in_declaration()).isin(*_BOUNDARY, ":")})
    own = own.withColumn("_label", (F.col("src") == ":") & (F.col("_state").isin("case", "default") | F.col("_state").isin(*_BOUNDARY) & F.col("_name")))
    # A closing brace ends a statement where it ends a block: what comes before it is held by that brace.
    own = own.withColumns({"_labelled": F.lag("_label").over(in_declaration()), "_ended": F.lag("block", 2).over(in_declaration())})
    after = F.col("prev").isin(";", "{", "else", "do") | (F.col("prev") == "}") & F.col("_ended") | F.col("_labelled") | (F.col("prev") == ")") & F.col("before.prev").isin(*_CONTROL)
    words = (*_CONTROL, "else", "do", "case", "default", "return", "break", "continue", "goto", "{", "}", ")", *C.ASM_WORDS, *C.ASSERT_WORDS)
    empty = (F.col("src") == ";") & ~(F.coalesce(F.col("before.prev"), F.lit("")) == "while")
    names = (F.col("tname") == "ID") & (F.col("next") == ":")
    return own.where(F.col("in_block") & after & F.col("item_ix").isNull() & ~F.col("src").isin(*words) & ~names & (empty | (F.col("src") != ";"))).select("unit_id", "decl_ix", "tok_ix", F.col("src").alias("first"), F.col("braces").alias("depth"))


def statement_expressions(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, depth) of each block in round brackets that is an expression."""
    return marked.where("dir_id IS NULL AND NOT in_attribute AND (in_body OR in_value) AND src = '{' AND prev = '('").select("unit_id", "decl_ix", "tok_ix", F.col("parens").alias("depth"))


def _in_brackets(marked: DataFrame, heads: Column) -> DataFrame:
    """Tokens in the round brackets that follow each of `heads`, with _head: its place and parens. Heads are not nested."""
    own = marked.withColumn("_head", F.last(F.when(heads & (F.col("next") == "("), F.struct("tok_ix", "parens")), ignorenulls=True).over(_so_far()))
    done = F.max(((F.col("src") == ")") & (F.col("parens") == F.col("_head.parens"))).cast("int")).over(_so_far("_head"))
    return own.withColumn("_done", done).where("_head IS NOT NULL AND _done = 0 AND parens > _head.parens")


def static_asserts(marked: DataFrame) -> DataFrame:
    """Static assertions at file scope and in bodies: condition text, and message where one is given."""
    own = _in_brackets(marked.where("dir_id IS NULL AND NOT in_attribute"), F.col("src").isin(*C.ASSERT_WORDS))
    comma = (F.col("src") == ",") & (F.col("parens") == F.col("_head.parens") + 1) & (F.col("brackets") == 0)
    own = own.withColumns({"_comma": comma, "_part": F.sum(comma.cast("int")).over(_so_far("_head"))}).where("NOT _comma")
    rows = own.groupBy("unit_id", "decl_ix", F.col("_head.tok_ix").alias("tok_ix")).agg(_words(F.col("_part") == 0).alias("a"), _words(F.col("_part") == 1).alias("b"), F.max("in_body").alias("in_body"))
    return rows.select("unit_id", "decl_ix", "tok_ix", _spelled("a").alias("condition"), F.when(F.size("b") > 0, _spelled("b")).alias("message"), "in_body")


def generic_selections(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, generic_ix, control) of each _Generic selection: its controlling expression."""
    own = _in_brackets(marked.where("dir_id IS NULL"), F.col("src") == "_Generic")
    comma = ((F.col("src") == ",") & (F.col("parens") == F.col("_head.parens") + 1)).cast("int")
    own = own.withColumn("_arm", F.sum(comma).over(_so_far("_head"))).where("_arm = 0")
    return own.groupBy("unit_id", "decl_ix", F.col("_head.tok_ix").alias("generic_ix")).agg(_words(F.lit(True)).alias("words")).select("unit_id", "decl_ix", "generic_ix", _spelled("words").alias("control"))


def bit_int_widths(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, width) of each _BitInt."""
    rows = _in_brackets(marked.where("dir_id IS NULL"), F.col("src") == "_BitInt").groupBy("unit_id", "decl_ix", F.col("_head.tok_ix").alias("tok_ix")).agg(_words(F.lit(True)).alias("words"))
    return rows.select("unit_id", "decl_ix", "tok_ix", _spelled("words").alias("width"))


def pointer_levels(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, part, name, level, qualifiers) of each star before the name of a file-scope declarator."""
    named = symbols(marked).select("unit_id", "decl_ix", "part", "name", F.col("tok_ix").alias("name_ix"))
    own = marked.where("dir_id IS NULL AND NOT in_attribute AND NOT in_body AND NOT in_value AND braces = 0 AND brackets = 0").join(named, ["unit_id", "decl_ix", "part"]).where("tok_ix < name_ix")
    own = own.withColumn("_star", F.sum((F.col("src") == "*").cast("int")).over(_so_far("part"))).where("_star > 0")
    return own.groupBy("unit_id", "decl_ix", "part", "name", (F.col("_star") - 1).alias("level")).agg(_words(F.col("src").isin(*C.QUALIFIERS)).alias("words")).select("unit_id", "decl_ix", "part", "name", "level", _spelled("words").alias("qualifiers"))


def array_qualifiers(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, tok_ix, word) of each qualifier, and static, that begins the size of an array outside bodies."""
    own = marked.where("dir_id IS NULL AND NOT in_attribute AND NOT in_body AND NOT in_value AND brackets > 0")
    return own.where(F.col("src").isin("static", *C.QUALIFIERS)).select("unit_id", "decl_ix", "tok_ix", F.col("src").alias("word"))

"""Expression trees as rows: each operator, call, subscript, name and literal with its parent.

Tokens that one bracket holds directly, between two separators, are a segment. In it the parent of
an operator is the nearer in strength of the nearest weaker operators on its two sides: strengths
are few, so both are as-of lookups, one running value for each strength in either direction.
Operators of equal strength contain those on their left, or on their right where they group from the
right. What stands between ? and : is a segment of its own. The root of a bracket's content hangs on
the operator that takes the bracket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec

from ..blocks.facade import F, Window
from ..functions import c_tokens as C
from .inner import with_items

CONTROL = ("if", "while", "for", "switch")
MEASURE = ("sizeof", "alignof", "_Alignof", "__alignof", "__alignof__")
PREFIX_WORDS = (*MEASURE, "__extension__", "__real__", "__imag__")
_WORDS = ("return", "case", "default", "goto", "else", "do", "break", "continue", *CONTROL, *C.ASM_WORDS, *C.ASSERT_WORDS)
_KEYED = ("typeof", "typeof_unqual", "__typeof", "__typeof__", "_Alignas", "alignas", "_Atomic", "_BitInt")
_CALLEES = ("ID", "MACRO_NAME")
_OPERANDS = ("ID", "MACRO_NAME", "TYPEDEF_NAME", "LIT_INT", "LIT_FLOAT", "LIT_CHAR", "LIT_STRING", "KW_TRUE", "KW_FALSE", "KW_NULLPTR", "KW___FUNC__")
PREFIX, POSTFIX = 14, 15


def _declaration(*keys: str) -> WindowSpec:
    return Window.partitionBy("unit_id", "decl_ix", *keys).orderBy("tok_ix")


def _upto(spec: WindowSpec, last: int = 0) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, last)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _with_brackets(own: DataFrame) -> DataFrame:
    """kind of each opening bracket, close_ix and follow (its partner and what comes after), mate (of a closing one), and holder."""
    own = own.withColumns({"next_t": F.lead("tname").over(_declaration()), "level": F.col("braces") + F.col("parens") + F.col("brackets"), "_opens": F.col("src").isin("(", "[", "{"), "_closes": F.col("src").isin(")", "]", "}")})
    alternate = _declaration("level", "_bracket")
    own = own.withColumn("_bracket", F.col("_opens") | F.col("_closes"))
    own = own.withColumns({"close_ix": F.when(F.col("_opens"), F.lead("tok_ix").over(alternate)), "_follow": F.when(F.col("_opens"), F.lead(F.struct("next", "next_t")).over(alternate))})
    typed = F.col("next").isin(*C.TYPE_WORDS, *C.QUALIFIERS) | (F.col("next_t") == "TYPEDEF_NAME")
    callee = F.col("prev_t").isin(*_CALLEES) | F.col("prev_t").startswith("KW___BUILTIN") | (F.col("prev") == "]") | (F.col("prev") == ")") & ~_flag(F.col("before._typed")) & ~_flag(F.col("before.prev").isin(*CONTROL, *_KEYED, *MEASURE))
    paren = (
        F.when(F.col("prev").isin(*CONTROL), "control").when(F.col("prev").isin(*MEASURE), "measure").when(F.col("prev") == "_Generic", "generic").when(F.col("prev").isin(*C.ASSERT_WORDS), "assertion")
        .when(F.col("prev").isin(*C.ASM_WORDS, "volatile", "__volatile__"), "asm").when(F.col("prev").isin(*_KEYED), "keyed").when(callee, "call").when(typed, F.when(F.col("_follow.next") == "{", "compound").otherwise("cast"))
        # An operand right after brackets: they hold a type, known here or not.
        .when(F.col("_follow.next_t").isin(*_OPERANDS), "cast").otherwise("group")
    )
    # A brace holds members or enumerators where no other mark stands between it and the word of its tag.
    head = F.last(F.when(F.col("src").isin("struct", "union", "enum", ";", "{", "}", "(", ")", ",", "="), F.col("src")), ignorenulls=True).over(_upto(_declaration(), -1))
    block = F.col("prev").isin(";", "}", ":", "else", "do", "(") | (F.col("prev") == ")") & (_flag(F.col("before.prev").isin(*CONTROL)) | (F.col("braces") == 0) & ~F.col("in_value")) | (F.col("prev") == "{") & ~F.col("in_value") & ~F.col("item_value")
    brace = F.when(head.isin("struct", "union"), "members").when(head == "enum", "enumerators").when(F.coalesce(block, F.lit(True)) | (F.col("braces") == 0) & F.col("in_body"), "block").otherwise("list")
    after = F.col("prev_t").isin(*_OPERANDS) | F.col("prev").isin(")", "]", "}")
    # Outside values and statements square brackets give a size, but for those in the value of an enumerator, a width, or an assertion.
    mark = F.col("src").isin("=", ";", "}", "enum") | (F.col("src") == ",") & (F.col("parens") == 0) | (F.col("src") == ":") & ~F.col("in_block")
    of_tag = F.last(F.when(mark, F.col("src")), ignorenulls=True).over(_upto(_declaration(), -1)).isin("=", ":")
    keyed = F.max(F.when((F.col("src") == "(") & F.col("prev").isin(*C.ASSERT_WORDS, *_KEYED), F.col("close_ix"))).over(_upto(_declaration(), -1)) > F.col("tok_ix")
    declares = F.when(F.col("in_body"), F.col("item_ix").isNotNull() & ~F.col("item_value")).otherwise(~F.col("in_value")) & (F.col("brackets") == F.coalesce("_item.brackets", F.lit(0)))
    size = ~after | declares & ~_flag(of_tag) & ~_flag(keyed) | (F.col("prev_t") == "TYPEDEF_NAME")
    own = own.withColumn("kind", F.when(F.col("src") == "(", paren).when(F.col("src") == "[", F.when(_flag(size), "size").otherwise("subscript")).when(F.col("src") == "{", brace))
    own = own.withColumn("mate", F.when(F.col("_closes"), F.lag(F.struct("tok_ix", "kind", "prev", "prev_t")).over(alternate)))
    # An opening bracket is held by another one, and holds what is a level deeper: it takes part twice.
    places = F.when(F.col("_opens"), F.array("level", F.col("level") + 1)).otherwise(F.array("level"))
    own = own.withColumn("_place", F.explode(places)).withColumn("_source", F.col("_opens") & (F.col("_place") > F.col("level")))
    source = F.when(F.col("_source"), F.struct("tok_ix", "kind", "close_ix", "brackets"))
    return own.withColumn("holder", F.last(source, ignorenulls=True).over(_upto(_declaration("_place")))).where("NOT _source").drop("_place", "_source", "_opens", "_closes", "_bracket", "_follow").withColumn("in_ix", F.coalesce("holder.tok_ix", F.lit(-1).cast("long")))


def bracketed(marked: DataFrame) -> DataFrame:
    """Tokens of code with their local declarations and brackets, for what reads these several times; tokens that have them stay as they are."""
    return marked if "in_ix" in marked.columns else _with_brackets(with_items(marked))


def _with_branches(own: DataFrame) -> DataFrame:
    """tern_ix: the ? whose middle part holds a token, -1 outside; colon_ix of each ?; loose: a colon that belongs to none."""
    step = F.when(F.col("src") == "?", 1).when(F.col("src") == ":", -1).otherwise(0)
    so_far = _upto(_declaration("in_ix"))
    own = own.withColumn("_sum", F.sum(step).over(so_far)).withColumn("_deep", F.col("_sum") - F.least(F.min("_sum").over(so_far), F.lit(0)))
    own = own.withColumn("loose", (F.col("src") == ":") & (F.coalesce(F.lag("_deep").over(_declaration("in_ix")), F.lit(0)) == 0))
    own = own.withColumns({"_asks": F.col("src") == "?", "_own": F.col("_deep") - (F.col("src") == "?").cast("int")})
    own = own.withColumn("_mark", F.col("_asks") | (F.col("src") == ":") & ~F.col("loose"))
    own = own.withColumn("colon_ix", F.when(F.col("_asks"), F.lead("tok_ix").over(_declaration("in_ix", "_own", "_mark"))))
    own = own.withColumn("_place", F.explode(F.when(F.col("_asks"), F.array("_own", "_deep")).otherwise(F.array("_own")))).withColumn("_source", F.col("_asks") & (F.col("_place") > F.col("_own")))
    asked = F.last(F.when(F.col("_source"), F.col("tok_ix")), ignorenulls=True).over(_upto(_declaration("in_ix", "_place")))
    return own.withColumn("_asked", asked).where("NOT _source").withColumn("tern_ix", F.when(F.col("_own") > 0, F.coalesce("_asked", F.lit(-1).cast("long"))).otherwise(F.lit(-1).cast("long"))).drop("_sum", "_deep", "_asks", "_own", "_mark", "_place", "_source", "_asked")


def _live(own: DataFrame) -> DataFrame:
    """Tokens of expressions: values, sizes, widths, enumerator values, assertions, operands of keywords, and the statements of bodies; not declarators and type names."""
    so_far = _upto(_declaration(), -1)
    within = lambda kinds: F.coalesce(F.max(F.when(F.col("kind").isin(*kinds), F.col("close_ix"))).over(so_far), F.lit(-1).cast("long")) > F.col("tok_ix")
    typed = F.last(F.when(F.col("kind").isin("cast", "compound") | (F.col("kind") == "measure") & (F.col("next").isin(*C.TYPE_WORDS, *C.QUALIFIERS) | (F.col("next_t") == "TYPEDEF_NAME")), F.struct("close_ix", "brackets")), ignorenulls=True).over(so_far)
    tag = F.col("kind").isin("members", "enumerators") | F.col("mate.kind").isin("members", "enumerators")
    mark = F.when(_flag(tag), "none").when(F.col("tern_ix") >= 0, None).when((F.col("holder.kind") == "enumerators") & F.col("src").isin("=", ","), F.when(F.col("src") == "=", "value").otherwise("none")).when((F.col("holder.kind") == "members") & F.col("src").isin(":", ",", ";"), F.when(F.col("src") == ":", "value").otherwise("none"))
    own = own.withColumns({"_typed": typed, "_tag": F.last(mark, ignorenulls=True).over(so_far), "_asserted": within(["assertion", "keyed"]), "_tagged": within(["members", "enumerators"])})
    in_type = _flag((F.col("_typed.close_ix") > F.col("tok_ix")) & (F.col("brackets") <= F.col("_typed.brackets")))
    in_tag = F.when(F.col("_tagged"), _flag(F.col("_tag") == "value") & ~_flag(mark.isNotNull()) | (F.col("brackets") > 0))
    local = F.when(F.col("item_ix").isNull(), True).otherwise(F.col("item_value") | (F.col("brackets") > F.col("_item.brackets")))
    live = F.coalesce(in_tag, F.when(F.col("in_body"), local).otherwise(F.col("in_value") | (F.col("brackets") > 0))) | F.col("_asserted")
    return own.withColumn("_live", live & ~in_type & _flag(F.coalesce("holder.kind", F.lit("")) != "asm")).drop("_typed", "_tag", "_asserted", "_tagged")


def _segments(own: DataFrame) -> DataFrame:
    """Live tokens with seg, the ordinal of their segment in its holder; begun_by and ended_by: the separators around it."""
    holder = F.coalesce("holder.kind", F.lit(""))
    lists = (holder.isin("call", "generic", "assertion", "list", "members", "enumerators", "keyed") | F.col("at_item") | (holder == "") & ~F.col("in_body")) & (F.col("tern_ix") < 0)
    frames = ("control", "assertion", "asm", "keyed", "block", "members", "enumerators")
    sep = (F.col("src") == ";") | F.col("loose") | (F.col("src") == ",") & lists | F.col("kind").isin(*frames) | F.col("mate.kind").isin(*frames) | F.col("src").isin(*_WORDS)
    own = own.withColumn("_sep", _flag(sep))
    spec, back = _declaration("in_ix", "tern_ix"), Window.partitionBy("unit_id", "decl_ix", "in_ix", "tern_ix").orderBy(F.desc("tok_ix"))
    separator = F.when(F.col("_sep"), F.col("src"))
    own = own.withColumns({"seg": F.sum(F.col("_sep").cast("int")).over(_upto(spec)), "begun_by": F.last(separator, ignorenulls=True).over(_upto(spec, -1)), "ended_by": F.last(separator, ignorenulls=True).over(_upto(back, -1)), "ordinal": F.count_if(F.col("_sep") & (F.col("src") == ",")).over(_upto(spec))})
    # The steps that name an item of a list, and the = after them, are no expression.
    part = _declaration("in_ix", "tern_ix", "seg")
    first, equals = F.first(F.when(~F.col("_sep"), F.col("src")), ignorenulls=True).over(_upto(part)), F.count_if(F.col("src") == "=").over(_upto(part))
    named = (holder == "list") & first.isin(".", "[") & ((equals == 0) | (equals == 1) & (F.col("src") == "="))
    label = (F.col("ended_by") == ":") & (F.col("tern_ix") < 0) & ~_flag(F.col("begun_by").isin("case")) & holder.isin("block", "generic", "list", "members", "")
    own = own.withColumns({"_named": _flag(named), "_label": _flag(label) | _flag(F.col("begun_by") == "goto")})
    return own.where("_live AND NOT _sep AND NOT _named AND NOT _label").drop("_live", "_sep", "_named", "_label")


def _with_roles(own: DataFrame) -> DataFrame:
    """role of each token that is an operator or operand: node kind; strength of operators, null for operands."""
    cast = _flag(F.col("before._typed")) & ~_flag(F.col("before.prev").isin(*MEASURE)) & ~_flag(F.col("before.prev_t").isin(*_CALLEES))
    closed = (F.col("prev") == ")") & ~cast & ~_flag(F.col("before.prev").isin(*CONTROL)) | (F.col("prev") == "]") | (F.col("prev") == "}") & _flag(F.lag("mate.kind").over(_declaration()) == "list")
    own = own.withColumn("_base", _flag(F.col("prev_t").isin(*_OPERANDS) | closed))
    own = own.withColumn("_after", F.col("_base") | F.col("prev").isin("++", "--") & _flag(F.lag("_base").over(_declaration())))
    strength = F.create_map(*[F.lit(x) for pair in C.PRECEDENCE.items() for x in pair])
    src, after = F.col("src"), F.col("_after")
    binary = F.when(src.isin(*C.PRECEDENCE) & after, strength[src])
    prefix = src.isin("+", "-", "*", "&", "~", "!", "++", "--", "&&") & ~after | src.isin(*PREFIX_WORDS) | (F.col("kind") == "cast")
    postfix = src.isin("++", "--", ".", "->") & after | (F.col("kind") == "call") | (F.col("kind") == "subscript") & after
    role = (
        F.when(F.col("kind") == "call", "call_expression").when((F.col("kind") == "subscript") & after, "subscript_expression").when(F.col("kind") == "cast", "cast_expression")
        .when(src.isin(".", "->") & after, "member_expression").when(src.isin("++", "--") & after, "postfix_unary_expression")
        .when(binary.isNotNull(), F.when(binary == 2, "assignment_expression").when(src == "?", "conditional_expression").when(src == ",", "comma_expression").otherwise("binary_expression"))
        .when(_flag(prefix), "unary_expression").when(F.col("kind") == "generic", "generic_selection").when(F.col("kind") == "compound", "compound_literal").when(F.col("kind").isin("group", "measure"), "brackets")
        .when(F.col("tname").startswith("LIT_") & ~_flag((F.col("tname") == "LIT_STRING") & (F.col("prev_t") == "LIT_STRING")) | F.col("tname").isin("KW_TRUE", "KW_FALSE", "KW_NULLPTR"), "literal").when(F.col("tname").isin(*_OPERANDS) & (F.col("tname") != "LIT_STRING"), "name")
    )
    own = own.withColumns({"role": role, "strength": F.when(_flag(postfix), POSTFIX).when(binary.isNotNull(), binary).when(_flag(prefix), PREFIX)})
    part = Window.partitionBy("unit_id", "decl_ix", "in_ix", "tern_ix", "seg")
    return own.withColumns({"seg_first": F.min("tok_ix").over(part), "seg_last": F.max("tok_ix").over(part)}).where("role IS NOT NULL")


def _nearest(specs: WindowSpec, most: Column, pick) -> Column:
    by_strength = F.array(*(F.last(F.when(F.col("strength") == k, F.col("_op")), ignorenulls=True).over(_upto(specs, -1)) for k in range(1, POSTFIX + 1)))
    return pick(F.slice(by_strength, 1, most))


def expressions(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, node_ix, kind, op, parent_ix, side, ordinal, slot, first_ix, last_ix) of each node of each expression.

    node_ix: the operator's token, for calls and subscripts the opening bracket, for others the name
    or literal. parent_ix is null at a root, whose slot says what the expression is for. side: left
    or right, operand, condition, then, else, callee, argument (with its ordinal), object, member,
    index. first_ix and last_ix: the tokens that the node spans; brackets around a node are not part
    of it. Round brackets and strings that touch another one make no node of their own. Needs
    identifiers told apart. A statement that multiplies two names is an expression unless the first
    is a type known here; words of a type before a colon of _Generic, labels and designators are none.
    """
    own = _with_roles(_segments(_live(_with_branches(bracketed(marked)))))
    end = F.when(F.col("src") == "?", F.col("colon_ix")).when(F.col("kind").isin("cast", "call", "subscript"), F.col("close_ix")).otherwise(F.col("tok_ix"))
    op = F.struct("tok_ix", "strength", end.alias("end_ix"), "role", "src")
    own = own.withColumn("_op", F.when(F.col("strength").isNotNull(), op))
    right = F.col("strength").isin(*C.RIGHT_TO_LEFT, PREFIX)
    none = F.lit(POSTFIX)
    to_left = F.when(F.col("strength").isNull(), none).otherwise(F.col("strength") - F.when(right, 0).otherwise(1))
    to_right = F.when(F.col("strength").isNull(), none).otherwise(F.col("strength") - F.when(right, 1).otherwise(0))
    keys = ("unit_id", "decl_ix", "in_ix", "tern_ix", "seg")
    own = own.withColumn("_left", _nearest(Window.partitionBy(*keys).orderBy("tok_ix"), to_left, F.array_max))
    own = own.withColumn("_right", _nearest(Window.partitionBy(*keys).orderBy(F.desc("tok_ix")), to_right, F.array_min))
    # Of two equally strong ones, the left one where they group from the left.
    by_left = F.col("_right").isNull() | (F.col("_left.strength") > F.col("_right.strength")) | (F.col("_left.strength") == F.col("_right.strength")) & ~F.col("_left.strength").isin(*C.RIGHT_TO_LEFT)
    on_left = F.col("_left").isNotNull() & _flag(by_left)
    left_side = F.when(F.col("_left.strength") == PREFIX, "operand").when(F.col("_left.src") == "?", "else").when(F.col("_left.role") == "member_expression", "member").otherwise("right")
    right_side = F.when(F.col("_right.src") == "?", "condition").when(F.col("_right.role") == "call_expression", "callee").when(F.col("_right.role").isin("subscript_expression", "member_expression"), "object").when(F.col("_right.strength") == POSTFIX, "operand").otherwise("left")
    link = lambda ix, side: F.struct(F.col(ix).alias("ix"), side.alias("side"))
    by_slot = F.when(F.col("tern_ix") >= 0, link("tern_ix", F.lit("then"))).when(F.col("holder.kind").isin("call", "generic"), link("holder.tok_ix", F.lit("argument"))).when(F.col("holder.kind") == "subscript", link("holder.tok_ix", F.lit("index")))
    parent = F.when(on_left, link("_left.tok_ix", left_side)).when(F.col("_right").isNotNull(), link("_right.tok_ix", right_side)).otherwise(by_slot)
    first = F.when(F.col("strength") == PREFIX, F.col("tok_ix")).when(F.col("strength").isNull(), F.col("tok_ix")).when(F.col("_left").isNotNull(), F.col("_left.end_ix") + 1).otherwise(F.col("seg_first"))
    last = F.when(F.col("src").isin(".", "->"), F.col("tok_ix") + 1).when(F.col("strength") == POSTFIX, F.when(F.col("close_ix").isNotNull(), F.col("close_ix")).otherwise(F.col("tok_ix"))).when(F.col("strength").isNull(), F.coalesce("close_ix", "tok_ix"))
    last = F.coalesce(last, F.when(F.col("_right").isNotNull(), F.col("_right.tok_ix") - 1).otherwise(F.col("seg_last")))
    open_end = F.col("_left").isNull() & F.col("_right").isNull() & (F.col("tern_ix") < 0) & _flag(F.col("holder.kind").isin("group", "measure"))
    own = own.withColumns({"_parent": parent, "_first": first, "_last": last, "_hangs": open_end, "_bracketed": F.col("role") == "brackets", "_argument": F.when(F.col("holder.kind").isin("call", "generic") & (F.col("tern_ix") < 0) & F.col("_left").isNull() & F.col("_right").isNull(), F.col("ordinal"))})
    # Brackets around brackets: all take the parent of the outermost. A bracket that hangs on another one comes right after it.
    own = own.withColumn("_run", F.sum((F.col("_bracketed") & ~F.col("_hangs")).cast("int")).over(_upto(Window.partitionBy("unit_id", "decl_ix", "_bracketed").orderBy("tok_ix"))))
    head = F.first(F.struct(F.col("_parent").alias("parent"), F.col("_argument").alias("argument"), "in_ix", "holder.kind", "begun_by")).over(_upto(Window.partitionBy("unit_id", "decl_ix", "_bracketed", "_run").orderBy("tok_ix")))
    own = own.withColumn("_head", F.when(F.col("_bracketed"), head))
    key = F.when(F.col("_bracketed"), F.col("tok_ix")).when(F.col("_hangs"), F.col("in_ix")).otherwise(-1 - F.col("tok_ix"))
    own = own.withColumn("_key", key)
    outer = F.last("_head", ignorenulls=True).over(_upto(Window.partitionBy("unit_id", "decl_ix", "_key").orderBy("tok_ix")))
    own = own.withColumn("_outer", outer).where("NOT _bracketed")
    parent, argument = F.when(F.col("_hangs"), F.col("_outer.parent")).otherwise(F.col("_parent")), F.when(F.col("_hangs"), F.col("_outer.argument")).otherwise(F.col("_argument"))
    kind, begun = F.when(F.col("_hangs"), F.col("_outer.kind")).otherwise(F.col("holder.kind")), F.when(F.col("_hangs"), F.col("_outer.begun_by")).otherwise(F.col("begun_by"))
    slot = (
        F.when(kind == "control", "condition").when(kind == "list", "item").when(kind == "size", "size").when(kind == "members", "width").when(kind == "enumerators", "enumerator").when(kind == "assertion", "assertion").when(kind == "keyed", "operand")
        .when(~F.col("in_body") | F.col("item_value"), "value").when(begun.isin("return", "case"), begun).otherwise("statement")
    )
    slot = F.when(parent.isNull(), slot)
    return own.select("unit_id", "decl_ix", F.col("tok_ix").alias("node_ix"), F.col("role").alias("kind"), F.col("src").alias("op"), parent["ix"].alias("parent_ix"), parent["side"].alias("side"), argument.cast("long").alias("ordinal"), slot.alias("slot"), F.col("_first").alias("first_ix"), F.col("_last").alias("last_ix"))

"""External declarations and what they declare, from windows over the tokens.

A declaration ends at a semicolon outside all brackets, or at a closing brace outside all others
when the next token begins a new one. A directive line at file scope is a declaration of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec

from ..blocks.facade import F, Window
from ..functions import c_tokens as C


def in_unit() -> WindowSpec:
    return Window.partitionBy("unit_id").orderBy("ix")  # as the tokens come


def in_declaration() -> WindowSpec:
    return Window.partitionBy("unit_id", "decl_ix").orderBy("tok_ix")


def without_attributes(marked: DataFrame) -> DataFrame:
    """Tokens of code outside attributes; prev and next are those that are left."""
    own = marked.where("dir_id IS NULL AND NOT in_attribute")
    return own.withColumns({"prev": F.coalesce(F.lag("src").over(in_declaration()), F.col("prev")), "next": F.coalesce(F.lead("src").over(in_declaration()), F.col("next"))})


def _outside() -> Column:
    return (F.col("braces") == 0) & (F.col("parens") == 0) & (F.col("brackets") == 0)


def _with_numbers(tokens: DataFrame) -> DataFrame:
    """Tokens with decl_ix; _old marks parameters that are declared between a list and its body, _kr the brace of that body.

    A closing bracket outside all others that a type or name follows may begin such parameters, and a
    brace after a semicolon ends them, with no other brace or value between: all of it is one declaration.
    """
    code = F.col("dir_id").isNull()
    begins = F.col("next").isin(*C.DECLARATION_STARTS) | F.col("next").isin("#", "%:") | F.col("next").isNull() | (F.lead("tname").over(in_unit()) == "TYPEDEF_NAME")
    ends = code & _outside() & ((F.col("src") == ";") | (F.col("src") == "}") & begins) | (F.col("tname") == "PP_NEWLINE") & (F.col("braces") == 0)
    so_far, earlier = (in_unit().rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    new = F.lag(ends, 1, True).over(in_unit()) | (F.col("tname") == "PP_HASH") & (F.col("braces") == 0)
    opens = code & (F.col("src") == ")") & _outside() & (F.col("next").isin(*C.TYPE_WORDS, *C.QUALIFIERS, "register") | F.lead("tname").over(in_unit()).isin("ID", "TYPEDEF_NAME"))
    breaks = ~code | _outside() & F.col("src").isin("{", "}", "=")
    cut = tokens.withColumns({"_new": new, "_opens": F.coalesce(opens, F.lit(False)), "_breaks": F.coalesce(breaks, F.lit(False))})
    cut = cut.withColumn("decl_ix", F.sum(F.col("_new").cast("int")).over(so_far) - 1)
    last = F.last(F.when(F.col("_opens"), F.struct("tok_ix", "decl_ix")), ignorenulls=True).over(earlier)
    broken = F.last(F.when(F.col("_breaks"), F.col("tok_ix")), ignorenulls=True).over(earlier)
    cut = cut.withColumns({"_list": last, "_broken": broken})
    cut = cut.withColumn("_open", F.col("_list").isNotNull() & (F.coalesce("_broken", F.lit(-1).cast("long")) < F.col("_list.tok_ix")))
    cut = cut.withColumn("_kr", code & _outside() & (F.col("src") == "{") & (F.col("prev") == ";") & F.col("_open"))
    # What may belong together has one region; the declarations in it are put together where its brace shows that they do.
    cut = cut.withColumn("_region", F.sum((F.col("_new") & ~F.col("_open")).cast("int")).over(so_far))
    whole = Window.partitionBy("unit_id", "_region")
    held = F.max(F.when(F.col("_kr"), F.struct(F.col("tok_ix").alias("brace"), F.col("_list.tok_ix").alias("list"), F.col("_list.decl_ix").alias("first"), F.col("decl_ix").alias("last")))).over(whole)
    cut = cut.withColumn("_held", held)
    inside = F.col("decl_ix").between(F.col("_held.first"), F.col("_held.last"))
    old = F.coalesce((F.col("tok_ix") > F.col("_held.list")) & (F.col("tok_ix") < F.col("_held.brace")), F.lit(False))
    return cut.withColumns({"_old": old, "decl_ix": F.when(inside, F.col("_held.first")).otherwise(F.col("decl_ix"))}).drop("_new", "_opens", "_breaks", "_list", "_broken", "_open", "_region", "_held")


def with_declarations(tokens: DataFrame) -> DataFrame:
    """Tokens with decl_ix, decl_kind, in_body (inside a function's braces, or among its old-style parameters), in_attribute, and part: the declarator's ordinal.

    All but the numbers come from running values over one order of each declaration's tokens.
    """
    code = F.col("dir_id").isNull()
    so_far, earlier = (in_declaration().rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    whole = in_declaration().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = _with_numbers(tokens)
    assign = code & _outside() & (F.col("src") == "=")
    # The first brace that follows a closing parenthesis, or old-style parameters, with no = before it, opens a body.
    opens = code & _outside() & (F.col("src") == "{") & ((F.col("prev") == ")") | F.col("_kr"))
    cut = cut.withColumns({"_opens": opens, "_assigned": F.coalesce(F.max(assign.cast("int")).over(earlier), F.lit(0))})
    body = F.min(F.when(F.col("_opens") & (F.col("_assigned") == 0), F.col("tok_ix"))).over(whole)
    cut = cut.withColumns({"_body": body, "_first": F.first("tname").over(whole)})
    inside = (F.col("tok_ix") > F.col("_body")) & (F.col("braces") > 0) | F.col("_old")
    cut = cut.withColumns({
        "decl_kind": F.when(F.col("_first") == "PP_HASH", "directive").when(F.col("_body").isNotNull(), "function_definition").otherwise("declaration"),
        "in_body": F.coalesce(inside, F.lit(False)),
    }).drop("_opens", "_assigned", "_body", "_first", "_kr", "_old")
    # in_attribute: inside __attribute__((...)), __declspec(...) or [[...]], with the words that open it; attr_ix numbers them.
    bracket = (F.col("src") == "[") & (F.col("next") == "[") & (F.lead("start").over(in_declaration()) == F.col("end")) & (F.col("brackets") == 0)
    cut = cut.withColumn("_opens", F.coalesce((F.col("src").isin(*C.ATTRIBUTE_OPENERS) | bracket) & code, F.lit(False)))
    cut = cut.withColumns({"attr_ix": F.sum(F.col("_opens").cast("int")).over(so_far), "_by": F.last(F.when(F.col("_opens"), F.struct("tok_ix", "src", "brackets", "parens")), ignorenulls=True).over(so_far)})
    closes = F.when(F.col("_by.src") == "[", (F.col("src") == "]") & (F.col("brackets") == F.col("_by.brackets"))).otherwise((F.col("src") == ")") & (F.col("parens") == F.col("_by.parens")))
    cut = cut.withColumn("_closed", F.last(F.when(closes & (F.col("tok_ix") > F.col("_by.tok_ix")), F.col("tok_ix")), ignorenulls=True).over(earlier))
    cut = cut.withColumn("in_attribute", F.col("_by").isNotNull() & (F.coalesce("_closed", F.lit(-1).cast("long")) < F.col("_by.tok_ix"))).drop("_opens", "_by", "_closed")
    # part: how many commas outside brackets precede a token in its declaration; in_value: after the = of its part.
    comma = (F.col("src") == ",") & _outside() & ~F.col("in_attribute")
    latest = lambda c: F.coalesce(F.last(F.when(c, F.col("tok_ix")), ignorenulls=True).over(earlier), F.lit(-1).cast("long"))
    return cut.withColumns({"part": F.coalesce(F.sum(comma.cast("int")).over(earlier), F.lit(0)), "in_value": latest((F.col("src") == "=") & _outside()) > latest(comma)})


def declarations(marked: DataFrame) -> DataFrame:
    """One row for each external declaration: its kind, first and last token, and its text."""
    rows = marked.where("tname <> 'PP_NEWLINE'").groupBy("unit_id", "decl_ix").agg(
        F.first("decl_kind").alias("decl_kind"), F.min("tok_ix").alias("first_ix"), F.max("tok_ix").alias("last_ix"), F.count("*").alias("n_tokens"), F.min("line").alias("line"),
        F.max((F.col("src") == "typedef") & (F.col("braces") == 0) & (F.col("parens") == 0)).alias("is_typedef"),
    )
    return rows.withColumn("is_typedef", F.coalesce("is_typedef", F.lit(False)) & (F.col("decl_kind") == "declaration"))


#: What may follow the name of a declarator at file scope.
_NAMED = (";", ",", "=", "[", "(", ")", ":", "{", *C.ATTRIBUTE_OPENERS, *C.ASM_WORDS)


def _is_name(follow: tuple[str, ...], prev: Column | None = None, after: Column | None = None) -> Column:
    """An identifier that a declarator could name: by what stands around it."""
    prev, after = F.col("prev") if prev is None else prev, F.col("next") if after is None else after
    return F.col("tname").isin("ID", "TYPEDEF_NAME", "MACRO_NAME") & ~F.coalesce(prev, F.lit("")).isin("struct", "union", "enum", ".", "->", "goto") & F.coalesce(after, F.lit(";")).isin(*follow)


def _shape() -> Column:
    """What a declarator declares, from x (its name), stars and what follows; brackets without a star in them change nothing, and a list right after the name makes it a function."""
    starred = F.exists("stars", lambda t: (t["parens"] == F.col("x.parens")) & (t["tok_ix"] < F.col("x.tok_ix"))) & (F.col("x.parens") > 0)
    follow = F.when((F.col("x.parens") > 0) & (F.col("x.next") == ")"), F.col("x.next2")).otherwise(F.col("x.next"))
    return F.when(F.col("x.next") == "(", "function").when(starred, "function_pointer").when(follow == "(", "function").when(follow == "[", "array").otherwise("object")


def symbols(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, part, name, tok_ix, ...) of every file-scope declarator: the first name that its part could declare."""
    own = without_attributes(marked).where("decl_kind <> 'directive' AND NOT in_value AND NOT in_body AND braces = 0 AND brackets = 0")
    own = own.withColumn("next2", F.lead("src", 2).over(in_declaration()))
    rows = own.groupBy("unit_id", "decl_ix", "part").agg(
        F.min(F.when(_is_name(_NAMED), F.struct("tok_ix", "src", "next", "next2", "parens", "decl_kind"))).alias("x"),
        F.collect_list(F.when(F.col("src") == "*", F.struct("tok_ix", "parens"))).alias("stars"),
    ).where("x IS NOT NULL")
    pointers = F.size(F.filter("stars", lambda t: t["tok_ix"] < F.col("x.tok_ix")))
    return rows.select("unit_id", "decl_ix", "part", F.col("x.src").alias("name"), F.col("x.tok_ix").alias("tok_ix"), F.col("x.decl_kind").alias("decl_kind"), _shape().alias("shape"), pointers.alias("pointer_depth"), F.col("x.parens").alias("_parens"), F.coalesce(F.col("x.next") == "(", F.lit(False)).alias("_listed"))


def typedef_events(marked: DataFrame) -> DataFrame:
    """(unit_id, name, bind_ix): file-scope typedef names, bound from the end of their first declaration on, never removed."""
    made = declarations(marked).where("is_typedef").select("unit_id", "decl_ix", "last_ix")
    return symbols(marked).join(made, ["unit_id", "decl_ix"]).groupBy("unit_id", "name").agg(F.min("last_ix").alias("bind_ix"))


def classified(marked: DataFrame, predefined: list[str] = (), with_typedefs: bool = True) -> DataFrame:
    """`marked` with its identifiers told apart: TYPEDEF_NAME, MACRO_NAME or ID. Neither is told inside directives.

    Without with_typedefs only predefined names are types.

    What binds a name stands on the token that spells it, so the last event of a name before a use
    is a running value over the tokens of that name, without a join or a shuffle beyond the unit's.
    """
    kept = F.col("dir_id").isNull() & ~F.col("in_attribute")
    spelled = F.when(kept, F.col("src"))
    back = Window.partitionBy("unit_id", "decl_ix").orderBy(F.desc("tok_ix")).rowsBetween(Window.unboundedPreceding, -1)
    fore = in_declaration().rowsBetween(Window.unboundedPreceding, -1)
    # The neighbours that count, as without_attributes() has them.
    own = marked.withColumns({"_next": F.coalesce(F.last(spelled, ignorenulls=True).over(back), F.col("next")), "_prev": F.coalesce(F.last(spelled, ignorenulls=True).over(fore), F.col("prev"))})
    at_scope = kept & (F.col("decl_kind") != "directive") & ~F.col("in_value") & ~F.col("in_body") & (F.col("braces") == 0) & (F.col("brackets") == 0)
    name = at_scope & _is_name(_NAMED, F.col("_prev"), F.col("_next"))
    whole = Window.partitionBy("unit_id", "decl_ix")
    is_typedef = F.max((F.col("src") == "typedef") & (F.col("braces") == 0) & (F.col("parens") == 0) & (F.col("decl_kind") == "declaration")).over(whole)
    own = own.withColumns({"_typedef": is_typedef, "_last": F.max(F.when(F.col("tname") != "PP_NEWLINE", F.col("tok_ix"))).over(whole), "_at": F.min(F.when(name, F.col("tok_ix"))).over(Window.partitionBy("unit_id", "decl_ix", "part"))})
    bound = F.when(F.col("_typedef") & (F.col("tok_ix") == F.col("_at")), F.col("_last"))
    word, hash_ = F.lag("src").over(in_unit()), F.lag(F.struct("tname", "dir_id"), 2).over(in_unit())
    event = F.when((F.col("tname") != "PP_NEWLINE") & word.isin("define", "undef") & (hash_["tname"] == "PP_HASH") & (hash_["dir_id"] == F.col("dir_id")), word)
    own = own.withColumns({"_bound": bound, "_event": event})
    by_name = Window.partitionBy("unit_id", "src")
    state = F.last("_event", ignorenulls=True).over(by_name.orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumns({"_state": state, "_from": F.min("_bound").over(by_name)})
    free = (F.col("tname") == "ID") & F.col("dir_id").isNull()
    is_type = F.col("tok_ix") > F.col("_from") if with_typedefs else F.lit(False)
    is_type = is_type | F.col("src").isin(*predefined) if predefined else is_type
    told = F.when(free & F.coalesce(is_type, F.lit(False)), "TYPEDEF_NAME").when(free & (F.col("_state") == "define"), "MACRO_NAME").otherwise(F.col("tname"))
    return own.withColumn("tname", told).select(marked.columns)


def _with_owner(marked: DataFrame) -> DataFrame:
    """owner: the brace that directly holds each token, with the struct, union or enum that it belongs to (kind, tag_name), if any.

    A brace holds members or enumerators where no other mark stands between it and the word of its tag.
    """
    marks = ("struct", "union", "enum", ";", "{", "}", "(", ")", ",", "=")
    follows = F.lead(F.struct("src", "tname")).over(in_declaration())
    own = marked.withColumn("_named", F.when(follows["tname"].isin("ID", "TYPEDEF_NAME", "MACRO_NAME"), follows["src"]))
    head = F.last(F.when(F.col("src").isin(*marks), F.struct("src", "_named")), ignorenulls=True).over(in_declaration().rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_head", head).withColumn("_level", F.col("braces") + (F.col("src") == "{").cast("int"))
    tagged = F.col("_head.src").isin("struct", "union", "enum")
    opens = F.struct("tok_ix", F.when(tagged, F.col("_head.src")).alias("kind"), F.when(tagged, F.col("_head._named")).alias("tag_name"))
    level = Window.partitionBy("unit_id", "decl_ix", "_level").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("owner", F.last(F.when(F.col("src") == "{", opens), ignorenulls=True).over(level)).withColumn("owner_ix", F.col("owner.tok_ix")).drop("_level", "_head", "_named")


def tags(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, kind, tag_name, has_body, body_ix, tok_ix, in_body, underlying) of each struct, union and enum specifier.

    underlying: the words between the colon and the brace of an enum that gives its type.
    """
    code = marked.where("dir_id IS NULL AND NOT in_attribute")
    at = lambda n: F.lead(F.struct("src", "tname", "tok_ix"), n).over(in_declaration())
    code = code.withColumns({"_1": at(1), "_2": at(2), "_3": at(3)})
    named = F.col("_1.tname").isin("ID", "TYPEDEF_NAME", "MACRO_NAME")
    code = code.withColumn("_colon", F.when((F.col("src") == "enum") & named & (F.col("_2.src") == ":"), F.col("_2.tok_ix")).when((F.col("src") == "enum") & (F.col("_1.src") == ":"), F.col("_1.tok_ix")))
    # Of an enum with a colon: the words up to its brace.
    head = F.last(F.when(F.col("src").isin("struct", "union", "enum"), F.struct("tok_ix", "_colon")), ignorenulls=True).over(in_declaration().rowsBetween(Window.unboundedPreceding, 0))
    code = code.withColumn("_head", head)
    own = Window.partitionBy("unit_id", "decl_ix", "_head.tok_ix").orderBy("tok_ix")
    past = F.max(F.col("src").isin("{", ";", ",", ")").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    code = code.withColumn("_typed", (F.col("tok_ix") > F.col("_head._colon")) & (past == 0))
    rows = code.where(F.col("_head").isNotNull() & ((F.col("tok_ix") == F.col("_head.tok_ix")) | F.col("_typed") | (F.col("src") == "{"))).groupBy("unit_id", "decl_ix", F.col("_head.tok_ix").alias("tok_ix")).agg(
        F.max(F.when(F.col("tok_ix") == F.col("_head.tok_ix"), F.struct("src", F.when(named, F.col("_1.src")).alias("tag_name"), F.when(F.col("_1.src") == "{", F.col("_1.tok_ix")).when(named & (F.col("_2.src") == "{"), F.col("_2.tok_ix")).alias("body_ix"), "_colon", "in_body"))).alias("x"),
        F.array_sort(F.collect_list(F.when(F.col("_typed"), F.struct("tok_ix", "src")))).alias("words"),
        F.min(F.when(F.col("src") == "{", F.col("tok_ix"))).alias("brace"),
    )
    typed = F.array_join(F.transform("words", lambda w: w["src"]), " ")
    body = F.coalesce("x.body_ix", F.when(F.col("x._colon").isNotNull(), F.col("brace")))
    return rows.select(
        "unit_id", "decl_ix", F.concat("x.src", F.lit("_specifier")).alias("kind"), "x.tag_name", body.isNotNull().alias("has_body"), body.alias("body_ix"), "tok_ix", "x.in_body",
        F.when(F.col("x._colon").isNotNull(), typed).alias("underlying"),
    )


def _ordinal() -> Column:
    return (F.row_number().over(Window.partitionBy("unit_id", "decl_ix", "owner_ix").orderBy("tok_ix")) - 1).cast("long")


def members(marked: DataFrame) -> DataFrame:
    """Members of structs and unions: owner tag, name, ordinal, bit_width (text, null where it is no bit-field). Parameter names of a member are none."""
    own = _with_owner(without_attributes(marked)).where("owner.kind IN ('struct', 'union')")
    is_member = _is_name((";", ",", ":", "[", ")")) & (F.col("brackets") == 0) & F.col("owner_ix").isNotNull()
    field = Window.partitionBy("unit_id", "decl_ix", "owner_ix").orderBy("tok_ix")
    # A width runs from the colon after a name to the comma or semicolon that ends the field.
    own = own.withColumns({"_member": is_member, "_first": F.last(F.when(is_member & (F.col("next") == ":"), F.col("tok_ix")), ignorenulls=True).over(field.rowsBetween(Window.unboundedPreceding, -1))})
    part = Window.partitionBy("unit_id", "decl_ix", "owner_ix", "_first").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    done = F.max((F.col("src").isin(";") | (F.col("src") == ",") & (F.col("parens") == 0)).cast("int")).over(part)
    own = own.withColumn("_wide", F.col("_first").isNotNull() & (done == 0) & (F.col("tok_ix") > F.col("_first") + 1))
    inner = (F.col("parens") > 0) & ~F.col("prev").isin("*", *C.QUALIFIERS)
    # Of a declarator the first name counts, and none after its colon: what follows are parameters and widths.
    ends = F.col("src").isin(";", "{", "}") | (F.col("src") == ",") & (F.col("parens") == 0) & (F.col("brackets") == 0)
    own = own.withColumn("_part", F.sum(ends.cast("int")).over(field.rowsBetween(Window.unboundedPreceding, -1)))
    of_part = Window.partitionBy("unit_id", "decl_ix", "owner_ix", "_part").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.max(((F.col("_member") & ~inner) | (F.col("src") == ":")).cast("int")).over(of_part)
    own = own.withColumn("_taken", F.coalesce(taken, F.lit(0)) == 1)
    rows = own.where(F.col("_wide") | F.col("_member") & ~inner & ~F.col("_taken")).groupBy("unit_id", "decl_ix", "owner_ix", "owner.kind", "owner.tag_name", F.when(F.col("_wide"), F.col("_first")).otherwise(F.col("tok_ix")).alias("tok_ix")).agg(
        F.max(F.when(~F.col("_wide"), F.col("src"))).alias("member_name"), F.array_sort(F.collect_list(F.when(F.col("_wide"), F.struct("tok_ix", "src")))).alias("words")
    )
    width = F.when(F.size("words") > 0, F.array_join(F.transform("words", lambda w: w["src"]), " "))
    return rows.select("unit_id", "decl_ix", "owner_ix", F.concat("kind", F.lit("_specifier")).alias("kind"), "tag_name", "member_name", _ordinal().alias("ordinal"), width.alias("bit_width"))


def enumerators(marked: DataFrame) -> DataFrame:
    """Enumerators: enum tag, name, ordinal, and whether a value is given."""
    own = _with_owner(without_attributes(marked)).withColumn("_follows", F.lead("src").over(in_declaration()))
    named = own.where((F.col("owner.kind") == "enum") & F.col("tname").isin("ID", "TYPEDEF_NAME", "MACRO_NAME") & F.col("prev").isin("{", ",") & (F.col("parens") == 0))
    return named.select("unit_id", "decl_ix", "owner_ix", F.col("owner.tag_name").alias("tag_name"), F.col("src").alias("name"), _ordinal().alias("ordinal"), (F.col("_follows") == "=").alias("has_value"))


def parameters(marked: DataFrame) -> DataFrame:
    """Parameters of file-scope function declarators: function, ordinal, name (null if abstract), text, variadic."""
    fn = symbols(marked).where("shape IN ('function', 'function_pointer')").select("unit_id", "decl_ix", "part", F.col("name").alias("function"), F.col("tok_ix").alias("name_ix"), F.when(F.col("_listed"), F.col("_parens")).otherwise(F.greatest(F.col("_parens") - 1, F.lit(0))).alias("_around"))
    own = without_attributes(marked).where("NOT in_body AND braces = 0").join(fn, ["unit_id", "decl_ix", "part"])
    # The list is the bracket right after the name, or the first one after the bracket that holds the name.
    opens = F.min(F.when((F.col("src") == "(") & (F.col("tok_ix") > F.col("name_ix")) & (F.col("parens") == F.col("_around")), F.col("tok_ix"))).over(Window.partitionBy("unit_id", "decl_ix", "part"))
    own = own.withColumns({"_open": opens, "_depth": F.col("_around") + 1})
    closes = F.min(F.when((F.col("src") == ")") & (F.col("tok_ix") > F.col("_open")) & (F.col("parens") == F.col("_depth") - 1), F.col("tok_ix"))).over(Window.partitionBy("unit_id", "decl_ix", "part"))
    own = own.withColumn("_close", closes).where("tok_ix > _open AND tok_ix < _close")
    order = Window.partitionBy("unit_id", "decl_ix", "part").orderBy("tok_ix").rowsBetween(Window.unboundedPreceding, 0)
    comma = ((F.col("src") == ",") & (F.col("parens") == F.col("_depth"))).cast("int")
    own = own.withColumn("ordinal", F.sum(comma).over(order)).where((F.col("src") != ",") | (F.col("parens") > F.col("_depth")))
    words = own.groupBy("unit_id", "decl_ix", "part", "function", "ordinal").agg(
        F.array_sort(F.collect_list(F.struct("tok_ix", "src"))).alias("words"),
        F.min(F.when(_is_name((",", ")", "[")) & (F.col("tname") == "ID"), F.struct("tok_ix", "src", "prev"))).alias("x"),
        F.count("*").alias("n"),
    )
    text = F.array_join(F.transform("words", lambda w: w["src"]), " ")
    alone = (F.col("n") == 1) & (text == "void")
    return words.where(~alone).select("unit_id", "decl_ix", "function", F.col("ordinal").cast("long").alias("ordinal"), F.col("x.src").alias("name"), text.alias("text"), (text == "...").alias("variadic"))

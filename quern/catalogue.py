"""All queries of the C-source engine by name, with SQL for the same results.

The shared tables hold no C source, so each query renders its units from their columns and the
SQL computes the same facts from the columns alone, without any parsing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .blocks import facade
from .functions import c_tokens as C
from .functions.tables import register_table_functions
from .operators import code, declarations, include_graph, inner, metrics, names, preprocessor, regions, spans, trees, typedefs, versions
from .plans.program import Program, engine_info
from .sources.files import utf8_status
from .sources.tables import shared_dir
from .streaming.incremental import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _units(df: DataFrame, unit: str, src: str) -> Program:
    return Program(df.selectExpr(f"{unit} AS unit_id", f"{src} AS src"))


@query("""
SELECT tname, cnt FROM (VALUES ('KW_INT'), ('ID'), ('PUNC_ASSIGN'), ('LIT_INT'), ('PUNC_SEMI')) t(tname), (SELECT count(*) AS cnt FROM part)""")
def lex_token_counts(spark, sf_dir):
    """Token counts of one declaration a part."""
    p = _units(_table(spark, sf_dir, "part"), "p_partkey", "concat('int v', p_partkey, ' = ', p_size, ';')")
    return p.raw_tokens.groupBy("tname").agg(F.count("*").alias("cnt"))


@query("""
SELECT o_orderkey AS unit_id, k AS literal, CASE k WHEN 0 THEN (o_orderkey % 100000 + 1)::VARCHAR || 'UL' ELSE '0x' || lower(to_hex(o_orderkey)) END AS value
FROM orders, (VALUES (0), (1)) t(k)""")
def lex_int_literals(spark, sf_dir):
    """Decimal and hexadecimal literals keep their spelling, suffix and all."""
    p = _units(_table(spark, sf_dir, "orders"), "o_orderkey", "concat('long a = ', o_orderkey % 100000 + 1, 'UL, b = 0x', lower(hex(o_orderkey)), ';')")
    found = code.literals(p.raw_marked).where("literal_kind = 'LIT_INT'")
    nth = F.row_number().over(Window.partitionBy("unit_id").orderBy("tok_ix")) - 1
    return found.select("unit_id", nth.alias("literal"), "value")


@query("SELECT n_nationkey AS unit_id, n_name AS name, length(n_name) + 2 AS width FROM nation")
def lex_strings(spark, sf_dir):
    """String literals give back what was put in."""
    p = _units(_table(spark, sf_dir, "nation"), "n_nationkey", """concat('char *n = "', n_name, '";')""")
    return p.raw_tokens.where("tname = 'LIT_STRING'").select("unit_id", F.expr("substring(src, 2, length(src) - 2)").alias("name"), (F.col("end") - F.col("start")).alias("width"))


@query("""
SELECT c_custkey AS unit_id, 'TRIVIA_BLOCK_COMMENT' AS tname, '/* ' || c_mktsegment || ' */' AS src, 'int' AS before FROM customer
UNION ALL SELECT c_custkey, 'TRIVIA_LINE_COMMENT', '// ' || c_custkey, 'y' FROM customer""")
def lex_comments(spark, sf_dir):
    """Comments hang on the token that follows them."""
    p = _units(_table(spark, sf_dir, "customer"), "c_custkey", "concat('/* ', c_mktsegment, ' */ int x, // ', c_custkey, '\\n y;')")
    return p.raw_tokens.select("unit_id", F.col("src").alias("before"), F.explode("leading").alias("t")).select("unit_id", "t.tname", "t.src", "before")


@query("""
SELECT p_partkey AS unit_id, length(p_brand) + 11 AS start, length(p_brand) + 12 + length(p_partkey::VARCHAR) AS stop, 2 AS line, 7 AS col FROM part""")
def lex_spans(spark, sf_dir):
    """Offsets, lines and columns of an identifier after a comment line."""
    p = _units(_table(spark, sf_dir, "part"), "p_partkey", "concat('/*', p_brand, '*/\\n', 'short v', p_partkey, ';')")
    return p.raw_tokens.where("tname = 'ID'").select("unit_id", "start", F.col("end").alias("stop"), "line", "col")


@query("SELECT s_suppkey AS unit_id, 'KW_INT' AS first_name, 'ID' AS second_name, 'int_' || s_suppkey AS second_src FROM supplier")
def keyword_vs_ident(spark, sf_dir):
    """A keyword inside a longer word is no keyword."""
    p = _units(_table(spark, sf_dir, "supplier"), "s_suppkey", "concat('int int_', s_suppkey, ';')")
    t = p.raw_tokens.groupBy("unit_id").agg(F.max(F.when(F.col("tok_ix") == 0, F.col("tname"))).alias("first_name"), F.max(F.when(F.col("tok_ix") == 1, F.col("tname"))).alias("second_name"), F.max(F.when(F.col("tok_ix") == 1, F.col("src"))).alias("second_src"))
    return t.select("unit_id", "first_name", "second_name", "second_src")


@query("""
SELECT tname, n * cnt AS cnt FROM (VALUES ('PUNC_LSHIFT_ASSIGN', 1), ('PUNC_ARROW', 1), ('PUNC_ELLIPSIS', 1), ('PUNC_PLUS_PLUS', 1), ('PUNC_PLUS', 1), ('PUNC_SEMI', 4), ('PUNC_LBRACKET_ALT', 1)) t(tname, n), (SELECT count(*) AS cnt FROM lineitem)""")
def punct_counts(spark, sf_dir):
    """The longest punctuator wins."""
    p = _units(_table(spark, sf_dir, "lineitem"), "concat(l_orderkey, '-', l_linenumber)", "concat('a', l_orderkey, ' <<= b; c->d; e ... ; f+++g <: ;')")
    return p.raw_tokens.where("tname LIKE 'PUNC%'").groupBy("tname").agg(F.count("*").alias("cnt"))


@query("""
SELECT p_partkey AS unit_id, 'M' || p_partkey AS macro_name, CASE WHEN p_size % 2 = 0 THEN 'function-like' ELSE 'object-like' END AS macro_kind,
CASE WHEN p_size % 2 = 0 THEN 'a,b' ELSE '' END AS params, p_size % 2 = 0 AS macro_variadic, CASE WHEN p_size % 2 = 0 THEN '( a + ' || p_size || ' )' ELSE p_size::VARCHAR END AS macro_body FROM part""")
def pp_define(spark, sf_dir):
    """Object-like and function-like macros, parameters, variadics, bodies."""
    src = "concat('#define M', p_partkey, if(p_size % 2 = 0, '(a, b, ...) (a + ', ' '), p_size, if(p_size % 2 = 0, ')', ''), '\\nint x;\\n')"
    found = preprocessor.defines(_units(_table(spark, sf_dir, "part"), "p_partkey", src).directives)
    return found.select("unit_id", "macro_name", "macro_kind", F.array_join("macro_params", ",").alias("params"), "macro_variadic", "macro_body")


_EVENT_OPS = "CASE WHEN event_id % 3 = 0 THEN 'define' WHEN event_id % 3 = 1 THEN 'undef' ELSE 'use' END"


@query(f"""
WITH e AS (SELECT user_id, event_id, 'N' || (event_id % 5) AS name, {_EVENT_OPS} AS op FROM events),
l AS (SELECT *, last_value(CASE WHEN op <> 'use' THEN op END IGNORE NULLS) OVER (PARTITION BY user_id, name ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS op_before FROM e)
SELECT user_id AS unit_id, name, count(*) AS uses, count(*) FILTER (op_before = 'define') AS macro_uses FROM l WHERE op = 'use' GROUP BY user_id, name""")
def macro_asof(spark, sf_dir):
    """A name is a macro from its define to its undef: an as-of lookup over the lines of each unit."""
    name = "concat('N', event_id % 5)"
    line = f"CASE {_EVENT_OPS} WHEN 'define' THEN concat('#define ', {name}, ' 1\\n') WHEN 'undef' THEN concat('#undef ', {name}, '\\n') ELSE concat('int v = ', {name}, ';\\n') END"
    lines = _table(spark, sf_dir, "events").selectExpr("user_id", "event_id", f"{line} AS line")
    src = lines.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "").alias("src"))
    p = Program(src.select(F.col("user_id").alias("unit_id"), "src"))
    uses = preprocessor.macro_uses(p.kept_tokens, preprocessor.directives(p.kept_tokens)).where("name <> 'v'")
    return uses.groupBy("unit_id", "name").agg(F.count("*").alias("uses"), F.count_if("is_macro").alias("macro_uses"))


@query("""
SELECT s_suppkey AS unit_id, k AS line, CASE k WHEN 1 THEN 'include' ELSE 'include_next' END AS include_form, CASE k WHEN 1 THEN 'system' ELSE 'local' END AS header_kind,
CASE k WHEN 1 THEN 'sys/s' || s_suppkey || '.h' ELSE 'n' || s_nationkey || '.h' END AS header_name FROM supplier, (VALUES (1), (2)) t(k)""")
def pp_include(spark, sf_dir):
    """Header names of both forms, never taken apart into operators."""
    src = """concat('#include <sys/s', s_suppkey, '.h>\\n# include_next "n', s_nationkey, '.h"\\nint a = b < c;\\n')"""
    found = preprocessor.includes(_units(_table(spark, sf_dir, "supplier"), "s_suppkey", src).directives)
    return found.select("unit_id", "line", "include_form", "header_kind", "header_name")


@query("""
SELECT kind, directive, cnt FROM (VALUES ('pragma_directive', 'pragma'), ('error_directive', 'error'), ('warning_directive', 'warning'), ('line_directive', 'line'), ('unknown_directive', 'ident')) t(kind, directive), (SELECT count(*) AS cnt FROM nation)""")
def pp_simple_directives(spark, sf_dir):
    src = """concat('#pragma once\\n#error "', n_name, '"\\n#warning w\\n#line 7\\n#ident x\\nint y;')"""
    p = _units(_table(spark, sf_dir, "nation"), "n_nationkey", src)
    return p.directives.groupBy("kind", "directive").agg(F.count("*").alias("cnt"))


@query("""
WITH r AS (SELECT n_regionkey AS unit_id, count(*) AS n FROM nation GROUP BY 1)
SELECT unit_id, 'ifdef' AS branch_kind, 1 AS depth, 'R' || unit_id AS condition, 1 AS n_decls FROM r
UNION ALL SELECT unit_id, 'else', 1, '', n + 1 FROM r
UNION ALL SELECT n_regionkey, 'if', 2, 'N' || n_nationkey || ' > 1', 1 FROM nation
UNION ALL SELECT n_regionkey, 'elif', 2, '2', 2 FROM nation""")
def cond_groups(spark, sf_dir):
    """Nested groups: one a region, one a nation inside its #else branch; a declaration follows each inner #endif."""
    inner = "concat('#if N', n_nationkey, ' > 1\\nint a;\\n#elif 2\\nint b; int c;\\n#endif\\nint d;\\n')"
    rows = _table(spark, sf_dir, "nation").selectExpr("n_regionkey", f"{inner} AS part").groupBy("n_regionkey").agg(F.array_join(F.collect_list("part"), "").alias("parts"))
    src = "concat('#endif\\n#ifdef R', n_regionkey, '\\nint z;\\n#else\\n', parts, 'int e;\\n#endif\\n#if open\\nint f;\\n')"
    p = Program(rows.selectExpr("n_regionkey AS unit_id", f"{src} AS src"))
    return p.conditional_branches.select("unit_id", "branch_kind", "depth", "condition", "n_decls")


@query("""
SELECT p_partkey AS unit_id, 2 + p_size % 3 AS n_types, 1 AS n_before FROM part""")
def typedef_scope(spark, sf_dir):
    """A typedef name is a type from the end of its declaration on."""
    src = "concat('int T', p_partkey, '_f(void);\\nlong T', p_partkey, ';\\ntypedef int T', p_partkey, ';\\n', repeat(concat('T', p_partkey, ' x;\\n'), int(2 + p_size % 3)))"
    p = _units(_table(spark, sf_dir, "part"), "p_partkey", src)
    own = p.tokens.where("src = concat('T', unit_id)")
    counts = own.groupBy("unit_id").agg(F.count_if(F.col("tname") == "TYPEDEF_NAME").alias("n_types"), (F.count_if(F.col("tname") == "ID") - 1).alias("n_before"))
    return counts.select("unit_id", "n_types", "n_before")


@query("""
SELECT s_suppkey AS unit_id, decl_kind, cnt FROM supplier, (VALUES ('directive', 1), ('declaration', 3), ('function_definition', 1)) t(decl_kind, cnt)""")
def decl_kinds(spark, sf_dir):
    src = "concat('#define A 1\\nint v', s_suppkey, ';\\nint f(int a) { int b = a; return b; }\\nstruct S { int m; } s;\\nint g(void);\\n')"
    p = _units(_table(spark, sf_dir, "supplier"), "s_suppkey", src)
    return p.declarations.groupBy("unit_id", "decl_kind").agg(F.count("*").alias("cnt"))


@query("""
SELECT l_orderkey AS unit_id, count(*) AS declarators, sum(l_linenumber)::BIGINT AS pointers FROM lineitem GROUP BY l_orderkey""")
def declarator_lists(spark, sf_dir):
    """One declaration an order, one declarator a line item, with as many stars as its number."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "struct(l_linenumber, concat(repeat('*', l_linenumber), 'v', l_linenumber, ' = ', int(l_quantity)) AS d) AS x")
    src = rows.groupBy("l_orderkey").agg(F.concat(F.lit("static int "), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), ", "), F.lit(";")).alias("src"))
    p = Program(src.select(F.col("l_orderkey").alias("unit_id"), "src"))
    counted = lambda p: declarations.symbols(p.raw_marked).groupBy("unit_id").agg(facade.F.count("*").alias("declarators"), facade.F.sum("pointer_depth").alias("pointers"))
    return p.by_blocks(counted, "declarators long, pointers long")


@query("""
SELECT s_suppkey AS unit_id, name || s_suppkey AS name, shape FROM supplier, (VALUES ('o', 'object'), ('a', 'array'), ('f', 'function'), ('p', 'function_pointer')) t(name, shape)""")
def decl_names(spark, sf_dir):
    """Names and shapes of declarators, the function pointer's from inside its brackets."""
    src = "concat('unsigned long o', s_suppkey, ' = 1, a', s_suppkey, '[4];\\nextern int f', s_suppkey, '(int x, char *y);\\nint (*p', s_suppkey, ')(int z) = 0;\\nstruct only { int m; };')"
    p = _units(_table(spark, sf_dir, "supplier"), "s_suppkey", src)
    return declarations.symbols(p.raw_marked).select("unit_id", "name", "shape")


@query("""
SELECT l_orderkey AS unit_id, 'O' || l_orderkey AS tag_name, 'm' || l_linenumber AS member_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ordinal,
CASE WHEN l_linenumber % 2 = 0 THEN (l_linenumber::BIGINT)::VARCHAR END AS bit_width FROM lineitem""")
def struct_members(spark, sf_dir):
    """A struct an order, a member a line item; even ones are bit-fields."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "struct(l_linenumber, concat('unsigned m', l_linenumber, if(l_linenumber % 2 = 0, concat(' : ', l_linenumber), '[2]'), '; ') AS d) AS x")
    src = rows.groupBy("l_orderkey").agg(F.concat(F.lit("struct O"), F.col("l_orderkey"), F.lit(" { "), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), ""), F.lit("} one;")).alias("src"))
    p = Program(src.select(F.col("l_orderkey").alias("unit_id"), "src"))
    return p.by_blocks(lambda p: declarations.members(p.raw_marked), "tag_name string, member_name string, ordinal long, bit_width string")


@query("""
SELECT n_regionkey AS unit_id, 'R' || n_regionkey AS tag_name, 'N' || n_nationkey AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ordinal, n_nationkey % 2 = 0 AS has_value FROM nation""")
def enum_members(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").selectExpr("n_regionkey", "struct(n_nationkey, concat('N', n_nationkey, if(n_nationkey % 2 = 0, concat(' = (1, ', n_nationkey, ')'), '')) AS d) AS x")
    src = rows.groupBy("n_regionkey").agg(F.concat(F.lit("enum R"), F.col("n_regionkey"), F.lit(" { "), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), ", "), F.lit(" };")).alias("src"))
    p = Program(src.select(F.col("n_regionkey").alias("unit_id"), "src"))
    return declarations.enumerators(p.raw_marked).select("unit_id", "tag_name", "name", "ordinal", "has_value")


@query("""
WITH c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ordinal FROM customer)
SELECT c_nationkey AS unit_id, 'f' || c_nationkey AS function, ordinal, 'c' || c_custkey AS name, 'const char * c' || c_custkey AS text, false AS variadic FROM c
UNION ALL SELECT c_nationkey, 'f' || c_nationkey, max(ordinal) + 1, NULL, '...', true FROM c GROUP BY c_nationkey""")
def fn_params(spark, sf_dir):
    """A function a nation, a parameter a customer, variadic."""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_nationkey", "struct(c_custkey, concat('const char *c', c_custkey) AS d) AS x")
    src = rows.groupBy("c_nationkey").agg(F.concat(F.lit("int f"), F.col("c_nationkey"), F.lit("("), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), ", "), F.lit(", ...);")).alias("src"))
    p = Program(src.select(F.col("c_nationkey").alias("unit_id"), "src"))
    return declarations.parameters(p.kept).select("unit_id", "function", "ordinal", "name", "text", "variadic")


@query("""
SELECT s_nationkey AS unit_id, 'f' || s_nationkey AS caller, CASE WHEN s_suppkey % 2 = 0 THEN 'M' ELSE 's' || s_suppkey END AS callee, s_suppkey % 2 = 0 AS is_macro, s_suppkey % 3 AS n_args FROM supplier""")
def call_graph(spark, sf_dir):
    """Nations call their suppliers; even ones through a macro."""
    args = "CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '(a, b)' ELSE 'a, x[i, j]' END"
    rows = _table(spark, sf_dir, "supplier").selectExpr("s_nationkey", f"concat('  ', if(s_suppkey % 2 = 0, 'M', concat('s', s_suppkey)), '(', {args}, ');\\n') AS d")
    src = rows.groupBy("s_nationkey").agg(F.concat(F.lit("#define M(x) x\nvoid f"), F.col("s_nationkey"), F.lit("(int a) {\n"), F.array_join(F.collect_list("d"), ""), F.lit("}\n")).alias("src"))
    p = Program(src.select(F.col("s_nationkey").alias("unit_id"), "src"))
    return inner.calls(p.full).select("unit_id", "caller", "callee", "is_macro", "n_args")


@query("""
SELECT l_orderkey AS unit_id, l_linenumber::BIGINT AS n, op, 'binary_expression' AS kind FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '<<' ELSE '&&' END AS op FROM lineitem)""")
def root_operator(spark, sf_dir):
    """The root of an initialiser's expression by precedence, brackets and grouping."""
    value = "CASE l_linenumber % 4 WHEN 0 THEN '-a * b + c' WHEN 1 THEN 'a + b * c - d % (e == f)' WHEN 2 THEN 'a + b << c * d' ELSE 'a | b && c + (d || e)' END"
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS unit_id", "l_linenumber", f"concat('int v', l_linenumber, ' = ', {value}, ';') AS d")
    src = rows.groupBy("unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "d"))), lambda x: x["d"]), "\n").alias("src"))
    named = lambda p: code.root_operators(p.kept).join(declarations.symbols(p.kept).select("unit_id", "decl_ix", "name"), ["unit_id", "decl_ix"])
    return Program(src).by_blocks(named, "name string, op string, kind string").select("unit_id", F.expr("bigint(substring(name, 2))").alias("n"), "op", "kind")


@query("""
SELECT op, kind, n * cnt AS cnt FROM (VALUES ('+', 'binary_expression', 1), ('*', 'binary_expression', 1), ('*', 'unary_expression', 1), ('-', 'unary_expression', 1), ('=', 'assignment_expression', 1), ('+=', 'assignment_expression', 1), ('++', 'postfix_unary_expression', 1), ('--', 'unary_expression', 1), ('?', 'conditional_expression', 1), ('->', 'member_expression', 1), ('<', 'binary_expression', 1)) t(op, kind, n), (SELECT count(*) AS cnt FROM part)""")
def operator_counts(spark, sf_dir):
    """Binary, prefix and postfix uses of the same signs are told apart."""
    src = "concat('void f', p_partkey, '(void) { a = b + c * ', p_size, '; d += *p; e++; --g; h->i; x < -y ? j : k; }')"
    p = _units(_table(spark, sf_dir, "part"), "p_partkey", src)
    return code.operators(p.raw_marked).groupBy("op", "kind").agg(F.count("*").alias("cnt"))


@query("""
SELECT kind, n * cnt AS cnt FROM (VALUES ('if_statement', 2), ('while_statement', 1), ('do_statement', 1), ('for_statement', 1), ('switch_statement', 1), ('labeled_statement', 3), ('jump_statement', 4), ('compound_statement', 3), ('asm_statement', 1)) t(kind, n), (SELECT count(*) AS cnt FROM supplier)""")
def stmt_counts(spark, sf_dir):
    src = """concat('int f(void) { if (a) b(); else if (c) { d(); } while (e) g(); do { h(); } while (i); for (;;) break; switch (j) { case 1: k(); default: continue; } out: __asm__("nop"); goto out; return ', s_suppkey, '; }')"""
    p = _units(_table(spark, sf_dir, "supplier"), "s_suppkey", src)
    return code.statements(p.raw_marked).groupBy("kind").agg(F.count("*").alias("cnt"))


@query("""
SELECT o_orderkey AS unit_id, 'case' AS label_kind, '''' || o_orderstatus || '''' AS label_name FROM orders
UNION ALL SELECT o_orderkey, 'default', NULL FROM orders UNION ALL SELECT o_orderkey, 'identifier', 'L' || o_orderkey FROM orders""")
def case_labels(spark, sf_dir):
    src = "concat('void f(void) { switch (s) { case ''', o_orderstatus, ''': g(); break; default: ; } L', o_orderkey, ': h(a ? b : c); }')"
    p = _units(_table(spark, sf_dir, "orders"), "o_orderkey", src)
    return code.labels(p.raw_marked).select("unit_id", "label_kind", "label_name")


@query("""
SELECT n_nationkey AS unit_id, jump_kind, CASE jump_kind WHEN 'goto' THEN 'L' || n_regionkey END AS label_name FROM nation, (VALUES ('return'), ('break'), ('continue'), ('goto')) t(jump_kind)""")
def jump_targets(spark, sf_dir):
    src = "concat('void f(void) { while (1) { break; continue; } goto L', n_regionkey, '; L', n_regionkey, ': return; }')"
    p = _units(_table(spark, sf_dir, "nation"), "n_nationkey", src)
    return code.jumps(p.raw_marked).select("unit_id", "jump_kind", "label_name")


@query("""
SELECT l_returnflag || l_linestatus || l_linenumber AS unit_id, CASE l_returnflag WHEN 'A' THEN 'gcc' WHEN 'N' THEN 'msvc' ELSE 'c23' END AS attribute_form, CASE WHEN l_returnflag NOT IN ('A', 'N') AND k = 1 THEN 'gnu' END AS attribute_prefix,
CASE k WHEN 0 THEN 'first' ELSE 'a' || l_linenumber END AS attribute_name, k = 1 AS has_arguments, count(*) AS cnt FROM lineitem, (VALUES (0), (1)) t(k) GROUP BY ALL""")
def attribute_forms(spark, sf_dir):
    """Attributes of the three forms, with prefixes and arguments."""
    body = "concat('first, ', if(l_returnflag IN ('A', 'N'), '', 'gnu::'), 'a', l_linenumber, '(1, x)')"
    src = f"concat(CASE l_returnflag WHEN 'A' THEN concat('__attribute__((', {body}, '))') WHEN 'N' THEN concat('__declspec(', {body}, ')') ELSE concat('[[', {body}, ']]') END, ' int v;')"
    rows = _table(spark, sf_dir, "lineitem").selectExpr("concat(l_returnflag, l_linestatus, l_linenumber) AS unit_id", f"{src} AS src").groupBy("unit_id", "src").agg(F.count("*").alias("cnt"))
    found = code.attributes(Program(rows.select("unit_id", "src")).raw_marked)
    return found.join(rows.select("unit_id", "cnt"), "unit_id").select("unit_id", "attribute_form", "attribute_prefix", "attribute_name", "has_arguments", "cnt")


@query("""
SELECT p_partkey AS unit_id, 'sizeof ( int ) == ' || p_size AS condition, CASE WHEN p_size % 2 = 0 THEN '"' || p_brand || ', (x)"' END AS message FROM part""")
def static_assertions(spark, sf_dir):
    src = """concat('_Static_assert(sizeof(int) == ', p_size, if(p_size % 2 = 0, concat(', "', p_brand, ', (x)"'), ''), ');')"""
    p = _units(_table(spark, sf_dir, "part"), "p_partkey", src)
    return inner.static_asserts(p.raw_marked).select("unit_id", "condition", "message")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ordinal FROM lineitem)
SELECT l_orderkey AS unit_id, ordinal, CASE l_linenumber % 3 WHEN 0 THEN '[' || l_linenumber || ']' WHEN 1 THEN '.m' || l_linenumber END AS designator FROM l""")
def initializer_lists(spark, sf_dir):
    """Items and designators of a brace initialiser."""
    item = "concat(CASE l_linenumber % 3 WHEN 0 THEN concat('[', l_linenumber, '] = ') WHEN 1 THEN concat('.m', l_linenumber, ' = ') ELSE '' END, 'f(1, ', l_linenumber, ')')"
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS unit_id", f"struct(l_linenumber, {item} AS d) AS x")
    src = rows.groupBy("unit_id").agg(F.concat(F.lit("struct S v = { "), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), ", "), F.lit(" };")).alias("src"))
    return Program(src).by_blocks(lambda p: code.initializer_items(p.raw_marked), "ordinal long, designator string")


@query("""
SELECT n_nationkey AS unit_id, ordinal, association_kind, type_name FROM nation, (VALUES (1, 'type', 'int'), (2, 'type', 'const char *'), (3, 'default', 'default')) t(ordinal, association_kind, type_name)""")
def generic_arms(spark, sf_dir):
    p = _units(_table(spark, sf_dir, "nation"), "n_nationkey", "concat('int x = _Generic((v', n_nationkey, ', w), int: f(1, 2), const char *: g, default: ', n_regionkey, ');')")
    return code.generic_associations(p.raw_marked).select("unit_id", "ordinal", "association_kind", "type_name")


@query("""
SELECT s_suppkey AS unit_id, 'volatile' AS qualifiers, '"mov %1, %0""\\n; ' || s_suppkey || '"' AS template, 3 AS n_sections FROM supplier""")
def asm_templates(spark, sf_dir):
    src = """concat('void f(void) { asm volatile ("mov %1, %0" "\\\\n; ', s_suppkey, '" : "=r"(a) : "r"(b ? c : d) : "cc"); x ? y : z; }')"""
    p = _units(_table(spark, sf_dir, "supplier"), "s_suppkey", src)
    return code.asm_blocks(p.raw_marked).select("unit_id", F.array_join("qualifiers", ",").alias("qualifiers"), "template", "n_sections")


@query("""
SELECT p_partkey AS unit_id, p_size % 4 = 0 AS ok, CASE p_size % 4 WHEN 1 THEN 'unterminated_comment' WHEN 2 THEN 'unterminated_string' WHEN 3 THEN 'unbalanced_brackets' END AS code FROM part""")
def parse_status(spark, sf_dir):
    """Bad input is data: the first error of each unit."""
    src = """concat('int v', p_partkey, CASE p_size % 4 WHEN 0 THEN ' = (1);' WHEN 1 THEN '; /* open' WHEN 2 THEN ' = "open' ELSE ' = (1;' END)"""
    return _units(_table(spark, sf_dir, "part"), "p_partkey", src).status.select("unit_id", "ok", "code")


def _plain_pattern() -> str:
    """The lexeme pattern without raw strings, for engines that know no back references and no possessive repeats."""
    return "|".join(f"(?:{p})" for name, p in C.CLASSES.items() if name != "raw_string").replace("*+", "*").replace("++", "+").replace("'", "''")


@query(f"""
WITH marked AS (SELECT doc_id, replace(coalesce(text, ''), chr(65535), chr(65535) || chr(65535)) AS t FROM documents),
headed AS (SELECT doc_id, regexp_replace(t, '((?:#|%:)[ \\t]*(?:include_next|include|embed)[ \\t]*)(<[^>\\n\\r]*>|"[^"\\n\\r]*")', '\\1' || chr(65535) || '\\2', 'g') AS t FROM marked),
cut AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_plain_pattern()}')) AS x FROM headed),
counted AS (SELECT doc_id, count(*) AS words FROM cut WHERE regexp_full_match(x, '[A-Za-z_$][A-Za-z0-9_$]*') GROUP BY doc_id)
SELECT doc_id AS unit_id, CASE WHEN bool_or(contains(coalesce(text, ''), 'R"')) THEN NULL ELSE coalesce(max(words), 0) END AS words FROM documents LEFT JOIN counted USING (doc_id) GROUP BY doc_id""")
def lex_documents(spark, sf_dir):
    """Words of every document, lexed whole as if it were source; null where a raw string may begin, which SQL can't follow to its end."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.coalesce("text", F.lit("")).alias("src"))
    found = Program(docs).lexemes.where("cls = 'word'").groupBy("unit_id").agg(F.count("*").alias("words"))
    raw = docs.groupBy("unit_id").agg(F.max(F.col("src").contains('R"')).alias("raw"))
    return raw.join(found, "unit_id", "left").select("unit_id", F.when(~F.col("raw"), F.coalesce("words", F.lit(0))).alias("words"))


@query("""
SELECT o_orderkey AS unit_id, word, place, CASE word WHEN 'if' THEN 'f ( a ) > ' || (o_custkey) WHEN 'while' THEN 'a' WHEN 'switch' THEN 's' ELSE CASE place WHEN 0 THEN 'int i = 0' WHEN 1 THEN 'i < ' || o_custkey ELSE 'i ++' END END AS text
FROM orders, (VALUES ('if', 0), ('while', 0), ('switch', 0), ('for', 0), ('for', 1), ('for', 2)) t(word, place)""")
def branch_conditions(spark, sf_dir):
    """Conditions of branches and loops, and the three parts of a for."""
    src = "concat('void f(void) { if (f(a) > ', o_custkey, ') g((b), c); while (a) ; switch (s) { } for (int i = 0; i < ', o_custkey, '; i++) h(i); }')"
    p = _units(_table(spark, sf_dir, "orders"), "o_orderkey", src)
    return p.by_blocks(lambda p: spans.conditions(p.raw_marked), "word string, place long, text string")


@query("""
SELECT p_partkey AS unit_id, kind, CASE kind WHEN 'cast' THEN 'T' || p_partkey || ' *' WHEN 'compound_literal' THEN 'struct S' WHEN 'operand of sizeof' THEN 'int [ ' || p_size || ' ]' ELSE 'double' END AS type_name
FROM part, (VALUES ('cast'), ('compound_literal'), ('operand of sizeof'), ('operand of _Alignof')) t(kind)""")
def type_name_uses(spark, sf_dir):
    """Casts, compound literals, sizeof and _Alignof of types; brackets around values are none."""
    src = "concat('typedef int T', p_partkey, ';\nvoid f(int z) { a = (T', p_partkey, ' *) b; c = (d) + e; g = (struct S) { 1 }; h = sizeof(int[', p_size, ']) + sizeof(i) + _Alignof(double); }')"
    p = _units(_table(spark, sf_dir, "part"), "p_partkey", src)
    return p.by_blocks(lambda p: spans.type_names(p.marked), "kind string, type_name string")


@query("""
SELECT l_orderkey AS unit_id, 'a' || l_linenumber AS name, ordinal, CASE ordinal WHEN 0 THEN l_linenumber || ' + 1' ELSE '' END AS size FROM lineitem, (VALUES (0), (1)) t(ordinal)""")
def array_bounds(spark, sf_dir):
    """Sizes of arrays, in order, empty brackets too."""
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS unit_id", "struct(l_linenumber, concat('a', l_linenumber, '[', l_linenumber, ' + 1][] = { b[0] }') AS d) AS x")
    src = rows.groupBy("unit_id").agg(F.concat(F.lit("int "), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), ", "), F.lit(", plain;")).alias("src"))
    return Program(src).by_blocks(lambda p: spans.array_sizes(p.kept), "name string, ordinal long, size string")


@query("""
SELECT s_suppkey AS unit_id, ordinal, word, role FROM supplier, (VALUES (0, 'static', 'storage'), (1, 'const', 'qualifier'), (2, 'unsigned', 'type'), (3, 'long', 'type')) t(ordinal, word, role)
UNION ALL SELECT s_suppkey, 0, 'struct', 'type' FROM supplier UNION ALL SELECT s_suppkey, 1, 'S' || s_suppkey, 'tag' FROM supplier""")
def specifier_words(spark, sf_dir):
    """Storage, qualifiers and types before the declarators, tags among them."""
    p = _units(_table(spark, sf_dir, "supplier"), "s_suppkey", "concat('static const unsigned long a', s_suppkey, ' = sizeof(int), *const b;\nstruct S', s_suppkey, ' c;')")
    return spans.specifiers(p.kept).select("unit_id", "ordinal", "word", "role")


@query("""
SELECT n_nationkey AS unit_id, object, op, member_name FROM nation, (VALUES ('a', '.', 'x'), (']', '->', 'y'), ('y', '.', 'z'), (')', '.', 'w')) t(object, op, member_name)""")
def member_accesses(spark, sf_dir):
    p = _units(_table(spark, sf_dir, "nation"), "n_nationkey", "concat('void f(void) { a.x = b[', n_nationkey, ']->y.z + g(1).w - .5; } struct S s = { .m = 1 };')")
    return spans.member_uses(p.raw_marked).select("unit_id", "object", "op", "member_name")


@query("""
SELECT s_suppkey AS unit_id, section, ordinal, constraint_text AS "constraint", CASE WHEN v = 'n' THEN 'x [ ' || s_suppkey || ' ]' ELSE v END AS value
FROM supplier, (VALUES (1, 0, '"=r"', 'a'), (1, 1, '"=m"', '* p'), (2, 0, '"r"', 'n'), (3, 0, '"cc"', ''), (3, 1, '"memory"', '')) t(section, ordinal, constraint_text, v)""")
def asm_operand_list(spark, sf_dir):
    """Outputs, inputs and clobbers of an asm statement."""
    src = """concat('void f(void) { __asm__ volatile ("nop" : "=r" (a), "=m" (*p) : "r" (x[', s_suppkey, ']) : "cc", "memory"); g(b, c); }')"""
    p = _units(_table(spark, sf_dir, "supplier"), "s_suppkey", src)
    return spans.asm_operands(p.raw_marked).select("unit_id", "section", "ordinal", "constraint", "value")


@query("""
SELECT p_partkey AS unit_id, literal, src FROM (SELECT p_partkey, unnest([{'l': 0, 's': p_size || '.5e-3f'}, {'l': 1, 's': '.' || p_size}, {'l': 2, 's': '0x1.8p' || p_size}, {'l': 3, 's': p_size || '.'}]) AS x FROM part) t, LATERAL (SELECT x.l AS literal, x.s AS src)""")
def lex_float_literals(spark, sf_dir):
    """Floating literals in decimal and hexadecimal, with exponents and suffixes."""
    src = "concat('double a = ', p_size, '.5e-3f, b = .', p_size, ', c = 0x1.8p', p_size, ', d = ', p_size, '.;')"
    found = _units(_table(spark, sf_dir, "part"), "p_partkey", src).raw_tokens.where("tname = 'LIT_FLOAT'")
    nth = F.row_number().over(Window.partitionBy("unit_id").orderBy("tok_ix")) - 1
    return found.select("unit_id", nth.alias("literal"), "src")


@query("""
SELECT c_custkey AS unit_id, 'v' || c_custkey AS src, 2 AS line, 1 AS col, 'TRIVIA_LINE_CONT' AS trivia FROM customer""")
def lex_line_conts(spark, sf_dir):
    """A continued line is trivia of the token after it, which is on the next line."""
    found = _units(_table(spark, sf_dir, "customer"), "c_custkey", "concat('int \\\\', '\\n', 'v', c_custkey, ';')").raw_tokens.where("size(leading) > 0")
    return found.select("unit_id", "src", "line", "col", F.col("leading")[0]["tname"].alias("trivia"))


@query("""
SELECT s_suppkey AS unit_id, name, tname FROM supplier, (VALUES ('u32', 'TYPEDEF_NAME'), ('x', 'ID'), ('other', 'ID'), ('y', 'ID')) t(name, tname)""")
def predefined_types(spark, sf_dir):
    """Type names that are known before a unit begins."""
    units = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS unit_id", "'u32 x; other y;' AS src")
    return Program(units, ["u32"]).tokens.where("tname IN ('ID', 'TYPEDEF_NAME')").select("unit_id", F.col("src").alias("name"), "tname")


@query("SELECT 'quern' AS name, '0.1.0' AS version, 'C23' AS language")
def engine_version(spark, sf_dir):
    return engine_info(spark)


@query("""
SELECT c_custkey AS unit_id, c_custkey % 3 <> 0 AS ok, CASE WHEN c_custkey % 3 = 0 THEN 'invalid_utf8' END AS code FROM customer""")
def utf8_codes(spark, sf_dir):
    """Sources with bytes that are no UTF-8 are told."""
    content = "if(c_custkey % 3 = 0, unhex('696E74FF'), cast(concat('int é', c_custkey) AS binary))"
    return utf8_status(_table(spark, sf_dir, "customer").selectExpr("c_custkey AS path", f"{content} AS content"))


@query("""
SELECT s_suppkey AS unit_id, false AS ok, 'unterminated_header_name' AS code, 9 AS pos FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey, true, NULL, NULL FROM supplier WHERE s_suppkey % 2 = 1""")
def header_status(spark, sf_dir):
    """A header name without its end is an error; one after very many blanks is none."""
    src = "concat('#include', if(s_suppkey % 2 = 0, ' ', repeat(' ', int(30 + s_suppkey))), '<a', s_suppkey, if(s_suppkey % 2 = 0, '\\n', '.h>\\n'))"
    return _units(_table(spark, sf_dir, "supplier"), "s_suppkey", src).status.select("unit_id", "ok", "code", F.col("pos").cast("int").alias("pos"))


@query("""
SELECT s_suppkey AS unit_id, 'macro' AS header_kind, 'H ( ' || s_nationkey || ' )' AS header_name FROM supplier""")
def header_macro_form(spark, sf_dir):
    found = preprocessor.includes(_units(_table(spark, sf_dir, "supplier"), "s_suppkey", "concat('#include H(', s_nationkey, ')\\nint x;\\n')").directives)
    return found.select("unit_id", "header_kind", "header_name")


@query("""
SELECT s_suppkey AS unit_id, name, decl_kind, shape, pointer_depth FROM supplier, (VALUES ('old', 'function_definition', 'function', 0), ('g', 'declaration', 'function', 0), ('h', 'declaration', 'function', 1), ('fp', 'declaration', 'function_pointer', 1), ('after', 'declaration', 'object', 0)) t(name, decl_kind, shape, pointer_depth)""")
def old_style_definitions(spark, sf_dir):
    """A definition with declared parameters is one declaration; brackets round a name alone make no pointer."""
    src = "concat('int old(a, b) int a; char *b, c[', s_suppkey, ']; { return a; }\\nint (g)(int v); char *(h)(void); int (*fp)(int); int after;')"
    p = _units(_table(spark, sf_dir, "supplier"), "s_suppkey", src)
    return declarations.symbols(p.raw_marked).select("unit_id", "name", "decl_kind", "shape", F.col("pointer_depth").cast("int").alias("pointer_depth"))


@query("""
SELECT s_suppkey AS unit_id, name, ordinal, param FROM supplier, (VALUES ('old', 0, 'a'), ('old', 1, 'b'), ('proto', 0, 'x'), ('proto', 1, 'y')) t(name, ordinal, param)""")
def identifier_lists(spark, sf_dir):
    """Parameter names of old-style lists, in a definition and in a declaration."""
    src = "concat('int old(a, b) int a; char *b; { return ', s_suppkey, '; }\\nint proto(x, y);')"
    p = _units(_table(spark, sf_dir, "supplier"), "s_suppkey", src)
    return declarations.parameters(p.kept).select("unit_id", F.col("function").alias("name"), F.col("ordinal").cast("int").alias("ordinal"), F.coalesce("name", "text").alias("param"))


@query("""
SELECT c_nationkey AS unit_id, 'v' || c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'array' WHEN 1 THEN 'object' ELSE 'function_pointer' END AS shape, CASE c_custkey % 3 WHEN 0 THEN 0 ELSE 1 END AS pointer_depth, CASE WHEN c_custkey % 3 = 1 THEN 'static' END AS storage FROM customer
UNION ALL SELECT DISTINCT c_nationkey, 'i', 'object', 0, NULL FROM customer UNION ALL SELECT DISTINCT c_nationkey, 't', 'object', 0, NULL FROM customer""")
def local_declarations(spark, sf_dir):
    """Declarations in bodies and in the head of a for: a function a nation, a variable a customer."""
    line = "CASE c_custkey % 3 WHEN 0 THEN concat('int v', c_custkey, '[3]; f(a, b);') WHEN 1 THEN concat('static char *v', c_custkey, ' = g(x, y); x * y;') ELSE concat('int (*v', c_custkey, ')(int w); if (x) { z = 1; }') END"
    rows = _table(spark, sf_dir, "customer").selectExpr("c_nationkey AS unit_id", f"struct(c_custkey, {line} AS d) AS x")
    src = rows.groupBy("unit_id").agg(F.concat(F.lit("typedef int T; void f(int q) { for (int i = 0; i < 3; i++) { T t; } "), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), " "), F.lit(" }")).alias("src"))
    return inner.local_symbols(Program(src).full).select("unit_id", "name", "shape", F.col("pointer_depth").cast("int").alias("pointer_depth"), "storage")


@query("""
SELECT s_suppkey AS unit_id, callee, callee_kind, n_args FROM supplier, (VALUES ('m', 'member', 1), (NULL, 'call', 1), (NULL, 'indirect', 2), (NULL, 'subscript', 1), ('g', 'name', 0)) t(callee, callee_kind, n_args)""")
def indirect_calls(spark, sf_dir):
    """Calls through members, results, pointers and arrays; a cast and a condition are none."""
    src = "concat('void f(void) { q->m(6)(', s_suppkey, '); (*p)(1, 2); a[3](4); b = (int)(c); if (d) (e); while (g()) (h); }')"
    return inner.calls(_units(_table(spark, sf_dir, "supplier"), "s_suppkey", src).full).select("unit_id", "callee", "callee_kind", F.col("n_args").cast("int").alias("n_args"))


@query("""
SELECT p_partkey AS unit_id, object, idx FROM (SELECT p_partkey, unnest([{'o': 'a', 'i': 'i + b [ ' || p_size || ' ]'}, {'o': 'b', 'i': p_size::VARCHAR}, {'o': ')', 'i': '0'}, {'o': ']', 'i': 'j , k'}]) AS x FROM part) t, LATERAL (SELECT x.o AS object, x.i AS idx)""")
def subscript_uses(spark, sf_dir):
    """Subscripts, nested and in a row; sizes of arrays and designators are none."""
    src = "concat('void f(void) { int n[4], m[2][3]; x = a[i + b[', p_size, ']]; y = g(1)[0][j, k]; } int t[2] = { [1] = 5 };')"
    return _units(_table(spark, sf_dir, "part"), "p_partkey", src).by_blocks(lambda p: inner.subscripts(p.full), "object string, index string").withColumnRenamed("index", "idx")


@query("""
SELECT l_orderkey AS unit_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ordinal, CASE l_linenumber % 3 WHEN 0 THEN '[' || l_linenumber || '].m' WHEN 1 THEN '.a[' || l_linenumber || '].b' ELSE '[1...' || l_linenumber || ']' END AS designator FROM lineitem""")
def chained_designators(spark, sf_dir):
    """Designators of several steps, and of a range."""
    item = "concat(CASE l_linenumber % 3 WHEN 0 THEN concat('[', l_linenumber, '].m') WHEN 1 THEN concat('.a[', l_linenumber, '].b') ELSE concat('[1 ... ', l_linenumber, ']') END, ' = ', l_linenumber)"
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS unit_id", f"struct(l_linenumber, {item} AS d) AS x")
    src = rows.groupBy("unit_id").agg(F.concat(F.lit("struct S v = { "), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), ", "), F.lit(" };")).alias("src"))
    return Program(src).by_blocks(lambda p: code.initializer_items(p.raw_marked), "ordinal long, designator string")


@query("""
SELECT o_orderkey AS unit_id, label_name FROM (SELECT o_orderkey, unnest(['( A + ' || o_custkey || ' )', '1 ... ' || (o_custkey + 1), 'x ? y : ' || o_custkey]) AS label_name FROM orders)""")
def case_values(spark, sf_dir):
    """Whole values of case labels: expressions, ranges, conditionals."""
    src = "concat('void f(void) { switch (s) { case (A + ', o_custkey, '): g(); case 1 ... ', o_custkey + 1, ': break; case x ? y : ', o_custkey, ': h(); } }')"
    return _units(_table(spark, sf_dir, "orders"), "o_orderkey", src).by_blocks(lambda p: code.labels(p.raw_marked), "label_name string")


@query("""
SELECT p_partkey AS unit_id, member_name, bit_width FROM (SELECT p_partkey, unnest([{'m': 'x', 'w': '1 + ' || p_size}, {'m': 'y', 'w': 'N'}, {'m': 'z', 'w': NULL}, {'m': 'w', 'w': '( 2 , 3 )'}]) AS x FROM part) t, LATERAL (SELECT x.m AS member_name, x.w AS bit_width)""")
def bitfield_widths(spark, sf_dir):
    """Widths of bit-fields are whole expressions."""
    src = "concat('struct S { int x : 1+', p_size, ', y : N; char z[2]; int w : (2, 3); };')"
    return declarations.members(_units(_table(spark, sf_dir, "part"), "p_partkey", src).kept).select("unit_id", "member_name", "bit_width")


@query("""
SELECT s_suppkey AS unit_id, 'E' || s_suppkey AS tag_name, CASE WHEN s_suppkey % 2 = 0 THEN 'unsigned char' END AS underlying, 2 AS n, 1 AS n_valued FROM supplier""")
def enum_types(spark, sf_dir):
    """The type of an enum, and enumerators with attributes."""
    src = "concat('enum E', s_suppkey, if(s_suppkey % 2 = 0, ' : unsigned char', ''), ' { A __attribute__((deprecated)) = 1, B __attribute__((unused)) };')"
    p = _units(_table(spark, sf_dir, "supplier"), "s_suppkey", src)
    held = declarations.enumerators(p.kept).groupBy("unit_id", "tag_name").agg(F.count("*").alias("n"), F.count_if("has_value").alias("n_valued"))
    return declarations.tags(p.kept).select("unit_id", "tag_name", "underlying").join(held, ["unit_id", "tag_name"])


@query("""
SELECT s_suppkey AS unit_id, section, operand_name, value FROM supplier, (VALUES (1, 'res', 'x'), (2, NULL, 'y'), (2, 'in', 'z [ 1 ]'), (4, NULL, 'out')) t(section, operand_name, value)""")
def asm_names(spark, sf_dir):
    """Names of asm operands, and labels that an asm goto may jump to."""
    src = """concat('void f(void) { asm goto ("nop ', s_suppkey, '" : [res] "=r" (x) : "r" (y), [in] "r" (z[1]) : : out); out: ; }')"""
    found = spans.asm_operands(_units(_table(spark, sf_dir, "supplier"), "s_suppkey", src).raw_marked)
    return found.select("unit_id", F.col("section").cast("int").alias("section"), "operand_name", "value")


@query("""
SELECT p_partkey AS unit_id, attribute_name, arguments FROM (SELECT p_partkey, unnest([{'n': 'aligned', 'a': p_size::VARCHAR}, {'n': 'format', 'a': 'printf , 1 , ( 2 )'}, {'n': 'unused', 'a': NULL}]) AS x FROM part) t, LATERAL (SELECT x.n AS attribute_name, x.a AS arguments)""")
def attribute_arguments(spark, sf_dir):
    src = "concat('__attribute__((aligned(', p_size, '), format(printf, 1, (2)), unused)) int v;')"
    return code.attributes(_units(_table(spark, sf_dir, "part"), "p_partkey", src).raw_marked).select("unit_id", "attribute_name", "arguments")


@query("""
SELECT p_partkey AS unit_id, depth, n::BIGINT AS n FROM part, (VALUES (0, 1), (1, 3)) t(depth, n)""")
def comma_uses(spark, sf_dir):
    """Commas that are operators: not those between arguments, declarators, or items of a list."""
    src = "concat('void f(int p, int q) { int a, b[2] = { 1, 2 }; for (int i = 0, j = 1; i; i++, j--) g(a, b); (a, ', p_size, '); x = 1, y = 2; z = (S){ 3, 4 }; w = t[c, d]; }')"
    counted = lambda p: inner.comma_operators(p.full).groupBy("unit_id", "depth").agg(facade.F.count("*").alias("n"))
    return _units(_table(spark, sf_dir, "part"), "p_partkey", src).by_blocks(counted, "depth int, n long")


@query("""
SELECT s_suppkey AS unit_id, word, n::BIGINT AS n FROM supplier, (VALUES ('a', 1), ('g', 3), ('(', 1), ('++', 1), (';', 1)) t(word, n)""")
def expression_statements(spark, sf_dir):
    """Statements that are expressions, after conditions, labels and braces too; an empty one counts."""
    src = "concat('int f(void) { int v = 1; a = x ? y : ', s_suppkey, '; if (b) g(); else g(c); L: g(d); (*p)(1); for (i = 0; i; i++) ++j; ; return (S){ 1 }.m; }')"
    found = inner.expression_statements(_units(_table(spark, sf_dir, "supplier"), "s_suppkey", src).full)
    return found.groupBy("unit_id", F.col("first").alias("word")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS unit_id, 1 AS depth FROM nation UNION ALL SELECT n_nationkey, 2 FROM nation")
def statement_expressions(spark, sf_dir):
    src = "concat('void f(void) { a = ({ int t = ', n_regionkey, '; t; }); g(({ h(); })); { k(); } }')"
    return inner.statement_expressions(_units(_table(spark, sf_dir, "nation"), "n_nationkey", src).raw_marked).select("unit_id", F.col("depth").cast("int").alias("depth"))


@query("SELECT n_nationkey AS unit_id, '( v' || n_nationkey || ' , w )' AS control FROM nation")
def generic_controls(spark, sf_dir):
    src = "concat('int x = _Generic((v', n_nationkey, ', w), int: f(1, 2), default: ', n_regionkey, ');')"
    return inner.generic_selections(_units(_table(spark, sf_dir, "nation"), "n_nationkey", src).raw_marked).select("unit_id", "control")


@query("""
SELECT s_suppkey AS unit_id, name, level, qualifiers FROM supplier, (VALUES ('p', 0, 'const'), ('p', 1, 'volatile restrict'), ('q', 0, '')) t(name, level, qualifiers)""")
def pointer_qualifiers(spark, sf_dir):
    """Qualifiers of each star, not those of the type."""
    src = "concat('const int *const *volatile restrict p, *q, r', s_suppkey, ';')"
    return inner.pointer_levels(_units(_table(spark, sf_dir, "supplier"), "s_suppkey", src).kept).select("unit_id", "name", F.col("level").cast("int").alias("level"), "qualifiers")


@query("SELECT s_suppkey AS unit_id, word FROM supplier, (VALUES ('static'), ('const')) t(word)")
def array_qualifiers(spark, sf_dir):
    src = "concat('void f(int a[static const ', s_suppkey, '], int b[3]);')"
    return inner.array_qualifiers(_units(_table(spark, sf_dir, "supplier"), "s_suppkey", src).raw_marked).select("unit_id", "word")


@query("SELECT p_partkey AS unit_id, p_size || ' + 1' AS width FROM part")
def bit_int_widths(spark, sf_dir):
    src = "concat('unsigned _BitInt(', p_size, ' + 1) v;')"
    return inner.bit_int_widths(_units(_table(spark, sf_dir, "part"), "p_partkey", src).raw_marked).select("unit_id", "width")


@query("""
SELECT p_partkey AS unit_id, literal_kind, value FROM (SELECT p_partkey, unnest([{'k': 'LIT_STRING', 'v': '"' || p_brand || '""b"'}, {'k': 'KW_TRUE', 'v': 'true'}, {'k': 'KW_NULLPTR', 'v': 'nullptr'}]) AS x FROM part) t, LATERAL (SELECT x.k AS literal_kind, x.v AS value)""")
def string_atoms(spark, sf_dir):
    """Strings that touch are one; constants are literals too."""
    src = """concat('char *s = "', p_brand, '" /* c */ "b"; bool t = true; void *n = nullptr;')"""
    return code.literals(_units(_table(spark, sf_dir, "part"), "p_partkey", src).raw_marked).select("unit_id", "literal_kind", "value")


@query("""
SELECT p_partkey AS unit_id, 'sizeof ( int ) == ' || p_size AS condition, '"in"' AS message, true AS in_body FROM part UNION ALL SELECT p_partkey, 'A', NULL, false FROM part""")
def body_assertions(spark, sf_dir):
    """Static assertions in a body and outside."""
    src = """concat('_Static_assert(A); void f(void) { int x; _Static_assert(sizeof(int) == ', p_size, ', "in"); g(1, 2); }')"""
    return inner.static_asserts(_units(_table(spark, sf_dir, "part"), "p_partkey", src).raw_marked).select("unit_id", "condition", "message", "in_body")


_OPERATORS = "|| && | ^ & == != < <= > >= << >> + - * / %".split()
_OPERATOR_ROWS = ", ".join(f"({k}, '{op}', {C.PRECEDENCE[op]})" for k, op in enumerate(_OPERATORS))


@query(f"""
WITH o(i, op, s) AS (VALUES {_OPERATOR_ROWS}),
e AS (SELECT p_partkey AS unit_id, a.op AS o1, a.s AS s1, b.op AS o2, b.s AS s2, c.op AS o3, c.s AS s3 FROM part
    JOIN o a ON a.i = p_size % 18 JOIN o b ON b.i = p_partkey % 18 JOIN o c ON c.i = (p_size + p_partkey) % 18)
SELECT unit_id, 1 AS place, o1 AS op, CASE WHEN s2 <= s1 THEN 2 WHEN s3 <= s1 THEN 3 END AS parent, CASE WHEN s2 <= s1 OR s3 <= s1 THEN 'left' END AS side FROM e
UNION ALL SELECT unit_id, 2, o2, CASE WHEN s1 < s2 AND (s3 > s2 OR s1 >= s3) THEN 1 WHEN s3 <= s2 THEN 3 END, CASE WHEN s1 < s2 AND (s3 > s2 OR s1 >= s3) THEN 'right' WHEN s3 <= s2 THEN 'left' END FROM e
UNION ALL SELECT unit_id, 3, o3, CASE WHEN s2 < s3 THEN 2 WHEN s1 < s3 THEN 1 END, CASE WHEN s2 < s3 OR s1 < s3 THEN 'right' END FROM e""")
def expression_trees(spark, sf_dir):
    """Three binary operators taken from the columns: the parent of each follows from their strengths."""
    op = lambda k: f"element_at(array({', '.join(repr(o) for o in _OPERATORS)}), int({k} % 18) + 1)"
    src = f"concat('int v = a ', {op('p_size')}, ' b ', {op('p_partkey')}, ' c ', {op('(p_size + p_partkey)')}, ' d;')"
    found = trees.expressions(_units(_table(spark, sf_dir, "part"), "p_partkey", src).full).where("kind = 'binary_expression'")
    place = lambda c: ((F.col(c) - 2) / 2).cast("int")
    return found.select("unit_id", place("node_ix").alias("place"), "op", place("parent_ix").alias("parent"), "side")


@query("""
SELECT s_suppkey AS unit_id, op, parent_op, side, slot FROM supplier, (VALUES
    ('=', NULL, NULL, 'statement'), ('+=', '=', 'right', NULL), ('?', '+=', 'right', NULL), (',', '?', 'then', NULL), ('?', '?', 'else', NULL),
    ('-', NULL, NULL, 'statement'), ('*', '-', 'operand', NULL), ('++', '.', 'object', NULL), ('.', '[', 'object', NULL), ('[', '(', 'callee', NULL), ('+', '[', 'index', NULL), ('(', '*', 'operand', NULL), ('_Alignof', '(', 'argument', NULL)
) t(op, parent_op, side, slot)""")
def expression_shapes(spark, sf_dir):
    """Assignments and conditionals group from the right, prefix operators take all postfix ones, arguments and indexes hang on their brackets."""
    src = "concat('void f(void) { x = y += ', s_suppkey, ' ? a, b : c ? d : e; -*p++.m[i + 1](q, _Alignof x); }')"
    found = trees.expressions(_units(_table(spark, sf_dir, "supplier"), "s_suppkey", src).full).where("kind NOT IN ('name', 'literal')")
    parents = found.select("unit_id", F.col("node_ix").alias("parent_ix"), F.col("op").alias("parent_op"))
    return found.join(parents, ["unit_id", "parent_ix"], "left").select("unit_id", "op", "parent_op", "side", "slot")


@query("""
SELECT c_custkey AS unit_id, slot, op, n_tokens::BIGINT AS n_tokens FROM customer, (VALUES ('enumerator', '<<', 3), ('enumerator', '|', 3), ('width', '+', 3), ('size', '*', 3), ('assertion', '==', 6), ('item', '-', 2), ('case', '?', 5), ('condition', '<', 3), ('return', 'sizeof', 2)) t(slot, op, n_tokens)""")
def expression_places(spark, sf_dir):
    """Expressions outside bodies and initialisers too, with the tokens that they span."""
    src = """concat('enum E { A = ', c_custkey, ' << 2, B = A | 1 }; struct S { int w : N + 1; }; int z[', c_nationkey, ' * 2] = { [1] = -', c_nationkey, ' }; _Static_assert(sizeof(int) == ', c_custkey, ', "m"); int f(void) { switch (k) { case 1 ? 2 : 3: while (a < b) ; } return sizeof k; }')"""
    rooted = lambda p: trees.expressions(p.full).where("slot IS NOT NULL AND kind NOT IN ('name', 'literal')")
    found = _units(_table(spark, sf_dir, "customer"), "c_custkey", src).by_blocks(rooted, "slot string, op string, first_ix long, last_ix long")
    return found.select("unit_id", "slot", "op", (F.col("last_ix") - F.col("first_ix") + 1).alias("n_tokens"))


@query("""
SELECT p_size AS unit_id, 'g' || p_partkey AS callee, CASE WHEN p_partkey % 3 = 0 THEN 'for' ELSE 'do' END AS loop FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT DISTINCT p_size, 'k', 'while' FROM part""")
def calls_in_loops_in_branches(spark, sf_dir):
    """All calls inside loops inside `#if` branches, in SQL over regions and what holds them; loops in other branches and calls outside loops are none."""
    call = "CASE p_partkey % 3 WHEN 0 THEN concat('for (;;) if (a) g', p_partkey, '(); else b = 1; ') WHEN 1 THEN concat('do { { g', p_partkey, '(); } } while (x); ') ELSE concat('g', p_partkey, '(); ') END"
    lines = _table(spark, sf_dir, "part").selectExpr("p_size", f"{call} AS call").groupBy("p_size").agg(F.array_join(F.collect_list("call"), "").alias("calls"))
    src = "concat('#if A\\nvoid f(void) { ', calls, 'h(); while (y) k(); m(); }\\n#else\\nvoid e(void) { for (;;) z(); }\\n#endif\\nvoid o(void) { while (1) w(); }\\n')"
    Program(lines.selectExpr("p_size AS unit_id", f"{src} AS src")).regions.createOrReplaceTempView("c_regions_of_parts")
    regions.ancestors(spark.table("c_regions_of_parts")).createOrReplaceTempView("c_ancestors_of_parts")
    return spark.sql("""
        SELECT call.unit_id, call.name AS callee, call.outer_kind AS loop
        FROM c_ancestors_of_parts call JOIN c_ancestors_of_parts loop ON loop.unit_id = call.unit_id AND loop.first_ix = call.outer_first_ix AND loop.kind = call.outer_kind
        WHERE call.kind = 'call' AND call.outer_kind IN ('for', 'while', 'do') AND loop.outer_kind = 'branch' AND loop.outer_name = 'if'""")


@query("""
WITH n AS (SELECT n_regionkey AS unit_id, 'n' || n_nationkey AS name, 'ifdef N' || n_nationkey AS own, 'N' || n_nationkey AS c FROM nation)
SELECT unit_id, name, 0 AS ordinal, 2 AS depth, 'else' AS branch_kind, '' AS condition, 'else' AS path FROM n
UNION ALL SELECT unit_id, name, 1, 2, 'ifdef', c, 'else / ' || own FROM n
UNION ALL SELECT r_regionkey, 'r', 0, 1, 'if', 'R > ' || r_regionkey, 'if R > ' || r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT r_regionkey, 'z', 0, 1, 'else', '', 'else' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")
def branch_membership(spark, sf_dir):
    """Each declaration with each branch around it, the outermost first, and the way down."""
    part = "concat('#ifdef N', n_nationkey, '\\nint n', n_nationkey, ';\\n#endif\\n')"
    parts = _table(spark, sf_dir, "nation").selectExpr("n_regionkey", f"{part} AS part").groupBy("n_regionkey").agg(F.array_join(F.collect_list("part"), "").alias("parts"))
    src = "concat('int outside;\\n#if R > ', n_regionkey, '\\nint r;\\n#else\\n', parts, 'int z;\\n#endif\\nint after;\\n#if open\\nint o;\\n')"
    kept = Program(parts.selectExpr("n_regionkey AS unit_id", f"{src} AS src")).kept
    named = declarations.symbols(kept).select("unit_id", "decl_ix", "name")
    return regions.branch_members(kept).join(named, ["unit_id", "decl_ix"]).select("unit_id", "name", F.col("ordinal").cast("int").alias("ordinal"), F.col("depth").cast("int").alias("depth"), "branch_kind", "condition", F.array_join("path", " / ").alias("path"))


@query("""
WITH c AS (SELECT 'src/n' || s_nationkey || '/s' || s_suppkey || '.c' AS unit_id, s_nationkey AS n FROM supplier),
h AS (SELECT 'src/n' || n_nationkey || '/n.h' AS unit_id, n_nationkey AS n, n_regionkey AS r FROM nation)
SELECT c.unit_id, 'src/n' || n || '/n.h' AS target, 1 AS depth FROM c
UNION ALL SELECT c.unit_id, 'include/r' || r || '.h', 2 FROM c JOIN h USING (n)
UNION ALL SELECT c.unit_id, 'include/base.h', 3 FROM c
UNION ALL SELECT c.unit_id, 'include/r' || r_regionkey || '.h', 4 FROM c JOIN h USING (n), region WHERE r_regionkey <> r
UNION ALL SELECT unit_id, 'include/r' || r || '.h', 1 FROM h
UNION ALL SELECT unit_id, 'include/base.h', 2 FROM h
UNION ALL SELECT unit_id, 'include/r' || r_regionkey || '.h', 3 FROM h, region WHERE r_regionkey <> r
UNION ALL SELECT 'include/r' || r_regionkey || '.h', 'include/base.h', 1 FROM region
UNION ALL SELECT 'include/base.h', 'include/r' || r_regionkey || '.h', 1 FROM region
UNION ALL SELECT 'include/r' || a.r_regionkey || '.h', 'include/r' || b.r_regionkey || '.h', 2 FROM region a, region b
UNION ALL SELECT 'include/base.h', 'include/base.h', 2""")
def include_closure(spark, sf_dir):
    """Sources include their nation's header by folder, that one its region's from a search folder, and those the common one, which includes them all: a cycle."""
    t = lambda name: _table(spark, sf_dir, name)
    sources = t("supplier").selectExpr("concat('src/n', s_nationkey, '/s', s_suppkey, '.c') AS unit_id", "'#include \"./n.h\"\\n#include <missing.h>\\nint x;\\n' AS src")
    headers = t("nation").selectExpr("concat('src/n', n_nationkey, '/n.h') AS unit_id", "concat('#include \"../n', n_nationkey, '/../../include/r', n_regionkey, '.h\"\\n') AS src")
    shared = t("region").selectExpr("concat('include/r', r_regionkey, '.h') AS unit_id", "'#include <base.h>\\n' AS src")
    base = t("region").groupBy().agg(F.array_join(F.collect_list(F.concat(F.lit("#include <r"), "r_regionkey", F.lit(".h>\n"))), "").alias("src")).selectExpr("'include/base.h' AS unit_id", "src")
    units = sources.unionByName(headers).unionByName(shared).unionByName(base)
    edges = include_graph.include_edges(units, preprocessor.includes(Program(units).directives), ["include"])
    return include_graph.include_closure(edges)


@query("""
WITH u AS (SELECT s_suppkey AS unit_id, s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1 AS first FROM supplier),
b AS (SELECT unit_id, n, (SELECT min(v.unit_id) FROM u v WHERE v.n = u.n AND v.first) AS home, first FROM u)
SELECT unit_id, name, scope, target_unit FROM (
    SELECT unit_id, unnest([{'n': 'x', 's': 'local', 't': unit_id}, {'n': 'x', 's': 'file', 't': unit_id}, {'n': 'p', 's': 'parameter', 't': unit_id}, {'n': 'M', 's': 'macro', 't': unit_id}, {'n': 'i', 's': 'local', 't': unit_id}, {'n': 'i', 's': 'local', 't': unit_id}, {'n': 'i', 's': 'undefined', 't': NULL},
        {'n': 'E', 's': 'file', 't': unit_id}, {'n': 'own' || unit_id, 's': 'file', 't': unit_id}, {'n': 'home' || n, 's': CASE WHEN first THEN 'file' ELSE 'extern' END, 't': home}, {'n': 'nowhere', 's': 'undefined', 't': NULL}]) AS r FROM b
), LATERAL (SELECT r.n AS name, r.s AS scope, r.t AS target_unit)""")
def name_scopes(spark, sf_dir):
    """Names of one source a supplier: a local hides a file's, a loop's name ends with the loop, and each nation has one unit that defines what the others use."""
    t = _table(spark, sf_dir, "supplier").withColumn("first", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) == 1)
    src = """concat('#define M 1\\nint x; enum { E }; static int own', s_suppkey, '(void);\\nint home', s_nationkey, if(first, '(void) { return 0; }', '(void);'),
        '\\nint f', s_suppkey, '(int p) { { int x; x; } x; p; M; for (int i; i; ) i; i; E; own', s_suppkey, '(); home', s_nationkey, '(); nowhere; }\\nstatic int own', s_suppkey, '(void) { }\\n')"""
    own = Program(t.selectExpr("s_suppkey AS unit_id", f"{src} AS src")).by_blocks(lambda p: names.in_units(p.full, p.bracketed), "decl_ix long, tok_ix long, name string, rank int, target long, here boolean")
    return names.across_units(own).select("unit_id", "name", "scope", "target_unit")


@query("""
SELECT p_partkey AS unit_id, name || p_partkey AS name FROM part, (VALUES ('U', 0), ('A', 0), ('B', 1), ('C', 0), ('D', 0), ('E', 0)) t(name, even) WHERE even = 0 OR p_size % 2 = 0""")
def typedef_order(spark, sf_dir):
    """A typedef of a word that is no type yet binds the word; of one that is, the name: each declaration depends on those before it."""
    src = "replace(concat(if(p_size % 2 = 0, 'typedef int U_;', ''), 'typedef U_ A_; typedef A_ B_; typedef U_ C_; typedef A_ *D_, E_;'), '_', p_partkey)"
    kept = _units(_table(spark, sf_dir, "part"), "p_partkey", src).kept
    return typedefs.ordered_typedefs(typedefs.typedef_parts(kept)).select("unit_id", "name")


@query("""
SELECT s_suppkey AS unit_id, 'g' AS callee, 1::BIGINT AS batch FROM supplier WHERE s_nationkey % 3 = 0
UNION ALL SELECT s_suppkey, 'f' || s_suppkey, 0 FROM supplier WHERE s_nationkey % 3 > 0 AND s_nationkey % 5 > 0""")
def incremental_calls(spark, sf_dir):
    """Three batches over one store: all units, the same again with a third changed, and some deleted; only changed ones are lexed again."""
    t = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit_id"), "s_nationkey", F.expr("concat('void h(void) { f', s_suppkey, '(); }')").alias("src"))
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", {"calls": lambda p: inner.calls(p.full)})
    store.apply(t.select("unit_id", "src"), 0)
    changed = t.withColumn("src", F.expr("if(s_nationkey % 3 = 0, 'void h(void) { g(); }', src)"))
    store.apply(changed.select("unit_id", "src"), 1)
    store.apply(changed.where("s_nationkey % 5 = 0 AND s_nationkey % 3 > 0").select("unit_id", F.lit(None).cast("string").alias("src")), 2)
    return store.relation("calls").join(store.ledger(), "unit_id").select("unit_id", "callee", "batch")


@query("""
WITH p AS (SELECT p_brand AS folder, p_partkey, 'v' || p_partkey % 20 AS v, 'g' || p_size AS g, CASE WHEN p_size % 5 = 0 THEN 23 ELSE 12 END AS n FROM part),
d AS (SELECT folder, p_partkey, 'declaration' AS kind, [v] AS names, 3 AS n FROM p UNION ALL SELECT folder, p_partkey, 'function_definition', [g, 'f', 'h'], n FROM p),
f AS (SELECT coalesce(folder, 'all') AS folder, coalesce(kind, 'all') AS kind, count(DISTINCT p_partkey) AS n_units, count(*) AS n_declarations, sum(n)::BIGINT AS n_tokens, len(list_distinct(flatten(list(names))))::BIGINT AS n_names, quantile_disc(n, 0.5)::BIGINT AS median_size FROM d GROUP BY CUBE (folder, kind))
SELECT folder, kind, n_units, n_declarations, n_tokens, n_names, CASE WHEN kind = 'all' THEN NULL ELSE median_size END AS median_size FROM f""")
def metrics_rollup(spark, sf_dir):
    """Counts, distinct names and median sizes by folder and kind and over all, merged from sketches of units."""
    src = "concat('int v', p_partkey % 20, '; void f(void) { h(g', p_size, ');', if(p_size % 5 = 0, ' if (1) h(2 + 3);', ''), ' }')"
    t = _table(spark, sf_dir, "part").selectExpr("concat(p_brand, '/', p_partkey) AS unit_id", f"{src} AS src")
    found = metrics.unit_metrics(Program(t).kept).withColumn("folder", F.substring_index("unit_id", "/", 1))
    rows = metrics.rolled_up(found, ["folder", "kind"]).select(F.coalesce("folder", F.lit("all")).alias("folder"), F.coalesce("kind", F.lit("all")).alias("kind"), "n_units", "n_declarations", "n_tokens", "n_names", "median_size")
    # Over both kinds the median lies between two groups of equal size.
    return rows.withColumn("median_size", F.when(F.col("kind") != "all", F.col("median_size")))


@query("""
SELECT s_suppkey AS unit_id, what, name || CASE WHEN name = 'get' THEN s_suppkey::VARCHAR ELSE '' END AS name FROM supplier, (VALUES ('member', 'cmp'), ('member', 'w'), ('object', 'pk'), ('function', 'get'), ('function', 'f'), ('parameter', 'a'), ('local', 'u')) t(what, name)""")
def declarator_corners(spark, sf_dir):
    """Parameters of a member and widths are no members, a tag after an attribute is no symbol, a list right after a name makes it a function, and a local after an attribute is one."""
    src = "concat('struct __attribute__((packed)) PK { int (*cmp)(const void *x, const void *y); int : N; unsigned w : N; } pk; int (*get', s_suppkey, '(int a))(double); void f(void) { __attribute__((unused)) int u = 1; }')"
    p = _units(_table(spark, sf_dir, "supplier"), "s_suppkey", src)
    named = lambda df, what, name: df.select("unit_id", what.alias("what"), F.col(name).alias("name"))
    found = named(declarations.members(p.kept), F.lit("member"), "member_name").unionByName(named(declarations.symbols(p.kept), F.col("shape"), "name"))
    return found.unionByName(named(declarations.parameters(p.kept), F.lit("parameter"), "name")).unionByName(named(inner.local_symbols(p.full), F.lit("local"), "name"))


@query("""
WITH p AS (SELECT p_partkey::VARCHAR AS u, p_partkey % 6 AS k FROM part)
SELECT 'changed' AS change, u AS old_unit, u AS new_unit, 'f' || u AS name, 2 AS old_ix, 2 AS new_ix FROM p WHERE k = 1
UNION ALL SELECT 'moved', u, u, 'a' || u, 1, 3 FROM p WHERE k = 2
UNION ALL SELECT 'removed', u, NULL, 'a' || u, 1, NULL FROM p WHERE k = 3
UNION ALL SELECT 'added', NULL, u, 'n' || u, NULL, 3 FROM p WHERE k = 3
UNION ALL SELECT 'moved_unit', u, 'h' || u, 'a' || u, 1, 0 FROM p WHERE k = 4
UNION ALL SELECT 'changed', u, u, 'M', 0, 0 FROM p WHERE k = 5
UNION ALL SELECT 'changed', u, u, 'S', 3, 3 FROM p WHERE k = 5
UNION ALL SELECT 'added', NULL, u, NULL, NULL, 4 FROM p WHERE k = 5""")
def version_diff(spark, sf_dir):
    """Two versions of each part's unit: a body changes, an object moves within the unit or to another one, declarations go and come, a macro and a tag change; what only differs in blanks and comments is the same."""
    t = _table(spark, sf_dir, "part").selectExpr("CAST(p_partkey AS STRING) AS u", "p_partkey % 6 AS k", "p_size")
    macro, body, tag = "'#define M ', if(k = 5 AND {n}, '1 + ', ''), p_size, '\\n'", "'void f', u, '(void) { g(', p_size, if(k = 1 AND {n}, ' + 1', ''), '); }'", "'struct S { int x', if(k = 5 AND {n}, ' : 3', ''), '; };'"
    obj = "'int a', u, ';'"
    first, last = f"if({{n}} AND k IN (2, 3, 4), '/* gone */', concat({obj}))", f"CASE WHEN NOT {{n}} THEN '' WHEN k = 2 THEN concat({obj}) WHEN k = 3 THEN concat('int n', u, ';') WHEN k = 5 THEN '#pragma once\\n' ELSE '' END"
    version = lambda n: f"concat({macro}, {first}, if({n}, ' // new\\n', ' '), {body}, {tag}, '\\n', {last})".replace("{n}", n)
    old, new = (t.selectExpr("u AS unit_id", f"{version(n)} AS src") for n in ("false", "true"))
    new = new.union(t.where("k = 4").selectExpr("concat('h', u)", f"concat({obj})"))
    return versions.changes(old, new).select("change", "old_unit", "new_unit", "name", F.col("old_ix").cast("int").alias("old_ix"), F.col("new_ix").cast("int").alias("new_ix"))


@query("""
SELECT c_custkey AS unit_id, k AS nth, tname, CASE k WHEN 2 THEN '<h' || c_custkey || '.h>' WHEN 9 THEN 'y' || c_custkey WHEN 11 THEN '"' || c_name || '"' ELSE lexeme END AS lexeme
FROM customer, (VALUES (0, 'PUNC_HASH', '#'), (1, 'ID', 'include'), (2, 'LIT_HEADER_NAME', ''), (3, 'KW_FLOAT', 'float'), (4, 'ID', 'x'), (5, 'PUNC_ASSIGN', '='), (6, 'LIT_FLOAT', '1.5f'),
    (7, 'PUNC_COMMA', ','), (8, 'PUNC_STAR', '*'), (9, 'ID', ''), (10, 'PUNC_ASSIGN', '='), (11, 'LIT_STRING', ''), (12, 'PUNC_SEMI', ';')) t(k, tname, lexeme)""")
def lateral_tokens(spark, sf_dir):
    """Tokens in plain SQL: a function that returns a table, joined by LATERAL."""
    register_table_functions(spark)
    src = "concat('#include <h', c_custkey, '.h>\\n/* ', c_mktsegment, ' */ float x = 1.5f, *y', c_custkey, ' = \"', c_name, '\"; // ', c_nationkey)"
    _table(spark, sf_dir, "customer").selectExpr("c_custkey AS unit_id", f"{src} AS src").createOrReplaceTempView("c_sources_of_customers")
    return spark.sql("SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY t.ix) - 1 AS nth, t.tname, t.lexeme FROM c_sources_of_customers s, LATERAL c_tokens(s.src) t")


def lex_whole_documents(spark, sf_dir):
    """Every document lexed whole, whatever its characters: how many lexemes of each kind, and the characters they cover."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("src"))
    kinds = {"words": ["word"], "numbers": ["int", "float"], "literals": ["string", "char"], "punctuators": ["punctuator"], "comments": ["block_comment", "line_comment", "open_comment"], "errors": ["error"]}
    counts = [F.count("*").alias("lexemes"), F.sum(F.length("src")).alias("chars"), *[F.count_if(F.col("cls").isin(c)).alias(n) for n, c in kinds.items()]]
    found = Program(docs).lexemes.groupBy("unit_id").agg(*counts)
    return docs.select("unit_id").join(found, "unit_id", "left").na.fill(0, ["lexemes", "chars", *kinds])


#: Queries that no SQL can give, as the lexemes need lookbehind and back references; the tests hold them against brute force.
WITHOUT_SQL = {"lex_whole_documents": lex_whole_documents}

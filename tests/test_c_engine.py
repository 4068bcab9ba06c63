"""Small C sources: lexemes, tokens, directives, declarations, and what they hold."""

import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from quern.operators import code, declarations, inner, preprocessor
from quern.plans.program import Program, engine_info
from quern.sources.files import read_units, token_json, units_from, write_relations
from quern.streaming.files import stream_units, token_counts


def program(spark, *sources, **kw):
    return Program(spark.createDataFrame(list(enumerate(sources)), "unit_id long, src string"), **kw)


def names(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def tnames(spark, source):
    return names(program(spark, source).raw_tokens.orderBy("tok_ix"), "tname", "src")


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("08", ["LIT_INT 0", "LIT_INT 8"]),
        ("1f", ["LIT_INT 1", "ID f"]),
        ("0x1.8p3f 1e-3 .5 1. 1'000ULL 0b10", ["LIT_FLOAT 0x1.8p3f", "LIT_FLOAT 1e-3", "LIT_FLOAT .5", "LIT_FLOAT 1.", "LIT_INT 1'000ULL", "LIT_INT 0b10"]),
        ("u8\"a\\\"b\" L'x' R\"d(a)\"b)d\"", ['LIT_STRING u8"a\\"b"', "LIT_CHAR L'x'", 'LIT_STRING R"d(a)"b)d"']),
        ("a+++b>>=c", ["ID a", "PUNC_PLUS_PLUS ++", "PUNC_PLUS +", "ID b", "PUNC_RSHIFT_ASSIGN >>=", "ID c"]),
        ("int inty $x _Generic __asm__", ["KW_INT int", "ID inty", "ID $x", "KW__GENERIC _Generic", "KW___ASM__ __asm__"]),
        ('#include "a b.h"\n"c"', ["PP_HASH #", "ID include", 'LIT_HEADER_NAME "a b.h"', "PP_NEWLINE \n", 'LIT_STRING "c"']),
        ("#include <a/b.h>\nx<y>z", ["PP_HASH #", "ID include", "LIT_HEADER_NAME <a/b.h>", "PP_NEWLINE \n", "ID x", "PUNC_LT <", "ID y", "PUNC_GT >", "ID z"]),
        ("/* c */ # define A\n", ["PUNC_HASH #", "ID define", "ID A"]),
        ("a\\\n#undef A\n", ["ID a", "PP_HASH #", "ID undef", "ID A", "PP_NEWLINE \n"]),
    ],
)
def test_tokens(spark, source, want):
    assert [f"{t} {s}" for t, s in tnames(spark, source)] == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab0'\"\\/*#\n\r\t <>=+(){};.é", max_size=60), min_size=1, max_size=12))
def test_lexemes_cover_every_character(spark, sources):
    rows = program(spark, *sources).lexemes.collect()
    for k, source in enumerate(sources):
        own = sorted((r for r in rows if r["unit_id"] == k), key=lambda r: r["ix"])
        assert "".join(r["src"] for r in own) == source
        for r in own:
            before = source[: r["start"]]
            assert source[r["start"] : r["end"]] == r["src"] and r["line"] == 1 + before.count("\n") and r["col"] == len(before) - before.rfind("\n")


def test_sources_that_share_an_id_are_one_unit(spark):
    p = Program(spark.createDataFrame([(1, "int b; "), (1, "int a; "), (2, "x")], "unit_id long, src string"))
    assert names(p.raw_tokens.where("unit_id = 1").orderBy("tok_ix"), "src") == ["int", "a", ";", "int", "b", ";"]


def test_trivia_goes_to_the_next_token(spark):
    got = {r["src"]: [t["src"] for t in r["leading"]] for r in program(spark, "/*a*/ // b\n int \\\n x; // end").raw_tokens.collect()}
    assert got == {"int": ["/*a*/", "// b"], "x": ["\\\n"], ";": []}


def test_status_is_data(spark):
    got = names(program(spark, "int x;", "/* open", "int `x;", "f(", "", None, "}").status.orderBy("unit_id"), "ok", "code")
    assert got == [(True, None), (False, "unterminated_comment"), (False, "unexpected_character"), (False, "unbalanced_brackets"), (True, None), (True, None), (False, "unbalanced_brackets")]


def test_macros_are_tagged_from_define_to_undef(spark):
    p = program(spark, "int a = X;\n#define X 1\nint b = X;\n#undef X\nint c = X;", "int d = X;")
    assert names(p.tokens.where("src = 'X' AND dir_id IS NULL").orderBy("unit_id", "tok_ix"), "tname") == ["ID", "MACRO_NAME", "ID", "ID"]


def test_typedefs_bind_at_the_end_and_are_predefined(spark):
    p = program(spark, "typedef int T, *U; T a; U b; void f(void) { T c; }", "uint8_t x; T y;", predefined=["uint8_t"])
    assert names(p.tokens.where("tname = 'TYPEDEF_NAME'").orderBy("unit_id", "tok_ix"), "src") == ["T", "U", "T", "uint8_t"]


def test_conditional_groups(spark):
    p = program(spark, "#endif\n#if A\nint a;\n# if B\nint b;\n# else\n# endif\nint c;\n#elif C\n#endif\n#ifdef open\nint z;")
    got = names(p.conditional_branches.orderBy("group_ix", "branch_ix"), "branch_kind", "depth", "n_decls")
    assert got == [("if", 1, 2), ("elif", 1, 0), ("if", 2, 1), ("else", 2, 0)]


def test_declarators(spark):
    p = program(spark, "struct S { int a; } s, *t; int (*fp)(int x), arr[3] = { 1, 2 }, n = f(q, r); __attribute__((unused)) int v; enum { A } e; typedef struct S T; int old(a, b) int a; { return a; }")
    want = {("s", "object"), ("t", "object"), ("fp", "function_pointer"), ("arr", "array"), ("n", "object"), ("v", "object"), ("e", "object"), ("T", "object"), ("old", "function")}
    assert want <= set(names(declarations.symbols(p.raw_marked), "name", "shape"))
    assert not set(names(declarations.symbols(p.raw_marked), "name")) & {"S", "A", "q", "r", "x", "unused"}


def test_tags_members_enumerators(spark):
    p = program(spark, "struct A { struct B { int x : 3, y[2]; } b; union { float f; }; int (*cb)(int arg); }; enum E { P, Q = 2 }; struct A one;")
    assert sorted(names(declarations.tags(p.raw_marked), "kind", "has_body")) == [("enum_specifier", True), ("struct_specifier", False), ("struct_specifier", True), ("struct_specifier", True), ("union_specifier", True)]
    got = names(declarations.members(p.raw_marked).orderBy("owner_ix", "ordinal"), "tag_name", "member_name", "bit_width")
    assert got == [("A", "b", None), ("A", "cb", None), ("B", "x", "3"), ("B", "y", None), (None, "f", None)]
    assert names(declarations.enumerators(p.raw_marked).orderBy("ordinal"), "name", "has_value") == [("P", False), ("Q", True)]


def test_parameters_and_calls(spark):
    p = program(spark, "int f(void); int g(const char *s, int (*cb)(int q), int a[4], ...); int main(int argc) { return g(h(1), (2, 3), x) + k(); }")
    got = names(declarations.parameters(p.raw_marked).orderBy("decl_ix", "ordinal"), "function", "name", "variadic")
    assert got == [("g", "s", False), ("g", "cb", False), ("g", "a", False), ("g", None, True), ("main", "argc", False)]
    assert sorted(names(inner.calls(p.full), "caller", "callee", "n_args")) == [("main", "g", 3), ("main", "h", 1), ("main", "k", 0)]


def test_literals_join_adjacent_strings(spark):
    got = names(code.literals(program(spark, 'char *s = "a" /* c */ "b"; int x = 1, y = 2.5;').raw_marked).orderBy("tok_ix"), "literal_kind", "value")
    assert got == [("LIT_STRING", '"a""b"'), ("LIT_INT", "1"), ("LIT_FLOAT", "2.5")]


def test_views_sql_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.c").write_text('#include "x.h"\nint main(void) { return puts("hi"); }\n')
    (tmp_path / "in" / "notes.txt").write_text("int no;")
    p = Program(read_units(spark, str(tmp_path / "in")))
    p.register()
    assert [r[0] for r in spark.sql("SELECT callee FROM c_calls").collect()] == ["puts"] and spark.sql("SELECT header_name FROM c_includes").first()[0] == "x.h"
    write_relations({"c_symbols": p.relations()["c_symbols"]}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "c_symbols")).first()["name"] == "main"
    leaves = json.loads(token_json(p.raw_tokens.where("tname = 'KW_INT'")).first()["json"])
    assert leaves[0] == {"kind": "token", "tname": "KW_INT", "src": "int", "span": {"start": 15, "end": 18, "line": 2, "col": 1}}
    assert engine_info(spark).first()["language"] == "C23" and units_from(spark.createDataFrame([(1, None)], "id long, text string"), "id", "text").first()["src"] == ""


def test_every_relation_of_a_program(spark):
    source = """#include <a.h>
#define M(x) x
typedef int T;
static int old(a, b) int a; T *b; { return a; }
int f(T n) { T u = (T)n, v[2]; for (int i = 0; i < n; i++, n--) v[i] = M(u); if (n) { g(u, 1)(2); } return ({ 1; }); }
"""
    found = {n: df.count() for n, df in program(spark, source).relations().items()}
    want = {"c_includes": 1, "c_defines": 1, "c_declarations": 5, "c_typedefs": 1, "c_functions": 2, "c_calls": 3, "c_local_symbols": 5, "c_subscripts": 1, "c_commas": 1, "c_statement_expressions": 1, "c_parameters": 3}
    assert {n: found[n] for n in want} == want


def test_stream_counts_tokens(spark, tmp_path):
    folder = tmp_path / "stream"
    folder.mkdir()
    (folder / "a.c").write_text("int a; int b;")
    (folder / "b.c").write_text("int c;")
    run = token_counts(stream_units(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("token_stream").start()
    run.processAllAvailable()
    run.stop()
    assert {r["tname"]: r["n"] for r in spark.sql("SELECT tname, sum(count) AS n FROM token_stream GROUP BY tname").collect()} == {"KW_INT": 3, "ID": 3, "PUNC_SEMI": 3}


def test_preprocessor_defines_keep_parameters(spark):
    p = program(spark, "#define LOG(fmt, ...) printf(fmt, __VA_ARGS__)\n#define EMPTY\n#define PAIR (1, 2)\n")
    got = names(preprocessor.defines(p.directives).orderBy("tok_ix"), "macro_name", "macro_kind", "macro_params", "macro_variadic", "macro_body")
    assert got == [("LOG", "function-like", ["fmt"], True, "printf ( fmt , __VA_ARGS__ )"), ("EMPTY", "object-like", [], False, ""), ("PAIR", "object-like", [], False, "( 1 , 2 )")]


def _lexed(text):
    """A lexer by hand: (kind, lexeme) in order."""
    import re

    tries = [
        ("line_cont", r"\\(\r\n|\n|\r)"), ("comments", r"/\*.*?\*/"), ("comments", r"/\*.*"), ("comments", r"//[^\n\r]*"), ("newline", r"\r\n|\n|\r"), ("space", r"[ \t\x0b\f]+"),
        ("literals", r'(u8|u|U|L)?R"([^(]*)\(.*?\)\2"'), ("literals", r'(u8|u|U|L)?"([^"\\\n\r]|\\.)*"'), ("literals", r"(u8|u|U|L)?'([^'\\\n\r]|\\.)*'"),
        ("numbers", r"[0-9]+\.[0-9]*|\.[0-9]+|0[0-7]*|[1-9][0-9']*"), ("words", r"[A-Za-z_$][A-Za-z0-9_$]*"), ("punctuators", r"\.\.\.|->|<<|>>|<=|&&|==|\+\+|[]()\[{};,.?:=+*/%&|^~!<>#@\\-]"),
    ]
    at, out = 0, []
    while at < len(text):
        kind, m = next(((k, m) for k, p in tries if (m := re.compile(p, re.S).match(text, at))), ("errors", None))
        out.append((kind, m[0] if m else text[at]))
        at += len(out[-1][1])
    return out


def test_whole_documents_against_a_lexer_by_hand(spark, tmp_path):
    from quern import catalogue

    texts = ["plain words_only, of it.", 'été "quoted text" costs 12 or 3.5 (see [7])', "it's one\nand isn't 'x'", "a /* open", "/* c */ b // line\r\n'c' \\\n x->y ... \U0001f600 漢字", "", None, '"unended\n', "007 0x $a #b", "x" * 50_000 + " \"" + "q 1 é " * 20_000 + '" end', "'" + "q " * 30_000, 'R"d(a "b)d" u8"z"']
    texts = [t and t.replace("0x ", "") for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["unit_id"]: r.asDict() for r in catalogue.WITHOUT_SQL["lex_whole_documents"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = _lexed(t or "")
        assert (got[k]["lexemes"], got[k]["chars"]) == (len(want), len(t or ""))
        for kind in ("words", "numbers", "literals", "punctuators", "comments", "errors"):
            assert got[k][kind] == sum(x == kind for x, _ in want), (k, kind)

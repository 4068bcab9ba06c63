"""Blocks of units in memory give the rows of Spark's windows, on sources that are whole, odd and broken; queries over many units use them."""

import random

import pytest

from quern import catalogue
from quern.blocks import tokens as T
from quern.blocks.facade import evaluated_here
from quern.operators import code, declarations, inner, names, spans, trees
from quern.plans.program import Program

WHOLE = [
    "int a = 1, *b[2][3] = { [0] = 5, .x.y = 2, 3 };", "typedef int T;", "T *f(T x, int (*cb)(int)) { if (x > 1) return g(x, 2)[3], y; else while (a[i][j], k) { T q = (T) z; } for (int i = 0; i < 9; i++, j--) ; }",
    "#define M(x) \\\n (x)\n", "#include <a.h>\n", "#undef M\n", "struct S { int a : 3, *b; union { int c[2]; } u; void (*fp)(int p); } s = { 1, { 2, 3 } };", "enum E : unsigned { A = 1 << 2, B, C = A ? 1 : 2 };",
    "__attribute__((unused, aligned(8))) static int z;", "[[nodiscard]] int h(void);", "_Static_assert(sizeof(T) == 4, \"m\");", "/* c */", "// d\n", "u8\"s\"", "R\"d(a)\"b)d\"", "\"open", "é", "￿", "\\\n", "\n", "#if X\n", "#endif\n",
    "int old(a, b) int a; char *b; { switch (a) { case 1 ... 3: default: x: goto x; case (a ? b : 2): ; } do { a++; } while (0); return sizeof(int[3]) + sizeof a; }", "v = (S){ 3, 4 }; w = t[c, d];",
    "void k(void) { ({ a; }); _Generic(x, int: 1, default: 2); asm(\"nop\" : [o] \"=r\"(q) : \"r\"(p)); M(1); T * y; a = b ? c : d, e = -f ^ g && !h | i; p->q.r++; (void) x, (T) y; }",
]
MARKS = [*"()[]{};,=*&+-?:.~!x1", "->", "++", "<<", "==", "&&", "int", "T", "struct", "enum", "if", "for", "switch", "case", "return", "goto", "sizeof", "M", "#", "define", "%:", "\n"]
RELATIONS = {
    "raw_tokens": (lambda p: p.raw_tokens, "ix long, tok_ix long, tname string, src string, cls string, start long, end long, line long, col long, dir_id long, braces long, parens long, brackets long, prev string, next string, prev_cls string"),
    "full": (lambda p: p.full, "tok_ix long, tname string, decl_ix long, decl_kind string, in_body boolean, in_attribute boolean, in_value boolean, part long"),
    "conditions": (lambda p: spans.conditions(p.raw_marked), "decl_ix long, word string, place long, text string"),
    "array_sizes": (lambda p: spans.array_sizes(p.kept), "decl_ix long, part long, name string, ordinal long, size string"),
    "expressions": (lambda p: trees.expressions(p.full), "node_ix long, kind string, op string, parent_ix long, side string, ordinal long, slot string, first_ix long, last_ix long"),
    "comma_operators": (lambda p: inner.comma_operators(p.full), "decl_ix long, tok_ix long, depth long"),
    "root_operators": (lambda p: code.root_operators(p.kept), "decl_ix long, part long, op string, kind string"),
    "members": (lambda p: declarations.members(p.raw_marked), "owner_ix long, kind string, tag_name string, member_name string, ordinal long, bit_width string"),
    "type_names": (lambda p: spans.type_names(p.marked), "open_ix long, kind string, type_name string"),
    "symbols": (lambda p: declarations.symbols(p.raw_marked), "decl_ix long, part long, name string, shape string, pointer_depth int"),
    "initializer_items": (lambda p: code.initializer_items(p.raw_marked), "list_ix long, ordinal long, designator string"),
    "subscripts": (lambda p: inner.subscripts(p.full), "tok_ix long, object string, index string"),
    "in_units": (lambda p: names.in_units(p.full, p.bracketed), "decl_ix long, tok_ix long, name string, rank int, target long, here boolean"),
    "labels": (lambda p: code.labels(p.raw_marked), "tok_ix long, label_kind string, label_name string"),
}
#: Queries whose findings were on time or disk at larger tables.
BY_BLOCKS = [
    "branch_conditions",
    "array_bounds",
    "expression_places",
    "comma_uses",
    "root_operator",
    "struct_members",
    "type_name_uses",
    "declarator_lists",
    "initializer_lists",
    "subscript_uses",
    "chained_designators",
    "case_values",
]


def sources():
    r = random.Random(11)
    odd = lambda: " ".join(r.choice(MARKS) for _ in range(r.randint(0, 40)))
    rows = [(k, "".join(r.choice([r.choice(WHOLE), odd()]) for _ in range(r.randint(1, 9)))) for k in range(60)]
    return [*rows, (100, None), (101, ""), (3, "int tail;"), (3, "an earlier source;"), (102, "  ")]


@pytest.fixture(scope="module")
def program(spark):
    return Program(spark.createDataFrame(sources(), "unit_id long, src string"))


@pytest.mark.parametrize("name", RELATIONS)
def test_blocks_give_the_rows_of_windows(program, name):
    relation, columns = RELATIONS[name]
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    by_windows = program.by_blocks(relation, columns, large=0)
    got = rows(program.by_blocks(relation, columns))
    assert got and got == rows(by_windows)
    if name == "conditions":  # some units large, some not
        assert got == rows(program.by_blocks(relation, columns, large=100))


@pytest.mark.parametrize("name", RELATIONS)
def test_blocks_of_one_unit_and_of_none(name):
    relation, columns = RELATIONS[name]
    columns = ["unit_id", *(c.split()[0] for c in columns.split(","))]

    def rows(units):
        tokens = T.tokens([[s] for s in units])
        program = Program(tokens)
        program.raw_tokens = tokens
        with evaluated_here():
            found = relation(program).select(columns)
        told = lambda c: [(found.pool.words[x] if c.kind == "word" else x) if ok else None for x, ok in zip(c.data.tolist(), c.valid(), strict=True)] if c.kind != "null" else [None] * found.n
        return sorted(map(repr, zip(*(told(found.cols[c]) for c in columns[1:]), strict=True)))

    units = [s for _, s in sources()][:25] + [None, "", " ", ";"]
    assert rows(units) == sorted(r for s in units for r in rows([s])) and rows([]) == rows([None, ""]) == []


@pytest.mark.parametrize("name", BY_BLOCKS)
def test_tokens_pass_no_window_of_spark(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_plan_of_name_scopes_is_short(spark):
    # The driver keeps the plans of what it has run.
    plan = catalogue.QUERIES["name_scopes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert len(plan) < 50_000

"""What changed between two versions, against plain versions of it; SQL functions that return tables, against the lexer."""

import random
from itertools import combinations

import pytest

from quern.functions.tables import register_table_functions
from quern.operators.versions import changes, changed_units, in_order
from quern.plans.program import Program


def _units(spark, rows):
    return spark.createDataFrame(rows, "unit_id string, src string")


def _found(spark, old, new):
    return sorted((tuple(r) for r in changes(_units(spark, old), _units(spark, new)).drop("decl_kind").collect()), key=repr)


def test_cases(spark):
    old = [("same", "int a;"), ("blank", "int a; int b;"), ("gone", "int g; int h;"), (None, "int n;"), ("copies", "int c; int c; int c;"), ("empty", ""), ("null", None), ("twice", "int t;"), ("twice", "int t;"), ("kinds", "int f(void); int f(void) { return 1; }"), ("out", "int m1; int m2;"), ("plain", "#pragma a\n#pragma b\n")]
    new = [("same", "int a;"), ("blank", "int  a;/* x */\nint b; // y"), (None, "int n, o;"), ("copies", "int c; int c;"), ("empty", "int e;"), ("null", None), ("twice", "int t;"), ("kinds", "int f(void); int f(void) { return 2; }"), ("out", ""), ("in", "int m2; int k;"), ("plain", "#pragma b\n#pragma c\n")]
    want = [
        ("changed", None, None, "n", 0, 0), ("removed", "gone", None, "g", 0, None), ("removed", "gone", None, "h", 1, None), ("removed", "copies", None, "c", 2, None), ("added", None, "empty", "e", None, 0),
        ("removed", "twice", None, "t", 1, None), ("changed", "kinds", "kinds", "f", 1, 1), ("removed", "out", None, "m1", 0, None), ("moved_unit", "out", "in", "m2", 1, 0), ("added", None, "in", "k", None, 1),
        ("removed", "plain", None, None, 0, None), ("added", None, "plain", None, None, 1),
    ]
    assert _found(spark, old, new) == sorted(want, key=repr)
    differ = {r["unit_id"] for r in changed_units(_units(spark, old), _units(spark, new)).collect()}
    assert differ == {None, "blank", "gone", "copies", "empty", "twice", "kinds", "out", "in", "plain"}
    assert _found(spark, [], []) == [] and _found(spark, [], [("a", "int x;")]) == [("added", None, "a", "x", None, 0)] and _found(spark, old, list(reversed(old))) == []


def test_a_text_that_occurs_twice_in_a_unit_is_told_from_another(spark):
    assert [r["unit_id"] for r in changed_units(_units(spark, [("u", "a"), ("u", "a"), ("u", "b")]), _units(spark, [("u", "b"), ("u", "c"), ("u", "c")])).collect()] == ["u"]


def _longest(order):
    """The length of the longest rising sequence, by all subsets of a short one."""
    return max(n for n in range(len(order) + 1) if any(list(s) == sorted(s) for s in combinations(order, n)))


def test_moves_are_as_few_as_can_be(spark):
    rng, rows, orders = random.Random(3), [], {}
    for k in range(60):
        n = rng.randrange(1, 9)
        order = list(range(n))
        rng.shuffle(order) if k % 3 else None
        orders[f"u{k}"] = order
        rows += [(f"u{k}", 5 * i, 7 * at) for i, at in enumerate(order)]
    found = in_order(spark.createDataFrame(rows, "unit_id string, old_ix long, new_ix long")).collect()
    assert len(found) == len(rows)
    for unit, order in orders.items():
        own = sorted((r["old_ix"], r["new_ix"], r["moved"]) for r in found if r["unit_id"] == unit)
        stay = [new for _, new, moved in own if not moved]
        assert stay == sorted(stay) and len(stay) == _longest(order)


def test_a_long_unit_with_a_block_that_moves(spark):
    n, lo, hi = 50_000, 20_000, 20_100
    order = [*range(lo), *range(hi, n), *range(lo, hi)]
    rows = spark.createDataFrame([("u", old, new) for new, old in enumerate(order)], "unit_id string, old_ix long, new_ix long")
    moved = sorted(r["old_ix"] for r in in_order(rows).where("moved").collect())
    assert moved == list(range(lo, hi))


def test_random_edits_come_back(spark):
    """The old declarations, less what went and with what came, are the new ones."""
    rng, old, new = random.Random(4), {}, {}
    for k in range(25):
        names = [f"v{rng.randrange(6)}" for _ in range(rng.randrange(8))]
        old[f"u{k}"] = [f"int {n} = {rng.randrange(3)};" for n in names]
        edited = [d if rng.random() > 0.2 else d.replace(";", "9;") for d in old[f"u{k}"] if rng.random() > 0.2] + [f"int w = {rng.randrange(3)};" for _ in range(rng.randrange(3))]
        if k % 2:
            rng.shuffle(edited)
        new[f"u{k}"] = edited
    found = changes(*(_units(spark, [(u, " ".join(d)) for u, d in side.items()]) for side in (old, new))).collect()
    for u in old:
        gone = {r["old_ix"] for r in found if r["old_unit"] == u and r["change"] != "moved"}
        came = {r["new_ix"] for r in found if r["new_unit"] == u and r["change"] != "moved"}
        kept, there = ([d for k, d in enumerate(side[u]) if k not in out] for side, out in ((old, gone), (new, came)))
        assert sorted(kept) == sorted(there)
        shared = sum(min(old[u].count(d), new[u].count(d)) for d in set(old[u]))
        assert len(kept) == shared
    by_change = {r["change"] for r in found}
    assert by_change >= {"moved", "changed", "added", "removed"}


SOURCES = [
    '#include <a.h>\n# include "b.h" // c\nint x = 0x1F, y = 1.5e3f; /* z */ char *s = u8"a\\"b", c = \'\\n\';\\\n',
    'R"x(a)b)x" L\'q\' 1\'000 .5 0b11 ..., -> >>= %:%: <: @ ` "open\n \'x\n /* open', "\uffff\uffff é 日本 \r\n\t$v _a", "", "a/b//c\n/**/ /***/ 'a' '' \"\"", "# embed <x>\n#include_next <y>", "$' $\\' '",
]


def test_table_functions_lex_as_the_lexer_does(spark):
    register_table_functions(spark)
    rng = random.Random(5)
    texts = SOURCES + ["".join(rng.choice("ab1.'\"\\/*#<>\n \t=+-&|%:RLu8e\uffff$") for _ in range(rng.randrange(40))) for _ in range(150)]
    units = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "unit_id long, src string")
    units.createOrReplaceTempView("sources_to_lex")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = spark.sql("SELECT s.unit_id, t.ix, t.lexeme, t.cls FROM sources_to_lex s, LATERAL c_lexemes(s.src) t")
    program = Program(units)
    assert rows(got) == rows(program.lexemes.selectExpr("unit_id", "CAST(ix AS INT) AS ix", "src", "cls"))
    got = spark.sql("SELECT s.unit_id, t.ix, t.tname, t.lexeme FROM sources_to_lex s, LATERAL c_tokens(s.src) t WHERE t.tname IS NOT NULL")
    tokens = program.raw_tokens.where("tname IS NOT NULL AND tname <> 'PP_NEWLINE'")
    hash_name = "CASE WHEN tname <> 'PP_HASH' THEN tname WHEN src = '#' THEN 'PUNC_HASH' ELSE 'PUNC_HASH_ALT' END"
    assert rows(got) == rows(tokens.selectExpr("unit_id", "CAST(ix AS INT) AS ix", hash_name, "src"))


@pytest.mark.parametrize("call", ["c_lexemes", "c_tokens"])
def test_a_table_function_is_one_step(spark, call):
    """No exchange and no Python: sources are taken apart where they lie."""
    register_table_functions(spark)
    spark.createDataFrame([(1, "int x;")], "unit_id long, src string").createOrReplaceTempView("sources_to_lex")
    df = spark.sql(f"SELECT s.unit_id, t.* FROM sources_to_lex s, LATERAL {call}(s.src) t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Generate" in plan

"""Regions and what they hold, members of conditional branches, and include graphs, against plain versions."""

import random
from collections import defaultdict

from quern.operators import include_graph as G
from quern.operators import preprocessor, regions
from quern.plans.program import Program

SOURCE = """#if A > 1
void f(int n) {
  for (int i = 0; i < n; i++) if (a) g(i, h(2)); else { k(); }
  do { while (b) m(); } while (c[n()]);
  while (d) do p(); while (q()); r();
  switch (n) { case 1: s(); default: ; }
}
#elif B
struct S { int a; struct { int b; } c; } t = { 1, { 2 } };
# ifdef C
int u;
# else
int v, w;
# endif
#endif
int z = ({ y(); });
"""


def _program(spark, *sources):
    return Program(spark.createDataFrame(list(enumerate(sources)), "unit_id long, src string"))


def test_regions_of_a_source(spark):
    p = _program(spark, SOURCE)
    words = {r["tok_ix"]: r["src"] for r in p.full.collect()}
    text = lambda r: " ".join(words[k] for k in range(r["first_ix"], r["last_ix"] + 1))
    got = defaultdict(set)
    for r in p.regions.collect():
        got[r["kind"]].add(text(r))
    assert got["for"] == {"for ( int i = 0 ; i < n ; i ++ ) if ( a ) g ( i , h ( 2 ) ) ; else { k ( ) ; }"}
    assert got["if"] == {"if ( a ) g ( i , h ( 2 ) ) ; else { k ( ) ; }"} and got["else"] == {"else { k ( ) ; }"}
    assert got["do"] == {"do { while ( b ) m ( ) ; } while ( c [ n ( ) ] ) ;", "do p ( ) ; while ( q ( ) ) ;"}
    assert got["while"] == {"while ( b ) m ( ) ;", "while ( d ) do p ( ) ; while ( q ( ) ) ;"} and got["switch"] == {"switch ( n ) { case 1 : s ( ) ; default : ; }"}
    assert got["call"] == {"( i , h ( 2 ) )", "( 2 )", "( )"} and got["members"] == {"{ int a ; struct { int b ; } c ; }", "{ int b ; }"} and got["list"] == {"{ 1 , { 2 } }", "{ 2 }"}
    assert {t.split(" \n")[0] for t in got["branch"]} == {"# if A > 1", "# elif B", "# ifdef C", "# else"} and len(got["function"]) == 1


def test_containment_against_all_pairs(spark):
    rng, rows = random.Random(4), []
    for unit in range(3):
        for _ in range(150):
            a = rng.randrange(3000)
            rows.append((unit, a, a + int(rng.random() ** 6 * 2000)))
    df = spark.createDataFrame(rows + rows[:3], "unit_id long, first_ix long, last_ix long")
    got = sorted((r["unit_id"], r["inner"]["first_ix"], r["inner"]["last_ix"], r["outer"]["first_ix"], r["outer"]["last_ix"]) for r in regions.within(df, df).collect())
    every = rows + rows[:3]
    assert got == sorted((u, a, b, c, d) for u, a, b in every for v, c, d in every if u == v and c <= a and b <= d)
    plan = regions.within(df, df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert regions.within(df.limit(0), df).collect() == [] and regions.within(df, df.limit(0)).collect() == []


def test_intervals_that_nest_meet_few_rows(spark):
    """A chain of 4000 statements in one block: each asks the cells over it, and meets what is nested, not all others."""
    rows = [(0, 0, 9000)] + [(0, 2 * k + 1, 2 * k + 2) for k in range(4000)]
    df = spark.createDataFrame(rows, "unit_id long, first_ix long, last_ix long")
    filed = df.select(regions._height(df["first_ix"], df["last_ix"]).alias("h"), "first_ix").selectExpr("h", "shiftright(first_ix, h) AS cell")
    assert filed.groupBy("h", "cell").count().agg({"count": "max"}).first()[0] <= 2
    assert regions.within(df, df).count() == 8001


def test_members_of_branches(spark):
    p = _program(spark, SOURCE, "#if open\nint a;\n", "", "int a;\n#endif\n#if X\nint b;\n#endif\n", "#ifdef P\n#ifdef Q\n#if R\nint deep; int two;\n#endif\n#endif\nint mid;\n#endif\n")
    words = {(r["unit_id"], r["tok_ix"]): r["src"] for r in p.full.collect()}
    got = defaultdict(list)
    firsts = {(r["unit_id"], r["decl_ix"]): r["first_ix"] for r in p.declarations.collect()}
    for r in sorted(regions.branch_members(p.kept).collect(), key=lambda r: (r["unit_id"], r["decl_ix"], r["ordinal"])):
        at = firsts[r["unit_id"], r["decl_ix"]]
        got[r["unit_id"], " ".join(words[r["unit_id"], at + k] for k in range(2))].append((r["branch_kind"], r["condition"], r["ordinal"], r["depth"], " / ".join(r["path"])))
    assert got[0, "void f"] == [("if", "A > 1", 0, 1, "if A > 1")] and got[0, "struct S"] == [("elif", "B", 0, 1, "elif B")]
    assert got[0, "int u"] == [("elif", "B", 0, 2, "elif B"), ("ifdef", "C", 1, 2, "elif B / ifdef C")] and got[0, "int v"][1] == ("else", "", 1, 2, "elif B / else")
    assert got[4, "int deep"] == got[4, "int two"] == [("ifdef", "P", 0, 3, "ifdef P"), ("ifdef", "Q", 1, 3, "ifdef P / ifdef Q"), ("if", "R", 2, 3, "ifdef P / ifdef Q / if R")] and got[4, "int mid"] == [("ifdef", "P", 0, 1, "ifdef P")]
    assert got[3, "int b"] == [("if", "X", 0, 1, "if X")] and not any(u in (1, 2) for u, _ in got) and (0, "int z") not in got and (3, "int a") not in got


def _closure(edges):
    out, near = [], defaultdict(set)
    for a, b in edges:
        if b is not None:
            near[a].add(b)
    for a in list(near):
        depth, todo, d = {}, [a], 0
        while todo:
            d += 1
            todo = sorted({n for t in todo for n in near[t]} - set(depth))
            depth.update(dict.fromkeys(todo, d))
        out += [(a, b, k) for b, k in depth.items()]
    return sorted(out)


def test_closure_against_a_graph_search(spark):
    rng = random.Random(6)
    for n, m, popular in ((12, 20, 10_000), (40, 60, 2), (15, 90, 0), (1, 1, 10_000)):
        edges = [(f"u{rng.randrange(n)}", None if rng.random() < 0.1 else f"u{rng.randrange(n)}") for _ in range(m)] + [(f"c{k}", f"c{k + 1}") for k in range(9)]
        df = spark.createDataFrame(edges + edges[:2], "unit_id string, target string")
        got = sorted((r["unit_id"], r["target"], r["depth"]) for r in G.include_closure(df, popular, 4).collect())
        assert got == _closure(edges)
    assert G.include_closure(spark.createDataFrame([], "unit_id string, target string")).collect() == []


def test_headers_are_found_by_folder(spark):
    rows = [
        ("a/b/x.c", '#include "y.h"\n#include "../y.h"\n#include <z.h>\n#include "z.h"\n#include "./../b//x.c"\n#include MACRO\n#include "/abs/q.h"\n#include "none.h"\n'),
        ("a/b/y.h", ""), ("a/y.h", '#include "../../../top.h"\n'), ("inc/z.h", ""), ("inc2/z.h", ""), ("/abs/q.h", ""), ("../../top.h", ""), ("z.h", '#include "y.h"'),
    ]
    units = spark.createDataFrame(rows, "unit_id string, src string")
    found = G.include_edges(units, preprocessor.includes(Program(units).directives), ["inc", "inc2"]).collect()
    got = {(r["unit_id"], r["line"]): r["target"] for r in found}
    want = ["a/b/y.h", "a/y.h", "inc/z.h", "inc/z.h", "a/b/x.c", None, "/abs/q.h", None]
    assert [got["a/b/x.c", k + 1] for k in range(8)] == want and got["a/y.h", 1] == "../../top.h" and got["z.h", 1] is None

"""What names refer to, within a unit and across units."""

from quern.operators import names
from quern.plans.program import Program

UNITS = {
    1: """#define M 1
int g = 2;
static int hidden(int a);
extern int shared;
int proto(int q);
int f(int p, int n) {
  int g = p;
  { int g = n; g + M; }
  for (int i = 0; i < n; i++) s.g = i;
  i = g;
  hidden(unknown);
  return proto(shared) + late;
}
static int hidden(int a) { static int dead; return a; }
int late;
""",
    2: "int shared = 1; int proto(int q) { return q; } static int hidden(int b) { return g; } int lonely(void) { return A; } enum E { A, B = A + 1 };",
    3: "int main(void) { return shared + hidden(1) + f(1, 2); }",
    4: "",
}


def _by_name(rows):
    out = {}
    for r in rows:
        out.setdefault((r["unit_id"], r["name"]), []).append((r["tok_ix"], r["scope"], r["target_unit"]))
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


def test_names_of_units(spark):
    p = Program(spark.createDataFrame(list(UNITS.items()), "unit_id long, src string"))
    for popular in (10_000, 0):
        got = _by_name(names.resolved(p.full, p.bracketed, popular, 4).collect())
        assert got[1, "M"] == [("macro", 1)] and got[1, "p"] == [("parameter", 1)] and got[1, "g"] == [("local", 1), ("local", 1)]
        assert got[1, "n"] == [("parameter", 1), ("parameter", 1)] and got[1, "i"] == [("local", 1)] * 3 + [("undefined", None)] and got[1, "a"] == [("parameter", 1)]
        assert got[1, "hidden"] == [("file", 1)] and got[1, "unknown"] == [("undefined", None)] and got[1, "s"] == [("undefined", None)]
        assert got[1, "proto"] == [("extern", 2)] and got[1, "shared"] == [("extern", 2)] and got[1, "late"] == [("extern", 1)]
        assert got[2, "g"] == [("extern", 1)] and got[2, "q"] == [("parameter", 2)] and got[2, "A"] == [("undefined", None), ("file", 2)]
        assert got[3, "shared"] == [("extern", 2)] and got[3, "hidden"] == [("undefined", None)] and got[3, "f"] == [("extern", 1)]
    left = {(r["unit_id"], r["name"], r["scope"]) for r in names.unused(p.full, p.name_uses, p.bracketed).collect()}
    assert left == {(1, "dead", "local"), (2, "hidden", "static"), (2, "lonely", "outer")} | ({(1, "hidden", "static")} & left)


def test_the_inner_of_two_locals_counts(spark):
    p = Program(spark.createDataFrame([(0, "int x; void f(void) { int x; { x; int x = x; { x; } } x; }")], "unit_id long, src string"))
    rows = sorted((r["tok_ix"], r["target_ix"]) for r in p.name_uses.collect())
    declared = sorted(r["tok_ix"] for r in p.tokens.where("src = 'x' AND prev = 'int'").collect())
    _, outer, inner = declared
    assert [t for _, t in rows] == [outer, inner, inner, outer]

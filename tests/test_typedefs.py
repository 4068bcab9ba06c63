"""Typedefs in order, against a fold over the declarations."""

import random

from quern.operators import typedefs as T
from quern.plans.program import Program


def _fold(rows, predefined):
    bound, out = set(predefined), {}
    for ix, decl in enumerate(rows):
        for word, name in decl:
            got = name if word is None or word in bound else word
            out.setdefault(got, ix)
        bound |= set(out)
    return out


def test_order_against_a_fold(spark):
    rng, units, want = random.Random(3), [], {}
    for unit in range(60):
        n, decls, text = rng.randrange(1, 14), [], []
        for _ in range(n):
            word = rng.choice([None, *"ABCDEF"])
            names = rng.sample("ABCDEFG", rng.choice([1, 1, 2]))
            if word == names[0]:
                word = None
            decls.append([(word if k == 0 else None, x) for k, x in enumerate(names)])
            text.append(f"typedef {rng.choice(['const ', '__attribute__((x)) ', ''])}{word or rng.choice(['int', 'struct S', 'unsigned long'])} {', '.join(rng.choice(['', '*']) + x for x in names)};")
        units.append((unit, " ".join(text)))
        want[unit] = _fold(decls, ["F"])
    p = Program(spark.createDataFrame(units, "unit_id long, src string"))
    parts = T.typedef_parts(p.kept)
    got = {}
    for r in T.ordered_typedefs(parts, ["F"]).collect():
        got.setdefault(r["unit_id"], set()).add(r["name"])
    assert got == {u: set(w) for u, w in want.items()}


def test_tokens_of_an_ordered_program(spark):
    source = "typedef T U; T a; U b; typedef T V; V c; int T2; void f(void) { T * p; U * q; }"
    rows = spark.createDataFrame([(0, source)], "unit_id long, src string")
    kinds = lambda p: {(r["src"], r["tname"]) for r in p.tokens.where("src IN ('T', 'U', 'V') AND prev <> 'typedef'").collect()}
    ordered = Program(rows, ordered=True)
    assert {("T", "TYPEDEF_NAME"), ("U", "ID"), ("V", "TYPEDEF_NAME")} <= kinds(ordered) and ("U", "TYPEDEF_NAME") not in kinds(ordered)
    assert ("U", "TYPEDEF_NAME") in kinds(Program(rows)) and ("T", "TYPEDEF_NAME") not in kinds(Program(rows))
    assert T.ordered_typedefs(T.typedef_parts(Program(spark.createDataFrame([], "unit_id long, src string")).kept)).collect() == []

"""Expression trees against a parser written by hand, on random expressions in every place where one may stand."""

import random

from quern.operators import trees
from quern.plans.program import Program

BINARY = {"||": 4, "&&": 5, "|": 6, "^": 7, "&": 8, "==": 9, "!=": 9, "<": 10, ">=": 10, "<<": 11, ">>": 11, "+": 12, "-": 12, "*": 13, "/": 13, "%": 13}
ASSIGN = ["=", "+=", "<<=", "|="]
PREFIX = ["-", "!", "~", "*", "&", "++", "--", "sizeof"]


class Parser:
    """Recursive descent over a list of tokens; nodes[ix] = [parent, side, ordinal, first, last]."""

    def __init__(self, tokens, at):
        self.t, self.at, self.nodes = tokens, at, {}

    def peek(self):
        return self.t[self.at] if self.at < len(self.t) else ""

    def hang(self, ix, parent, side, ordinal=None):
        if ix is not None:
            self.nodes[ix][:3] = [parent, side, ordinal]

    def add(self, ix, first, last):
        self.nodes[ix] = [None, None, None, first, last]
        return ix

    def span(self, x):
        return x[1], x[2]

    def expr(self):
        left = self.assign()
        while self.peek() == ",":
            left = self.pair(left, self.assign, "left", "right")
        return left

    def pair(self, left, right, a, b):
        op, self.at = self.at, self.at + 1
        r = right()
        self.add(op, left[1], r[2])
        self.hang(left[0], op, a)
        self.hang(r[0], op, b)
        return op, left[1], r[2]

    def assign(self):
        left = self.ternary()
        return self.pair(left, self.assign, "left", "right") if self.peek() in ASSIGN else left

    def ternary(self):
        cond = self.binary(4)
        if self.peek() != "?":
            return cond
        op, self.at = self.at, self.at + 1
        then = self.expr()
        assert self.peek() == ":"
        self.at += 1
        other = self.ternary()
        self.add(op, cond[1], other[2])
        for x, side in ((cond, "condition"), (then, "then"), (other, "else")):
            self.hang(x[0], op, side)
        return op, cond[1], other[2]

    def binary(self, least):
        left = self.prefix()
        while BINARY.get(self.peek(), 0) >= least:
            s = BINARY[self.peek()]
            left = self.pair(left, lambda: self.binary(s + 1), "left", "right")
        return left

    def prefix(self):
        cast = self.peek() == "(" and self.t[self.at + 1] == "int"
        if not cast and self.peek() not in PREFIX:
            return self.postfix()
        op = self.at
        self.at += 3 if cast else 1
        inner = self.prefix()
        self.add(op, op, inner[2])
        self.hang(inner[0], op, "operand")
        return op, op, inner[2]

    def postfix(self):
        if self.peek() == "(":
            begin, self.at = self.at, self.at + 1
            inner = self.expr()
            assert self.peek() == ")"
            left, self.at = (inner[0], begin, self.at), self.at + 1
        else:
            left = (self.add(self.at, self.at, self.at), self.at, self.at)
            self.at += 1
        while self.peek() in ("(", "[", ".", "->", "++", "--"):
            op, what = self.at, self.peek()
            self.at += 1
            if what == "(":
                n = 0
                while self.peek() != ")":
                    arg = self.assign()
                    self.nodes.setdefault(op, [None] * 5)
                    self.hang(arg[0], op, "argument", n)
                    n += 1
                    if self.peek() == ",":
                        self.at += 1
            elif what == "[":
                self.nodes.setdefault(op, [None] * 5)
                self.hang(self.expr()[0], op, "index")
            elif what in (".", "->"):
                self.add(self.at, self.at, self.at)
                self.hang(self.at, op, "member")
            last = self.at if what not in ("++", "--") else op
            if what not in ("++", "--"):
                self.at += 1
            self.add(op, left[1], last)
            self.hang(left[0], op, {"(": "callee", "++": "operand", "--": "operand"}.get(what, "object"))
            left = (op, left[1], last)
        return left


def _random(rng, depth, level=0):
    """Tokens of an expression that binds at `level` at least."""
    again = lambda least: _random(rng, depth - 1, least)
    if depth <= 0:
        return [rng.choice(["a", "b", "7", "0x1", "'c'", "1.5"])]
    kind = rng.randrange(12)
    if kind == 0 and level <= 1:
        return [*again(1), ",", *again(2)]
    if kind == 1 and level <= 2:
        return ["a", rng.choice(ASSIGN), *again(2)]
    if kind == 2 and level <= 3:
        return [*again(4), "?", *again(1), ":", *again(3)]
    if kind < 7:
        op = rng.choice(list(BINARY))
        if BINARY[op] >= level:
            return [*again(BINARY[op]), op, *again(BINARY[op] + 1)]
        return ["(", *again(1), ")"]
    if kind == 7 and level <= 14:
        return [*rng.choice([[p] for p in PREFIX] + [["(", "int", ")"]]), *again(14)]
    if kind == 8:
        args = [again(2) for _ in range(rng.randrange(3))]
        return [*rng.choice([["f"], ["(", "*", "f", ")"], ["g", "(", ")"]]), "(", *[t for k, a in enumerate(args) for t in ([","] if k else []) + a], ")"]
    if kind == 9:
        return [*rng.choice([["a"], ["(", *again(1), ")"]]), "[", *again(1), "]"]
    if kind == 10:
        return ["s", rng.choice([".", "->"]), "m", *rng.choice([[], ["++"], [".", "n"]])]
    return ["(", "(", *again(1), ")", ")"] if rng.random() < 0.3 else ["(", *again(1), ")"]


#: Before and after an expression, its slot, the least level at which it may stand there, and whether it may hold commas.
PLACES = [
    ("int v =", ";", "value", 2), ("int a [", "] ;", "size", 2), ("struct S { int w :", "; } ;", "width", 3), ("enum E { A =", "} ;", "enumerator", 3), ("static_assert (", ", \"m\" ) ;", "assertion", 3),
    ("int l [ ] = { 1 ,", "} ;", "item", 2), ("struct T t = { . m =", "} ;", "item", 2), ("void h ( ) {", "; }", "statement", 1), ("int h ( ) { return", "; }", "return", 1), ("void h ( ) { if (", ") ; }", "condition", 1),
    ("void h ( int n ) { switch ( n ) { case", ": ; } }", "case", 3), ("void h ( ) { int k =", ", j ; }", "value", 2), ("void h ( ) { for ( ; ;", ") ; }", "condition", 1), ("void h ( ) { do ; while (", ") ; }", "condition", 1),
    ("void h ( ) { int u [", "] ; }", "size", 2), ("enum E { B , C =", ", D } ;", "enumerator", 3),
]


def test_trees_against_a_parser(spark):
    rng, sources, want = random.Random(11), [], {}
    for k in range(400):
        before, after, slot, level = PLACES[k % len(PLACES)]
        tokens = _random(rng, 1 + k % 5, level)
        while before.endswith("{") and tokens[0] in ("a", "b", "s") and len(tokens) > 1 and tokens[1] == "*":
            tokens = _random(rng, 1 + k % 5, level)  # `a * b` alone at the start of a statement declares b
        head = before.split(" ")
        parser = Parser([*head, *tokens, "", *after.split(" ")], len(head))
        root = parser.expr() if level == 1 else parser.assign()
        assert parser.peek() == ""
        sources.append((k, " ".join([before, *tokens, after])))
        for ix, (parent, side, ordinal, first, last) in parser.nodes.items():
            want[k, ix] = (parent, side, ordinal, slot if ix == root[0] else None, first, last)
    p = Program(spark.createDataFrame(sources, "unit_id long, src string"))
    got = {}
    for r in trees.expressions(p.full).collect():
        before = PLACES[r["unit_id"] % len(PLACES)][0].split(" ")
        n = len(sources[r["unit_id"]][1].split(" ")) - len(PLACES[r["unit_id"] % len(PLACES)][1].split(" "))
        if len(before) <= r["node_ix"] < n:
            got[r["unit_id"], r["node_ix"]] = tuple(r[c] for c in ("parent_ix", "side", "ordinal", "slot", "first_ix", "last_ix"))
    wrong = [(sources[k[0]][1], k, got.get(k), want.get(k)) for k in sorted(set(got) | set(want)) if got.get(k) != want.get(k)]
    assert not wrong, wrong[:5]


CASES = [
    ("static_assert(sizeof(int) == 4);", [("sizeof", "==", "left", None), ("==", None, None, "assertion")]),
    ("int *p, *q[2 * 3], (*f)(int), g(int a[1 + 2]);", [("*", None, None, "size"), ("+", None, None, "size")]),
    ("void h() { T * x; int *y; lab: goto lab; }", [("*", None, None, "statement")]),
    ("int t[] = { [1 + 1] = -2, .a.b = 3 };", [("+", None, None, "size"), ("-", None, None, "item")]),
    ("void h() { m = (struct P){ 1 + 2 }; }", [("=", None, None, "statement"), ("(", "=", "right", None), ("+", None, None, "item")]),
    ("int v = _Generic(x, int: -1, char *: f(2), default: 3);", [("(", None, None, "value"), ("-", "(", "argument", None), ("(", "(", "argument", None)]),
    ("int v = (T)x + (int (*)(char *))y;", [("(", "+", "left", None), ("+", None, None, "value"), ("(", "+", "right", None)]),
    ("void h() { int v = ({ int k = 1 + 2; k * 2; }); }", [("+", None, None, "value"), ("*", None, None, "statement")]),
    ("_Alignas(2 * 8) int w;", [("*", None, None, "operand")]),
    ("void h() { __attribute__((unused)) int u = 1 - 2; }", [("-", None, None, "value")]),
    ("", []), ("int a;", []), ("a ? ; : ) ( b", []),
]


def test_places_and_what_is_no_operator(spark):
    p = Program(spark.createDataFrame([(k, source) for k, (source, _) in enumerate(CASES)], "unit_id long, src string"))
    spelled = {(r["unit_id"], r["tok_ix"]): r["src"] for r in p.full.collect()}
    rows = sorted(trees.expressions(p.full).where("kind NOT IN ('name', 'literal')").collect(), key=lambda r: r["node_ix"])
    for k, (source, want) in enumerate(CASES):
        assert (source, [(r["op"], spelled.get((k, r["parent_ix"])), r["side"], r["slot"]) for r in rows if r["unit_id"] == k]) == (source, want)

"""The part of Spark's column functions that the operators use, evaluated over a Frame.

A Column is evaluated in a scope: the rows of a Frame, or its groups, where aggregates have a value a group.
"""

from __future__ import annotations

import builtins
import re
from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np

from . import running, values as v
from .values import Values

if TYPE_CHECKING:
    from .frame import Scope


class Column:
    def __init__(self, evaluate: Callable[[Scope], Values], name: str = "_"):
        self.evaluate, self.name = evaluate, name

    def of(self, scope: Scope) -> Values:
        """The value in a scope, once for each scope."""
        found = scope.known.get(id(self))
        if found is None:
            found = scope.known[id(self)] = (self, self.evaluate(scope))
        return found[1]

    def alias(self, name: str) -> Column:
        return _Exploded(self.many, name) if isinstance(self, _Exploded) else Column(self.of, name)

    def __invert__(self) -> Column:
        def evaluate(scope: Scope) -> Values:
            a = self.of(scope)
            return a if a.kind == "null" else Values("bool", ~a.data, a.ok, a.n)

        return Column(evaluate)

    def __and__(self, other: object) -> Column:
        return _logical(self, other, False)

    def __or__(self, other: object) -> Column:
        return _logical(self, other, True)

    __rand__, __ror__ = __and__, __or__

    def __eq__(self, other: object) -> Column:
        return _binary(self, other, np.equal, "bool")

    def __ne__(self, other: object) -> Column:
        return _binary(self, other, np.not_equal, "bool")

    def __lt__(self, other: object) -> Column:
        return _binary(self, other, np.less, "bool")

    def __le__(self, other: object) -> Column:
        return _binary(self, other, np.less_equal, "bool")

    def __gt__(self, other: object) -> Column:
        return _binary(self, other, np.greater, "bool")

    def __ge__(self, other: object) -> Column:
        return _binary(self, other, np.greater_equal, "bool")

    def __add__(self, other: object) -> Column:
        return _binary(self, other, np.add, "int")

    def __radd__(self, other: object) -> Column:
        return _binary(other, self, np.add, "int")

    def __sub__(self, other: object) -> Column:
        return _binary(self, other, np.subtract, "int")

    def __rsub__(self, other: object) -> Column:
        return _binary(other, self, np.subtract, "int")

    def __mul__(self, other: object) -> Column:
        return _binary(self, other, np.multiply, "int")

    def __neg__(self) -> Column:
        return _binary(0, self, np.subtract, "int")

    def __getitem__(self, key: object) -> Column:
        return Column(lambda scope: v.field(self.of(scope), key), key)

    def __hash__(self) -> int:
        return id(self)

    def isNull(self) -> Column:  # noqa: N802
        return ~self.isNotNull()

    def isNotNull(self) -> Column:  # noqa: N802
        def evaluate(scope: Scope) -> Values:
            a = self.of(scope)
            return Values("bool", a.valid(), None, a.n)

        return Column(evaluate)

    def isin(self, *options: object) -> Column:
        options = options[0] if len(options) == 1 and isinstance(options[0], (list, tuple)) else options

        def evaluate(scope: Scope) -> Values:
            a = self.of(scope)
            if a.kind == "null":
                return a
            if a.kind == "word":
                codes = [scope.pool.at[o] for o in options if o in scope.pool.at]
                table = np.zeros(len(scope.pool.words), bool)
                table[codes] = True
                return Values("bool", table[a.data], a.ok, a.n)
            return Values("bool", np.isin(a.data, list(options)), a.ok, a.n)

        return Column(evaluate)

    def between(self, low: object, high: object) -> Column:
        return (self >= low) & (self <= high)

    def startswith(self, start: str) -> Column:
        def evaluate(scope: Scope) -> Values:
            a = self.of(scope)
            return a if a.kind == "null" else Values("bool", scope.pool.table(lambda w: w.startswith(start), bool)[a.data], a.ok, a.n)

        return Column(evaluate)

    def cast(self, kind: str) -> Column:
        """Numbers are of 64 bits here, and get the width of their result at the end."""

        def evaluate(scope: Scope) -> Values:
            a = self.of(scope)
            return Values("int", a.data.astype(np.int64), a.ok, a.n) if a.kind == "bool" else a

        if kind not in ("int", "long", "bigint"):
            raise NotImplementedError(kind)
        return Column(evaluate, self.name)


def _of(x: object) -> Column:
    return x if isinstance(x, Column) else lit(x)


def _named(x: object) -> Column:
    return col(x) if isinstance(x, str) else x


def _logical(one: object, other: object, decides: bool) -> Column:
    """And, or or: a value that decides does so beside a null too."""
    one, other = _of(one), _of(other)

    def evaluate(scope: Scope) -> Values:
        a, b = one.of(scope), other.of(scope)
        if a.kind == b.kind == "null":
            return a
        if "null" in (a.kind, b.kind):
            some = b if a.kind == "null" else a
            sure = (some.data if decides else ~some.data) & some.valid()
            return Values("bool", np.full(some.n, decides), sure, some.n)
        data = a.data | b.data if decides else a.data & b.data
        if a.ok is None and b.ok is None:
            return Values("bool", data, None, a.n)
        x, y = a.valid(), b.valid()
        sure_a, sure_b = ((a.data if decides else ~a.data) & x, (b.data if decides else ~b.data) & y)
        sure = sure_a | sure_b
        return Values("bool", sure if decides else ~sure, x & y | sure, a.n)

    return Column(evaluate)


def _binary(one: object, other: object, how: Callable, kind: str) -> Column:
    one, other = _of(one), _of(other)

    def evaluate(scope: Scope) -> Values:
        a, b = one.of(scope), other.of(scope)
        if "null" in (a.kind, b.kind):
            return v.null(a.n)
        if a.kind == "word" and how not in (np.equal, np.not_equal):
            raise NotImplementedError("words are compared for equality alone")
        return Values(kind, how(a.data, b.data), v.both(a.ok, b.ok), a.n)

    return Column(evaluate)


def col(name: str) -> Column:
    return Column(lambda scope: scope.column(name), name.rsplit(".", 1)[-1])


def lit(value: object) -> Column:
    made = Column(lambda scope: v.constant(value, scope.n, scope.pool))
    made.value = value
    return made


def expr(text: str) -> Column:
    return _Parser(text).whole()


class _When(Column):
    def __init__(self, cases: list[tuple[Column, Column]], other: object = None):
        super().__init__(self._chosen)
        self.cases, self.other = cases, _of(other)

    def when(self, which: Column, value: object) -> _When:
        return _When([*self.cases, (which, _of(value))])

    def otherwise(self, value: object) -> _When:
        return _When(self.cases, value)

    def _chosen(self, scope: Scope) -> Values:
        out = self.other.of(scope)
        for which, value in reversed(self.cases):
            out = v.chosen(which.of(scope).true(), value.of(scope), out)
        return out


def when(which: Column, value: object) -> _When:
    return _When([(which, _of(value))])


def coalesce(*columns: str | Column) -> Column:
    columns = [_named(c) for c in columns]

    def evaluate(scope: Scope) -> Values:
        out = columns[-1].of(scope)
        for c in reversed(columns[:-1]):
            a = c.of(scope)
            out = a if a.kind != "null" and a.ok is None else v.chosen(a.valid(), a, out)
        return out

    return Column(evaluate)


def struct(*columns: str | Column) -> Column:
    columns = [_named(c) for c in columns]
    return Column(lambda scope: Values("struct", {c.name: c.of(scope) for c in columns}, None, scope.n))


def _extreme(columns: tuple, better: Callable) -> Column:
    columns = [_named(c) for c in columns]

    def evaluate(scope: Scope) -> Values:
        out = columns[0].of(scope)
        for c in columns[1:]:
            a = c.of(scope)
            if "null" in (a.kind, out.kind):
                out = out if a.kind == "null" else a
                continue
            out = v.chosen(a.valid() & (~out.valid() | better(a.data, out.data)), a, out)
        return out

    return Column(evaluate)


def greatest(*columns: str | Column) -> Column:
    return _extreme(columns, np.greater)


def least(*columns: str | Column) -> Column:
    return _extreme(columns, np.less)


def concat(*columns: str | Column) -> Column:
    columns = [_named(c) for c in columns]

    def evaluate(scope: Scope) -> Values:
        parts = [c.of(scope) for c in columns]
        if any(p.kind == "null" for p in parts):
            return v.null(scope.n)
        ok = None
        for p in parts:
            ok = v.both(ok, p.ok)
        words = scope.pool.words
        made = ["".join(x) for x in zip(*([words[k] for k in p.data.tolist()] for p in parts), strict=True)]
        return Values("word", np.fromiter(map(scope.pool.code, made), np.int64, scope.n), ok, scope.n)

    return Column(evaluate)


class _Map:
    def __init__(self, pairs: dict):
        self.pairs = pairs

    def __getitem__(self, key: Column) -> Column:
        def evaluate(scope: Scope) -> Values:
            a = key.of(scope)
            if a.kind == "null":
                return a
            told = {(scope.pool.code(k) if isinstance(k, str) else k): (scope.pool.code(x) if isinstance(x, str) else x) for k, x in self.pairs.items()}
            kind = "word" if isinstance(next(iter(self.pairs.values())), str) else "int"
            most = builtins.max(int(a.data.max(initial=0)), *told) + 1
            table, has = np.zeros(most, np.int64), np.zeros(most, bool)
            table[list(told)], has[list(told)] = list(told.values()), True
            at = np.maximum(a.data, 0)
            return Values(kind, table[at], has[at] & (a.data >= 0) & a.valid(), a.n)

        return Column(evaluate)


def create_map(*parts: Column) -> _Map:
    """Of literals alone."""
    got = [p.value for p in parts]
    return _Map(dict(zip(got[::2], got[1::2], strict=True)))


# Lists.


def _of_lists(column: Column, how: Callable[[Scope, Values], Values]) -> Column:
    def evaluate(scope: Scope) -> Values:
        a = column.of(scope)
        return a if a.kind == "null" else how(scope, a)

    return Column(evaluate)


def _rows(a: Values) -> tuple[np.ndarray, np.ndarray]:
    """Of each item of all lists: the row that holds it, and its place among the values."""
    starts, sizes, _ = a.data
    sizes = sizes if a.ok is None else np.where(a.ok, sizes, 0)
    row = np.repeat(np.arange(a.n), sizes)
    return row, np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(row))


def _dense(a: Values) -> tuple[Values, np.ndarray]:
    """The lists one after the other, and the row of each item."""
    row, at = _rows(a)
    sizes = np.bincount(row, minlength=a.n)
    return Values("list", (np.cumsum(sizes) - sizes, sizes, v.take(a.data[2], at)), a.ok, a.n), row


def array(*columns: str | Column) -> Column:
    columns = [_named(c) for c in columns]

    def evaluate(scope: Scope) -> Values:
        n, k = scope.n, len(columns)
        child = columns[0].of(scope)
        for c in columns[1:]:
            child = v.joined(child, c.of(scope))
        by_row = v.take(child, (np.arange(k)[None, :] * n + np.arange(n)[:, None]).ravel())
        return Values("list", (np.arange(n) * k, np.full(n, k), by_row), None, n)

    made = Column(evaluate)
    made.items = columns
    return made


def slice(items: Column, start: int, size: Column) -> Column:  # noqa: A001
    """The first items of array()."""
    if start != 1:
        raise NotImplementedError("a slice that does not begin at 1")
    made = Column(lambda scope: None)
    made.items, made.size = items.items, _of(size)
    return made


def _best(items: Column, better: Callable) -> Column:
    """The greatest or least struct of a slice(): by the first field, which differs."""

    def evaluate(scope: Scope) -> Values:
        size = items.size.of(scope)
        if size.kind == "null":
            return size
        out, first = v.null(scope.n), None
        for k, c in enumerate(items.items):
            a = c.of(scope)
            if a.kind == "null":
                continue
            here = a.valid() & (k < size.data) & size.valid()
            if not here.any():
                continue
            key = next(iter(a.data.values())).data
            if first is not None:
                here &= ~out.valid() | better(key, first)
            first = key if first is None else np.where(here, key, first)
            out = v.chosen(here, a, out)
        return out

    return Column(evaluate)


def array_max(items: Column) -> Column:
    return _best(items, np.greater)


def array_min(items: Column) -> Column:
    return _best(items, np.less)


def sequence(low: Column, high: Column) -> Column:
    """Empty where high is below low: callers leave such rows out."""

    def evaluate(scope: Scope) -> Values:
        a, b = low.of(scope), high.of(scope)
        if "null" in (a.kind, b.kind):
            return v.null(scope.n)
        sizes = np.where(a.valid() & b.valid(), np.maximum(b.data - a.data + 1, 0), 0)
        starts = np.cumsum(sizes) - sizes
        data = np.arange(int(sizes.sum())) - np.repeat(starts, sizes) + np.repeat(a.data, sizes)
        return Values("list", (starts, sizes, Values("int", data, None, len(data))), v.both(a.ok, b.ok), scope.n)

    return Column(evaluate)


class _Exploded(Column):
    def __init__(self, many: Column, name: str = "col"):
        super().__init__(lambda scope: None, name)
        self.many = many


def explode(many: str | Column) -> _Exploded:
    return _Exploded(_named(many))


def array_sort(items: str | Column) -> Column:
    def how(scope: Scope, a: Values) -> Values:
        a, row = _dense(a)
        starts, sizes, child = a.data
        first = next(iter(child.data.values())) if child.kind == "struct" else None
        if child.kind == "null" or first is not None and first.kind == "int" and first.ok is None and bool(np.all((row[1:] != row[:-1]) | (first.data[1:] > first.data[:-1]))):
            return a
        by = np.lexsort((v.ranks(child, scope.pool), row))
        return Values("list", (starts, sizes, v.take(child, by)), a.ok, a.n)

    return _of_lists(_named(items), how)


def array_join(items: str | Column, sep: str) -> Column:
    def how(scope: Scope, a: Values) -> Values:
        a, row = _dense(a)
        starts, sizes, child = a.data
        pool = scope.pool
        if child.kind == "null":
            return Values("word", np.full(a.n, pool.code("")), a.ok, a.n)
        if child.ok is not None:
            sizes = np.bincount(row[child.ok], minlength=a.n)
            starts, child = np.cumsum(sizes) - sizes, v.take(child, np.flatnonzero(child.ok))
        words = [pool.words[k] for k in child.data.tolist()]
        made = [sep.join(words[s : s + k]) for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]
        return Values("word", np.fromiter(map(pool.code, made), np.int64, a.n), a.ok, a.n)

    return _of_lists(_named(items), how)


def size(items: str | Column) -> Column:
    return _of_lists(_named(items), lambda scope, a: Values("int", a.data[1], a.ok, a.n))


def _in_items(scope: Scope, a: Values, told: Callable[[Column], Column]) -> tuple[Values, np.ndarray, Values]:
    dense, row = _dense(a)
    item = dense.data[2]
    return dense, row, told(Column(lambda _: item)).of(scope.repeated(row))


def transform(items: str | Column, told: Callable[[Column], Column]) -> Column:
    def how(scope: Scope, a: Values) -> Values:
        dense, _, got = _in_items(scope, a, told)
        return Values("list", (dense.data[0], dense.data[1], got), a.ok, a.n)

    return _of_lists(_named(items), how)


def filter(items: str | Column, told: Callable[[Column], Column]) -> Column:  # noqa: A001
    def how(scope: Scope, a: Values) -> Values:
        dense, row, got = _in_items(scope, a, told)
        kept = got.true()
        sizes = np.bincount(row[kept], minlength=a.n)
        return Values("list", (np.cumsum(sizes) - sizes, sizes, v.take(dense.data[2], np.flatnonzero(kept))), a.ok, a.n)

    return _of_lists(_named(items), how)


def exists(items: str | Column, told: Callable[[Column], Column]) -> Column:
    def how(scope: Scope, a: Values) -> Values:
        _, row, got = _in_items(scope, a, told)
        some = np.bincount(row[got.true()], minlength=a.n) > 0
        unknown = np.bincount(row[~got.valid()], minlength=a.n) > 0
        return Values("bool", some, v.both(a.ok, some | ~unknown), a.n)

    return _of_lists(_named(items), how)


# Windows and aggregates.


class _Order:
    def __init__(self, column: Column, down: bool):
        self.column, self.down = column, down


def desc(column: str | Column) -> _Order:
    return _Order(_named(column), True)


class Window:
    unboundedPreceding, unboundedFollowing = -(1 << 62), 1 << 62  # noqa: N815

    def __init__(self, parts: list[Column], order: _Order | None = None, frame: tuple[int, int] | None = None):
        self.parts, self.order, self.frame = parts, order, frame

    @staticmethod
    def partitionBy(*parts: str | Column) -> Window:  # noqa: N802
        return Window([_named(p) for p in parts])

    def orderBy(self, column: str | Column | _Order) -> Window:  # noqa: N802
        return Window(self.parts, column if isinstance(column, _Order) else _Order(_named(column), False))

    def rowsBetween(self, first: int, last: int) -> Window:  # noqa: N802
        if first != self.unboundedPreceding or last not in (0, -1, self.unboundedFollowing):
            raise NotImplementedError((first, last))
        return Window(self.parts, self.order, (first, last))

    def last(self) -> int | None:
        """Rows from the start of the part to this one, by their distance from the current one; None: all."""
        if self.frame is None:
            return None if self.order is None else 0
        return None if self.frame[1] == self.unboundedFollowing else self.frame[1]


class _Aggregate(Column):
    """One value a group, or over a window."""

    def __init__(self, how: str, column: Column | None, *more: object):
        super().__init__(lambda scope: running.of_groups(scope, how, column, more), how)
        self.how, self.column, self.more = how, column, more

    def over(self, window: Window) -> Column:
        return Column(lambda scope: running.over(scope, window, self.how, self.column, self.more))


def _aggregate(how: str) -> Callable[..., _Aggregate]:
    return lambda column: _Aggregate(how, _named(column))


sum, min, max, count_if, collect_list = (_aggregate(k) for k in ("sum", "min", "max", "count_if", "collect_list"))  # noqa: A001


def count(column: str | Column) -> _Aggregate:
    return _Aggregate("count_if", lit(True) if isinstance(column, str) and column == "*" else _named(column).isNotNull())


def first(column: str | Column, ignorenulls: bool = False) -> _Aggregate:
    return _Aggregate("first", _named(column), ignorenulls)


def last(column: str | Column, ignorenulls: bool = False) -> _Aggregate:
    return _Aggregate("last", _named(column), ignorenulls)


def lag(column: str | Column, offset: int = 1, default: object = None) -> _Aggregate:
    return _Aggregate("at", _named(column), -offset, default)


def lead(column: str | Column, offset: int = 1, default: object = None) -> _Aggregate:
    return _Aggregate("at", _named(column), offset, default)


def row_number() -> _Aggregate:
    return _Aggregate("row_number", None)


# Conditions as SQL.


class _Parser:
    """Conditions of names, numbers, words, comparisons, sums, IN, IS NULL, coalesce, NOT, AND and OR."""

    _TOKEN = re.compile(r"\s*('[^']*'|[A-Za-z_][A-Za-z_0-9.]*|\d+|<>|<=|>=|[=<>+\-(),])")
    _COMPARED = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            found = self._TOKEN.match(text, at)
            if not found:
                raise NotImplementedError(text)
            self.tokens.append(found[1])
            at = found.end()
        self.at = 0

    def _next_is(self, *words: str) -> bool:
        found = tuple(t.upper() for t in self.tokens[self.at : self.at + len(words)]) == words
        self.at += len(words) if found else 0
        return found

    def whole(self) -> Column:
        out = self._either()
        if self.at != len(self.tokens):
            raise NotImplementedError(self.tokens)
        return out

    def _either(self) -> Column:
        out = self._all()
        while self._next_is("OR"):
            out = out | self._all()
        return out

    def _all(self) -> Column:
        out = self._not()
        while self._next_is("AND"):
            out = out & self._not()
        return out

    def _not(self) -> Column:
        return ~self._not() if self._next_is("NOT") else self._compared()

    def _compared(self) -> Column:
        out = self._sum()
        if self._next_is("IS", "NOT", "NULL"):
            return out.isNotNull()
        if self._next_is("IS", "NULL"):
            return out.isNull()
        negated = self._next_is("NOT", "IN")
        if negated or self._next_is("IN"):
            options = []
            while not self._next_is(")"):
                self.at += 1
                token = self.tokens[self.at]
                options.append(token[1:-1] if token[0] == "'" else int(token))
                self.at += 1
            return ~out.isin(*options) if negated else out.isin(*options)
        if self.at < len(self.tokens) and (how := self._COMPARED.get(self.tokens[self.at])):
            self.at += 1
            return getattr(out, how)(self._sum())
        return out

    def _sum(self) -> Column:
        out = self._one()
        while self.at < len(self.tokens) and self.tokens[self.at] in "+-":
            self.at += 1
            out = out + self._one() if self.tokens[self.at - 1] == "+" else out - self._one()
        return out

    def _one(self) -> Column:
        token = self.tokens[self.at]
        self.at += 1
        if token == "(":
            out = self._either()
            self.at += 1
            return out
        if token == "-":
            return -self._one()
        if token[0] == "'":
            return lit(token[1:-1])
        if token.isdigit():
            return lit(int(token))
        if token.lower() == "coalesce":
            parts = []
            while not self._next_is(")"):
                self.at += 1
                parts.append(self._sum())
            return coalesce(*parts)
        return lit(token.lower() == "true") if token.lower() in ("true", "false") else col(token)

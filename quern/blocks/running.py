"""Windows and aggregates over the rows of a Frame: sorts by parts, then running values from cumulative sums and maxima."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np

from . import values as v
from .values import Values

if TYPE_CHECKING:
    from .expressions import Column, Window
    from .frame import Scope


class Parts:
    """Rows in order of their parts: by (a permutation, None if they are so already), and of each place the first and last one of its part."""

    def __init__(self, key: np.ndarray, order: np.ndarray | None):
        n = len(key)
        self.by = None if _sorted(key, order) else self._permutation(key, order)
        if self.by is not None:
            key = key[self.by]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
        self.starts = np.flatnonzero(new)
        self.part = np.cumsum(new) - 1
        self.sizes = np.diff(np.append(self.starts, n))
        self.first = self.starts[self.part]
        self.last = self.first + self.sizes[self.part] - 1

    @staticmethod
    def _permutation(key: np.ndarray, order: np.ndarray | None) -> np.ndarray:
        # Rows mostly come in order, or against it, so a stable sort by the part is enough.
        by = np.argsort(key, kind="stable")
        if order is None or _sorted(key[by], order[by]):
            return by
        back = np.arange(len(key) - 1, -1, -1)
        by = back[np.argsort(key[::-1], kind="stable")]
        return by if _sorted(key[by], order[by]) else np.lexsort((order, key))

    def sorted(self, of: np.ndarray) -> np.ndarray:
        return of if self.by is None else of[self.by]

    def placed(self, out: np.ndarray) -> np.ndarray:
        """Values by place as values by row."""
        if self.by is None:
            return out
        rows = np.empty_like(out)
        rows[self.by] = out
        return rows


def _sorted(key: np.ndarray, order: np.ndarray | None) -> bool:
    a, b = key[:-1], key[1:]
    return bool(np.all(a <= b)) if order is None else bool(np.all((a < b) | (a == b) & (order[:-1] <= order[1:])))


def parts(scope: Scope, columns: list[Column], order: object = None) -> Parts:
    by = [c.of(scope) for c in columns]
    along = None if order is None else order.column.of(scope)
    name = tuple(id(x.data) for x in v.flat(by)) + tuple(id(x.ok) for x in v.flat(by)) if not any(x.kind == "struct" for x in by) else None
    if name is not None and along is not None:
        name = (*name, "along", id(along.data), order.down)
    found = scope.parts.get(name) if name is not None else None
    if found is None:
        o = None if along is None or along.kind == "null" else -along.data if order.down else along.data
        found = (Parts(v.keys(by, scope.n), o), by, along)
        if name is not None:
            scope.parts[name] = found
    return found[0]


def over(scope: Scope, window: Window, how: str, column: Column | None, more: tuple) -> Values:
    p, upto = parts(scope, window.parts, window.order), window.last()
    n = scope.n
    place = np.arange(n)
    if how == "row_number":
        return Values("int", p.placed(place - p.first + 1), None, n)
    a = column.of(scope)
    if not n or a.kind == "null" and how not in ("at", "count_if"):
        return v.null(n)
    if how == "at":
        at = place + more[0]
        inside = (at >= p.first) & (at <= p.last)
        out = _gathered(p, a, np.where(inside, at, -1))
        if more[1] is None:
            return out
        return v.chosen(p.placed(inside), out, v.constant(more[1], n, scope.pool))
    end = p.last if upto is None else place + upto
    if how in ("first", "last"):
        return _gathered(p, a, _ends(p, a, end, how, more[0]))
    if how in ("sum", "count_if"):
        return _summed(p, a, end, how)
    if how in ("min", "max"):
        return _extremes(p, a, end, how, scope)
    raise NotImplementedError(how)


def _gathered(p: Parts, a: Values, at: np.ndarray) -> Values:
    """The values at the given places, null at negative ones."""
    rows = at if p.by is None else np.where(at < 0, -1, p.by[at])
    return v.take(a, p.placed(rows))


def _ends(p: Parts, a: Values, end: np.ndarray, how: str, ignore: bool) -> np.ndarray:
    """The place of the first or last value from the start of the part to `end`, -1 if there is none."""
    n = len(end)
    if not ignore or a.ok is None:
        return np.where(end >= p.first, p.first if how == "first" else end, -1)
    ok, place = p.sorted(a.ok), np.arange(n)
    if how == "last":
        seen = np.maximum.accumulate(np.where(ok, place, -1))
        at = np.where(end >= 0, seen[np.maximum(end, 0)], -1)
        return np.where(at >= p.first, at, -1)
    following = np.minimum.accumulate(np.where(ok, place, n)[::-1])[::-1]
    at = following[p.first]
    return np.where(at <= end, at, -1)


def _summed(p: Parts, a: Values, end: np.ndarray, how: str) -> Values:
    n = len(end)
    if how == "count_if":
        counted = p.sorted(a.true()).astype(np.int64)
    else:
        counted = p.sorted(np.asarray(a.data, np.int64) if a.ok is None else np.where(a.ok, a.data, 0))
    some = end >= p.first

    def upto(x: np.ndarray) -> np.ndarray:
        sums = np.cumsum(x)
        return np.where(some, sums[np.maximum(end, 0)] - (sums - x)[p.first], 0)

    out = p.placed(upto(counted))
    if how == "count_if":
        return Values("int", out, None, n)
    ok = some if a.ok is None else upto(p.sorted(a.ok).astype(np.int64)) > 0
    return Values("int", out, None if ok.all() else p.placed(ok), n)


def _numbers(a: Values, scope: Scope) -> tuple[np.ndarray, np.ndarray | None]:
    """Numbers in the order of the values, and the row of each number where they are no numbers themselves."""
    if a.kind in ("int", "bool"):
        return np.asarray(a.data, np.int64), None
    rows = np.flatnonzero(a.valid())
    _, first, told = np.unique(v.ranks(v.take(a, rows), scope.pool), return_index=True, return_inverse=True)
    out = np.zeros(a.n, np.int64)
    out[rows] = told
    return out, rows[first]


def _as_values(a: Values, best: np.ndarray, ok: np.ndarray, rows: np.ndarray | None) -> Values:
    if rows is not None:
        return v.take(a, np.where(ok, rows[np.where(ok, best, 0)], -1)) if len(rows) else v.null(len(ok))
    best = np.where(ok, best, 0)
    return Values(a.kind, best.astype(bool) if a.kind == "bool" else best, None if ok.all() else ok, len(ok))


def _extremes(p: Parts, a: Values, end: np.ndarray, how: str, scope: Scope) -> Values:
    n = len(end)
    data, rows = _numbers(a, scope)
    if how == "min":
        data = -data
    ok = a.valid()
    low = int(data.min())
    x = p.sorted(np.where(ok, data - low + 1, 0))
    span = int(x.max()) + 1
    if span * len(p.starts) > 1 << 62:
        some, x = np.unique(x, return_inverse=True)
        x = x + (some[0] != 0)
        some = some if some[0] == 0 else np.append(0, some)
        span = int(x.max()) + 1
    else:
        some = None
    # Each part is lifted above those before it.
    best = np.maximum.accumulate(x + p.part * span)
    got = np.where(end >= p.first, best[np.maximum(end, 0)] - p.part * span, 0)
    got = got if some is None else some[got]
    ok, best = got > 0, got + low - 1
    return _as_values(a, p.placed(-best if how == "min" else best), p.placed(ok), rows)


def of_groups(scope: Scope, how: str, column: Column, more: tuple) -> Values:
    rows_of, p = scope.grouped
    n = scope.n
    a = column.of(rows_of)
    if a.kind == "null" and how != "count_if":
        if how == "collect_list":
            return Values("list", (np.zeros(n, np.int64), np.zeros(n, np.int64), v.null(0)), None, n)
        return v.null(n)
    if not n:
        return Values("list", (np.zeros(0, np.int64), np.zeros(0, np.int64), a), None, 0) if how == "collect_list" else v.take(a, np.zeros(0, np.int64))
    if how in ("first", "last"):
        at = _ends(p, a, p.last, how, more[0])[p.starts]
        return v.take(a, at if p.by is None else np.where(at < 0, -1, p.by[at]))
    if how == "collect_list":
        rows = np.arange(a.n) if p.by is None else p.by
        part = p.part
        if a.ok is not None:
            kept = a.ok[rows]
            rows, part = rows[kept], part[kept]
        sizes = np.bincount(part, minlength=n)
        return Values("list", (np.cumsum(sizes) - sizes, sizes, v.take(a, rows)), None, n)
    if how == "count_if":
        return Values("int", np.add.reduceat(p.sorted(a.true()).astype(np.int64), p.starts), None, n)
    ok = a.valid()
    some = np.add.reduceat(p.sorted(ok).astype(np.int64), p.starts) > 0
    if how == "sum":
        return Values("int", np.add.reduceat(p.sorted(np.where(ok, a.data, 0)).astype(np.int64), p.starts), None if some.all() else some, n)
    data, rows = _numbers(a, rows_of)
    worst = np.iinfo(np.int64)
    data = p.sorted(np.where(ok, data, worst.min if how == "max" else worst.max))
    best = (np.maximum if how == "max" else np.minimum).reduceat(data, p.starts)
    return _as_values(a, best, some, rows)

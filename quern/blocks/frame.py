"""A block's rows as columns, with the part of Spark's DataFrame that the operators use."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import expressions as e, running, values as v
from .expressions import Column
from .values import Pool, Values


class Scope:
    """What a Column is evaluated in: n rows of named columns, or groups of the rows of another scope."""

    def __init__(self, n: int, pool: Pool, column: Callable[[str], Values], grouped: tuple | None = None, parts: dict | None = None):
        self.n, self.pool, self.named, self.grouped = n, pool, column, grouped
        self.known: dict = {}
        self.parts = {} if parts is None else parts

    def column(self, name: str) -> Values:
        return self.named(name)

    def repeated(self, rows: np.ndarray) -> Scope:
        return Scope(len(rows), self.pool, lambda name: v.take(self.named(name), rows))


class Frame:
    def __init__(self, cols: dict[str, Values], n: int, pool: Pool, parts: dict | None = None):
        self.cols, self.n, self.pool = cols, n, pool
        self._scope = Scope(n, pool, self._column, parts=parts)

    @property
    def columns(self) -> list[str]:
        return list(self.cols)

    def _column(self, name: str) -> Values:
        if name in self.cols:
            return self.cols[name]
        if "." not in name:
            raise KeyError(name)
        of, *fields = name.split(".")
        found = self.cols[of]
        for f in fields:
            found = v.field(found, f)
        return found

    def _evaluated(self, columns: dict[str, Column]) -> dict[str, Values]:
        found = {k: c.of(self._scope) for k, c in columns.items()}
        self._scope.known.clear()
        return found

    def _with(self, cols: dict[str, Values]) -> Frame:
        """The same rows."""
        return Frame(cols, self.n, self.pool, self._scope.parts)

    def _taken(self, rows: np.ndarray) -> Frame:
        return Frame({k: v.take(c, rows) for k, c in self.cols.items()}, len(rows), self.pool)

    def _exploded(self, name: str, many: Column) -> Frame:
        of = many.of(self._scope)
        if of.kind == "null":
            return self._taken(np.zeros(0, np.int64)).withColumn(name, e.lit(None))
        dense, row = e._dense(of)
        out = self._taken(row)
        return out._with({**out.cols, name: dense.data[2]})

    def withColumn(self, name: str, column: Column) -> Frame:  # noqa: N802
        return self.withColumns({name: column})

    def withColumns(self, columns: dict[str, Column]) -> Frame:  # noqa: N802
        for name, c in columns.items():
            if isinstance(c, e._Exploded):
                return self._exploded(name, c.many)
        return self._with(self.cols | self._evaluated(columns))

    def withColumnRenamed(self, before: str, after: str) -> Frame:  # noqa: N802
        return self._with({after if k == before else k: c for k, c in self.cols.items()})

    def select(self, *columns: str | Column | list) -> Frame:
        listed = [e._named(c) for x in columns for c in (x if isinstance(x, list) else self.columns if isinstance(x, str) and x == "*" else [x])]
        for c in listed:
            if isinstance(c, e._Exploded):
                kept = {x.name: x.of(self._scope) for x in listed if x is not c}
                return self._with(self.cols | {f"_kept_{k}": x for k, x in kept.items()})._exploded("_one", c.many).select(*(e.col("_one" if x is c else f"_kept_{x.name}").alias(x.name) for x in listed))
        return self._with(self._evaluated({c.name: c for c in listed}))

    def drop(self, *names: str) -> Frame:
        return self._with({k: c for k, c in self.cols.items() if k not in names})

    def where(self, which: str | Column) -> Frame:
        which = self._evaluated({"": e.expr(which) if isinstance(which, str) else which})[""].true()
        return self if which.all() else self._taken(np.flatnonzero(which))

    def groupBy(self, *by: str | Column) -> Groups:  # noqa: N802
        return Groups(self, [e._named(c) for c in by])

    def distinct(self) -> Frame:
        return self.groupBy(*self.columns).agg()

    def dropDuplicates(self, names: list[str]) -> Frame:  # noqa: N802
        p = running.parts(self._scope, [e.col(k) for k in names])
        return self._taken(p.starts if p.by is None else p.by[p.starts])

    def unionByName(self, other: Frame, allowMissingColumns: bool = False) -> Frame:  # noqa: N802, N803
        names = [*self.cols, *(k for k in other.cols if k not in self.cols)]
        if len(names) > min(len(self.cols), len(other.cols)) and not allowMissingColumns:
            raise ValueError(names)
        return Frame({k: v.joined(self.cols.get(k, v.null(self.n)), other.cols.get(k, v.null(other.n))) for k in names}, self.n + other.n, self.pool)

    def join(self, other: Frame, on: str | list[str], how: str = "inner") -> Frame:
        on = [on] if isinstance(on, str) else on
        both = v.keys([v.joined(self.cols[k], other.cols[k]) for k in on], self.n + other.n)
        usable = np.ones(self.n + other.n, bool)
        for k in on:
            usable &= np.concatenate([self.cols[k].valid(), other.cols[k].valid()])
        right = np.flatnonzero(usable[self.n :])
        key = both[self.n :][right]
        by = np.argsort(key, kind="stable")
        key, right = key[by], right[by]
        low, high = np.searchsorted(key, both[: self.n]), np.searchsorted(key, both[: self.n], "right")
        sizes = np.where(usable[: self.n], high - low, 0)
        if how == "left_anti":
            return self._taken(np.flatnonzero(sizes == 0))
        if how not in ("inner", "left"):
            raise NotImplementedError(how)
        out = np.maximum(sizes, 1) if how == "left" else sizes
        one = np.repeat(np.arange(self.n), out)
        at = np.repeat(low - (np.cumsum(out) - out), out) + np.arange(len(one))
        two = np.where(sizes[one] > 0, np.append(right, -1)[np.minimum(at, len(right))], -1)
        cols = {k: v.take(c, one) for k, c in self.cols.items()}
        return Frame(cols | {k: v.take(c, two) for k, c in other.cols.items() if k not in on}, len(one), self.pool)


class Groups:
    def __init__(self, rows: Frame, by: list[Column]):
        self.rows, self.by = rows, by

    def agg(self, *aggregates: Column) -> Frame:
        rows = self.rows
        p = running.parts(rows._scope, self.by)
        heads = p.starts if p.by is None else p.by[p.starts]
        cols = {c.name: v.take(c.of(rows._scope), heads) for c in self.by}
        groups = Scope(len(heads), rows.pool, lambda name: v.take(rows._column(name), heads), (rows._scope, p))
        out = Frame(cols | {c.name: c.of(groups) for c in aggregates}, len(heads), rows.pool)
        rows._scope.known.clear()
        return out

"""Columns of a block: numbers, words by their place in a pool, structs and lists, each with the rows that are not null.

Nulls, comparisons and orders are Spark's: a comparison with null is null, nulls come first, structs
compare by their fields from left to right, words by their UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np


class Pool:
    """The distinct words of a block."""

    def __init__(self, words: Iterable[str] = ()):
        self.words = list(words)
        self.at = {w: k for k, w in enumerate(self.words)}

    def code(self, word: str) -> int:
        found = self.at.setdefault(word, len(self.words))
        if found == len(self.words):
            self.words.append(word)
        return found

    def table(self, told: object, dtype: type) -> np.ndarray:
        """told(word) of every word."""
        return np.fromiter(map(told, self.words), dtype, len(self.words))

    def places(self) -> np.ndarray:
        """The place of every word in their order."""
        out = np.empty(len(self.words), np.int64)
        out[sorted(range(len(self.words)), key=lambda k: self.words[k].encode())] = np.arange(len(self.words))
        return out


class Values:
    """kind int, bool, word (places in the pool), struct (fields by name), list (starts, lengths, values of all), or null; ok is None where no row is null."""

    __slots__ = ("data", "kind", "n", "ok")

    def __init__(self, kind: str, data: object, ok: np.ndarray | None, n: int):
        self.kind, self.data, self.ok, self.n = kind, data, ok, n

    def valid(self) -> np.ndarray:
        if self.kind == "null":
            return np.zeros(self.n, bool)
        return np.ones(self.n, bool) if self.ok is None else self.ok

    def true(self) -> np.ndarray:
        """Where a condition is true, so neither false nor null."""
        if self.kind == "null":
            return np.zeros(self.n, bool)
        return self.data if self.ok is None else self.data & self.ok


class _Fields(Mapping):
    """Fields of a struct, each made when it is asked for: most are never."""

    def __init__(self, names: Iterable[str], make: Callable[[str], Values]):
        self.names, self.make, self.made = list(names), make, {}

    def __getitem__(self, name: str) -> Values:
        if name not in self.made:
            self.made[name] = self.make(name)
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def both(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    return b if a is None else a if b is None else a & b


def null(n: int) -> Values:
    return Values("null", None, None, n)


def constant(value: object, n: int, pool: Pool) -> Values:
    if value is None:
        return null(n)
    if isinstance(value, bool):
        return Values("bool", np.broadcast_to(np.bool_(value), n), None, n)
    if isinstance(value, str):
        return Values("word", np.broadcast_to(np.int64(pool.code(value)), n), None, n)
    return Values("int", np.broadcast_to(np.int64(value), n), None, n)


def take(v: Values, rows: np.ndarray) -> Values:
    """The given rows; null where one is negative."""
    n = len(rows)
    if v.n == n == 0:
        return v
    if v.kind == "null" or v.n == 0:
        return null(n)
    missing = rows < 0
    ok = None
    if missing.any():
        rows, ok = np.where(missing, 0, rows), ~missing
    if v.ok is not None:
        ok = both(ok, v.ok[rows])
    if v.kind == "struct":
        return Values("struct", _Fields(v.data, lambda k: take(v.data[k], rows)), ok, n)
    if v.kind == "list":
        return Values("list", (v.data[0][rows], v.data[1][rows], v.data[2]), ok, n)
    return Values(v.kind, v.data[rows], ok, n)


def joined(a: Values, b: Values) -> Values:
    """The rows of a, then those of b."""
    n = a.n + b.n
    if a.kind == "null" and b.kind == "null":
        return null(n)
    if a.kind == "null" or b.kind == "null":
        some = b if a.kind == "null" else a
        rows = np.arange(n) - (a.n if some is b else 0)
        return take(some, np.where((rows >= 0) & (rows < some.n), rows, -1)) if some.n else null(n)
    ok = None if a.ok is None and b.ok is None else np.concatenate([a.valid(), b.valid()])
    if a.kind == "struct":
        return Values("struct", _Fields(a.data, lambda k: joined(a.data[k], b.data[k])), ok, n)
    if a.kind == "list":
        starts = np.concatenate([a.data[0], b.data[0] + a.data[2].n])
        return Values("list", (starts, np.concatenate([a.data[1], b.data[1]]), joined(a.data[2], b.data[2])), ok, n)
    return Values(a.kind, np.concatenate([a.data, b.data]), ok, n)


def chosen(which: np.ndarray, a: Values, b: Values) -> Values:
    """a where `which`, else b."""
    if a.kind == "null" and b.kind == "null":
        return a
    if b.kind == "null":
        return Values(a.kind, a.data, both(which, a.ok), a.n)
    if a.kind == "null":
        return Values(b.kind, b.data, both(~which, b.ok), b.n)
    ok = None if a.ok is None and b.ok is None else np.where(which, a.valid(), b.valid())
    if a.kind == "struct":
        return Values("struct", _Fields(a.data, lambda k: chosen(which, a.data[k], b.data[k])), ok, a.n)
    if a.kind == "list":
        all_of = joined(a, b)
        return take(all_of, np.where(which, np.arange(a.n), a.n + np.arange(b.n)))
    return Values(a.kind, np.where(which, a.data, b.data), ok, a.n)


def field(v: Values, name: str) -> Values:
    if v.kind == "null":
        return v
    of = v.data[name]
    return of if of.kind == "null" else Values(of.kind, of.data, both(v.ok, of.ok), v.n)


def keys(columns: list[Values], n: int) -> np.ndarray:
    """Numbers that are equal where all columns are, nulls too, and ascend with them; words ascend by their place in the pool."""
    out, size = np.zeros(n, np.int64), 1
    for v in flat(columns):
        if v.kind == "null" or not n:
            continue
        data = np.asarray(v.data, np.int64)
        if v.ok is not None:
            data = np.where(v.ok, data, data.min())
        low = int(data.min())
        span = int(data.max()) - low + 2
        data = data - (low - 1)
        if v.ok is not None:
            data = np.where(v.ok, data, 0)
        if size * span > 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
            size = int(out.max()) + 1
        if size * span > 1 << 62:
            data = np.unique(data, return_inverse=True)[1]
            span = int(data.max()) + 1
        out, size = out * span + data, size * span
    return out


def flat(columns: Iterable[Values]) -> Iterable[Values]:
    """Columns without structs: whether one is null, then its fields."""
    for v in columns:
        if v.kind == "struct":
            if v.ok is not None:
                yield Values("bool", v.ok, None, v.n)
            yield from flat(field(v, k) for k in v.data)
        else:
            yield v


def ranks(v: Values, pool: Pool) -> np.ndarray:
    """Numbers in the order of the rows, none of which is null."""
    places = None
    columns = []
    for of in flat([v]):
        if of.kind == "word":
            places = pool.places() if places is None else places
            of = Values("int", places[of.data], of.ok, of.n)
        columns.append(of)
    return keys(columns, v.n)

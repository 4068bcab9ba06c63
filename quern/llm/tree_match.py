"""Simple tree matching of page outlines, and the wrapper of a host that it builds.

A matching pairs nodes of equal tags, roots with roots and children with children, in page order.
The size of the largest matching of two trees depends on their shapes alone, so it is kept by pair of
shapes. Where children are paired, nodes of equal content win ties. Nothing is bounded by the number
of children or levels: long lists are aligned by rows, with the memory of two rows where the whole table
would be large, and no function calls itself by depth.
"""

from __future__ import annotations

import numpy as np

LINE = "#"
#: Cells of an alignment that are held at once; beyond, the list is halved.
CELLS = 1 << 22


class Block:
    """A block element or, without children, a line of text."""

    __slots__ = ("tag", "kids", "digest", "shape", "size", "slot")

    def __init__(self, tag: str, digest: int = 0):
        self.tag, self.digest, self.kids = tag, digest, []
        self.shape = self.size = 0
        self.slot = b""


def settled(root: Block) -> list[Block]:
    """The blocks of a tree in page order, with shapes, sizes and digests from the bottom up."""
    order, todo = [], [root]
    while todo:
        one = todo.pop()
        order.append(one)
        todo += reversed(one.kids)
    for one in reversed(order):
        one.size = 1 + sum(k.size for k in one.kids)
        one.shape = hash((one.tag, *[k.shape for k in one.kids]))
        if one.tag != LINE:
            one.digest = hash((one.tag, *[k.digest for k in one.kids]))
    return order


def _row(last: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The next row of best sums: skip one side's node, or pair both."""
    row = last.copy()
    np.maximum(row[1:], last[:-1] + weight, out=row[1:])
    return np.maximum.accumulate(row, out=row)


class _Weights:
    """Weights of the pairs of two lists: twice the size of their matching, and one for equal content."""

    def __init__(self, a: list[Block], b: list[Block], memo: dict, by_content: bool):
        self.a, self.b = a, b
        of_a, of_b = {x.shape: x for x in a}, {y.shape: y for y in b}
        place_a, place_b = ({s: k for k, s in enumerate(of)} for of in (of_a, of_b))
        self.table = np.array([[2 * memo[x.shape, y.shape] if x.tag == y.tag else 0 for y in of_b.values()] for x in of_a.values()], np.int64)
        self.of_a, self.of_b = [place_a[x.shape] for x in a], np.array([place_b[y.shape] for y in b])
        self.content = np.array([y.digest for y in b], np.int64) if by_content else None

    def row(self, i: int, lo: int, hi: int) -> np.ndarray:
        weight = self.table[self.of_a[i]][self.of_b[lo:hi]]
        if self.content is not None:
            weight = weight + ((weight > 0) & (self.content[lo:hi] == self.a[i].digest))
        return weight

    def total(self) -> int:
        last = np.zeros(len(self.b) + 1, np.int64)
        for i in range(len(self.a)):
            last = _row(last, self.row(i, 0, len(self.b)))
        return int(last[-1])

    def pairs(self) -> list[tuple[int, int]]:
        out, todo = [], [(0, len(self.a), 0, len(self.b))]
        while todo:
            top, bottom, lo, hi = todo.pop()
            if bottom - top > 1 and (bottom - top) * (hi - lo) > CELLS:
                middle = (top + bottom) // 2
                above = below = np.zeros(hi - lo + 1, np.int64)
                for i in range(top, middle):
                    above = _row(above, self.row(i, lo, hi))
                for i in range(bottom - 1, middle - 1, -1):
                    below = _row(below, self.row(i, lo, hi)[::-1])
                cut = lo + int(np.argmax(above + below[::-1]))
                todo += [(middle, bottom, cut, hi), (top, middle, lo, cut)]
                continue
            rows = [np.zeros(hi - lo + 1, np.int64)]
            for i in range(top, bottom):
                rows.append(_row(rows[-1], self.row(i, lo, hi)))
            i, j, found = bottom - top, hi - lo, []
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((top + i, lo + j))
            out += reversed(found)
        return out


def matching(a: Block, b: Block, memo: dict) -> int:
    """The number of nodes in the largest matching of two trees."""
    todo = [(a, b)] if a.tag == b.tag else []
    while todo:
        x, y = todo[-1]
        key = x.shape, y.shape
        if key in memo:
            todo.pop()
            continue
        if x.shape == y.shape or not x.kids or not y.kids:
            memo[key] = x.size if x.shape == y.shape else 1
            continue
        missing = _missing(x.kids, y.kids, memo)
        if missing:
            todo += missing
        else:
            memo[key] = 1 + _Weights(x.kids, y.kids, memo, False).total() // 2
    return memo[a.shape, b.shape] if a.tag == b.tag else 0


def _missing(a: list[Block], b: list[Block], memo: dict) -> list[tuple[Block, Block]]:
    of_a, of_b = {x.shape: x for x in a}, {y.shape: y for y in b}
    return [(x, y) for x in of_a.values() for y in of_b.values() if x.tag == y.tag and (x.shape, y.shape) not in memo]


def aligned(a: list[Block], b: list[Block], memo: dict) -> list[tuple[int, int]]:
    """Places of the children that the best alignment of two lists pairs."""
    if len(a) == len(b) and [x.tag for x in a] == [y.tag for y in b] and len({x.tag for x in a}) == len(a):
        return [(k, k) for k in range(len(a))]
    first, end = 0, 0
    least = min(len(a), len(b))
    while first < least and a[first].digest == b[first].digest and a[first].tag == b[first].tag:
        first += 1
    while end < least - first and a[-1 - end].digest == b[-1 - end].digest and a[-1 - end].tag == b[-1 - end].tag:
        end += 1
    inner_a, inner_b = a[first : len(a) - end], b[first : len(b) - end]
    out = [(k, k) for k in range(first)]
    if inner_a and inner_b:
        for x, y in _missing(inner_a, inner_b, memo):
            matching(x, y, memo)
        out += [(first + i, first + j) for i, j in _Weights(inner_a, inner_b, memo, True).pairs()]
    return out + [(len(a) - end + k, len(b) - end + k) for k in range(end)]


def merged(trees: list[Block]) -> Block:
    """The union of trees: what matches is one node, the rest is put in beside its neighbours."""
    wrapper = trees[0]
    for other in trees[1:]:
        memo: dict = {}
        todo = [(wrapper, other)]
        while todo:
            own, more = todo.pop()
            partner = dict((j, i) for i, j in aligned(own.kids, more.kids, memo))
            todo += [(own.kids[i], more.kids[j]) for j, i in partner.items()]
            kids, taken = [], 0
            for j, kid in enumerate(more.kids):
                if j in partner:
                    kids += own.kids[taken : partner[j] + 1]
                    taken = partner[j] + 1
                else:
                    kids.append(kid)
            own.kids = kids + own.kids[taken:]
        settled(wrapper)
    return wrapper


def numbered(wrapper: Block) -> Block:
    """The wrapper with a name for each of its slots."""
    for k, one in enumerate(settled(wrapper)):
        one.slot = b"%d" % k
    return wrapper


def flat(wrapper: Block) -> tuple[list[str], list[int], list[int]]:
    """Tags, numbers of children and digests in page order."""
    order = settled(wrapper)
    return [x.tag for x in order], [len(x.kids) for x in order], [x.digest if x.tag == LINE else 0 for x in order]


def unflat(tags: list[str], sizes: list[int], digests: list[int]) -> Block:
    root, todo = None, []
    for tag, size, digest in zip(tags, sizes, digests, strict=True):
        one = Block(tag, digest)
        if todo:
            todo[-1][0].kids.append(one)
            todo[-1][1] -= 1
        else:
            root = one
        while todo and not todo[-1][1]:
            todo.pop()
        if size:
            todo.append([one, size])
    return numbered(root)

"""Suffix arrays of many short texts at once, by prefix doubling in numpy."""

from __future__ import annotations

import numpy as np

from . import textbytes as tb

_KEY_BYTES = 6
_END = 0xFE  # never occurs in UTF-8; stands for a NUL of the text, as 0 marks what is past its end


def suffix_order(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `data` sorted by text, then by the suffix up to the end of that text; and a bound.

    The bound says for each place how many bytes that suffix and the one before it may share at most.

    Suffixes are first sorted by text and six bytes in one 64-bit key; then only those whose group
    still has several members are sorted again, by the rank of the suffix that starts where the
    known part ends, which doubles that part. The number of rounds is the logarithm of the longest
    repeat.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    left = np.repeat(offsets[1:], sizes) - np.arange(n)
    padded = np.zeros(n + _KEY_BYTES, np.uint8)
    padded[:n] = np.where(data == 0, _END, data)
    key = text.copy()
    for k in range(_KEY_BYTES):
        key = (key << np.uint64(8)) | np.where(left > k, padded[k : k + n], 0).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    known = _KEY_BYTES
    bound = np.where(fresh, known, 0)
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    at = np.flatnonzero(~alone)
    while len(at):
        pos = order[at]
        ahead = np.minimum(pos + known, n - 1)
        second = np.where(left[pos] > known, rank[ahead] + 1, 0)
        key = rank[pos].astype(np.uint64) * np.uint64(n + 1) + second.astype(np.uint64)
        by = np.argsort(key)
        key, pos = key[by], pos[by]
        order[at] = pos
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[pos] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        new = at[fresh]
        bound[new] = np.where(bound[new] > 0, bound[new], 2 * known)
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        at = at[~alone]
        known *= 2
    return order, bound


def long_prefixes(data: np.ndarray, offsets: np.ndarray, order: np.ndarray, bound: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix in `order` with the one before it in the same text; 0 where below `least`."""
    n = len(data)
    lcp = np.zeros(n + 1, np.int64)
    if n < 2:
        return lcp
    end = np.repeat(offsets[1:], np.diff(offsets))
    sums = tb.prefix_hash(data)
    at = np.flatnonzero(bound[1:] >= least)
    a, b = order[at], order[at + 1]
    room = np.minimum(end[a] - a, end[b] - b)
    fits = (end[a] == end[b]) & (room >= least)
    at, a, b, room = at[fits], a[fits], b[fits], room[fits]
    primes: np.ndarray | None = None

    def agree(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        nonlocal primes
        out = tb.span_hash(sums, a, a + size) == tb.span_hash(sums, b, b + size)
        long = np.flatnonzero(out & (size >= tb.LONG_SPAN))
        if len(long):
            primes = tb.prime_sums(data) if primes is None else primes
            a, b, size = a[long], b[long], size[long]
            out[long] = tb.long_span_hash(primes, a, a + size) == tb.long_span_hash(primes, b, b + size)
        return out

    same = agree(a, b, np.full(len(a), least))
    at, a, b, room = at[same], a[same], b[same], room[same]
    low, high = np.full(len(at), least), room
    while len(at) and (low < high).any():
        middle = (low + high + 1) // 2
        same = agree(a, b, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    lcp[at + 1] = low
    return lcp


def bounded_order(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of `data` sorted by the suffix up to the end of its string, equal suffixes by position.

    For many short strings that are laid end to end: the rounds end with the longest string.
    """
    n = len(data)
    sizes = np.diff(offsets)
    left = (np.repeat(offsets[1:], sizes) - np.arange(n)).astype(np.int32)
    key = np.zeros(n + 8, np.uint64)
    key[:n] = np.where(data == 0, _END, data)
    # Eight bytes in one number, by doubling; what lies past the end of the string is cleared.
    for span in (1, 2, 4):
        key[:-span] = (key[:-span] << np.uint64(8 * span)) | key[span:]
    key = key[:n] & (~np.uint64(0) << (8 * np.maximum(8 - left, 0)).astype(np.uint64))
    order = np.argsort(key).astype(np.int32)
    rank = np.empty(n, np.int32)
    known, longest = 8, int(sizes.max(initial=0))
    at, key = np.arange(n, dtype=np.int32), key[order]
    while True:
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[order[at]] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        at = at[~alone]
        pos = order[at]
        if known >= longest or not len(at):
            order[at] = pos[np.lexsort((pos, rank[pos]))]
            return order
        second = np.where(left[pos] > known, rank[np.minimum(pos + known, n - 1)] + 1, 0)
        key = rank[pos].astype(np.uint64) * np.uint64(n + 1) + second.astype(np.uint64)
        by = np.argsort(key)
        key = key[by]
        order[at] = pos[by]
        known *= 2

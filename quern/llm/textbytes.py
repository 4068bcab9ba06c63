"""Vectorised views of the texts in an Arrow batch: bytes, words and substring hashes.

A block is a run of whole texts, laid end to end in one uint8 array with the offsets of each text.
All functions take and return numpy arrays, so the cost per byte is a few nanoseconds, and a block
is never larger than `limit` bytes unless a single text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
#: Blocks of the pipeline's stages, whose Python workers stay beside a JVM that several stages have filled: arrays take about 70 bytes a byte in near_dedup.
SMALL_BLOCK_BYTES = 1 << 19
#: Texts of a block: their numbers fit 16 bits.
BLOCK_TEXTS = (1 << 16) - 1
_BASE = 0x9E3779B97F4A7C15
_U64 = np.uint64


def _table(pattern_bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(pattern_bytes)] = True
    return table


#: White space of the word pattern [^\x20\x09-\x0D]+ .
SPACE = _table([0x20, *range(0x09, 0x0E)])
#: Bytes of the normalised word pattern, after lower-casing A-Z: digits, a-z and all beyond ASCII.
ALNUM = _table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U64(33))
    h *= _U64(0xFF51AFD7ED558CCD)
    h ^= h >> _U64(33)
    h *= _U64(0xC4CEB9FE1A85EC53)
    h ^= h >> _U64(33)
    return h


#: One odd 64-bit value for each byte value.
BYTE_HASH = mix(np.arange(1, 257, dtype=_U64) * _U64(_BASE)) | _U64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U64), "down": np.ones(1, _U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least."""
    for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
        have = _powers[name]
        while len(have) < n:
            have = np.concatenate([have, have * _U64(pow(base, len(have), 1 << 64))])
        _powers[name] = have
    return _powers["up"], _powers["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() gets the hash of any span of `data`."""
    sums = np.zeros(len(data) + 1, _U64)
    np.cumsum(BYTE_HASH[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal byte strings, wherever they are."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def gram_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """span_hash() of each span of `width` bytes."""
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * powers(len(sums))[1][:n])


#: A second modulus for spans so long that texts exist whose hashes modulo 2^64 agree for any base, as those of Thue and Morse.
_PRIME = (1 << 31) - 1
_PRIME_BASE = 0x2545F491
LONG_SPAN = 512
_prime_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U64), "down": np.ones(1, _U64)}


def prime_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which long_span_hash() gets the hash of any span of `data` modulo a prime."""
    n = len(data) + 1
    for name, base in (("up", _PRIME_BASE), ("down", pow(_PRIME_BASE, -1, _PRIME))):
        have = _prime_powers[name]
        while len(have) < n:
            have = np.concatenate([have, have * _U64(pow(base, len(have), _PRIME)) % _U64(_PRIME)])
        _prime_powers[name] = have
    sums = np.zeros(n, _U64)
    np.cumsum((data.astype(_U64) + _U64(1)) * _prime_powers["up"][: n - 1] % _U64(_PRIME), out=sums[1:])
    return sums


def long_span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal byte strings, wherever they are; independent of span_hash()."""
    return (sums[end] - sums[start]) % _U64(_PRIME) * _prime_powers["down"][start] % _U64(_PRIME)


def text_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """span_hash() of words or lines of any length: long ones count with their hash modulo a prime too."""
    out = span_hash(prefix_hash(data) if sums is None else sums, starts, ends)
    long = np.flatnonzero(ends - starts >= LONG_SPAN)
    if len(long):
        out[long] = mix(out[long] ^ mix(long_span_hash(prime_sums(data), starts[long], ends[long])))
    return out


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Yields (first row, row past the last, bytes, offsets from 0) over a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1), lo + BLOCK_TEXTS)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes that stay inside one text, and each text's first word."""
    n = len(is_word)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = is_word
    after = np.zeros(n + 1, bool)
    after[:-1] = is_word
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def normal_words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased words joined by one space each, with starts and ends of the words, and each text's first word."""
    lowered = LOWER[data]
    starts, ends, first = word_spans(~SPACE[lowered], offsets)
    n = len(starts)
    sizes = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(starts - to[:-1], sizes) + np.arange(to[-1])
    out = lowered[np.minimum(source, max(len(lowered) - 1, 0))] if n else np.zeros(0, np.uint8)
    out[to[1:] - 1] = 0x20
    return out.tobytes(), to[:-1], to[1:] - 1, first


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `flags` over each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in at least one span."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes, one for each start."""
    n = max(len(words) - size + 1, 0)
    out = np.zeros(n, _U64)
    for k in range(size):
        out = out * _U64(_BASE) + words[k : k + n]
    return mix(out)

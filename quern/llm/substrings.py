"""Exact substring deduplication: interval expansion on a Burrows-Wheeler transform, bounded by a threshold.

Every window of `size` bytes is dealt by its minimiser, the smallest hash of its short substrings:
equal windows have equal minimisers, so they meet in one bucket. Neighbouring windows with the same
minimiser travel together as one stretch, compressed in blocks, and a stretch that a smaller
document of the same block also has is settled at once and doesn't travel.

In a bucket, equal stretches are merged under their smallest document. The stretches whose
minimiser several documents have are laid out as one text; its suffix array gives the transform.
From the intervals of single bytes, each round extends all intervals of two or more rows by each
possible byte to the left, breadth first: round n holds exactly the repeated strings of length n, so common prefixes come in increasing order, and the expansion stops at `size`. The
intervals then left are the repeated windows, each with the smallest document that has it.

Cases: a null text counts as empty; texts shorter than a window lose nothing; a null id counts as
larger than all others; rows with equal ids never cost each other anything; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb
from .removal import NO_ID, tagged, without_spans
from .suffixes import bounded_order

WINDOW = 50
ANCHOR = 10
BLOCK = 16 << 20
BUCKET_BYTES = 12 << 20
#: Bytes of texts whose minimisers are found at once.
HASHED_BYTES = 1 << 19
#: Spans that are gathered at once.
GATHERED = 1 << 13
#: Compressed bytes of a bucket that are solved together.
SHARE_BYTES = 1 << 19
#: What is sorted at once; small enough for the cache.
PART_BYTES = 1 << 19
_LEVEL = 6


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = max(len(values) - width + 1, 0)
    span = 1
    low = values
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
        span *= 2
    return np.minimum(low[:n], low[width - span : width - span + n])


def _minimisers(sums: np.ndarray, size: int, anchor: int) -> np.ndarray:
    """The smallest hash of `anchor` bytes in each window of `size` bytes."""
    if len(sums) <= size:
        return np.zeros(0, np.uint64)
    return _sliding_min(tb.gram_hash(sums, anchor), size - anchor + 1)


def _stretches(sums: np.ndarray, offsets: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Start, end, text and minimiser of each stretch of windows; at most twice `size` bytes long."""
    low = _minimisers(sums, size, anchor)
    if not len(low):
        none = np.zeros(0, np.int64)
        return none, none, none, low
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[: len(low)] == text[size - 1 :]
    new = inside.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, low[:0]
    # Long runs of one minimiser, as in "aaaa", are cut.
    place = np.arange(len(low))
    since = place - first[np.maximum(np.cumsum(new) - 1, 0)]
    new |= inside & (since % size == 0)
    starts = np.flatnonzero(new)
    stop = ~inside | new
    following = np.concatenate([np.flatnonzero(stop), [len(low)]])
    ends = following[np.searchsorted(following, starts, "right")] + size - 1
    return starts, ends, text[starts], low[starts]


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans laid end to end, and their offsets; a part at a time, as places take more memory than bytes."""
    sizes = ends - starts
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(to[-1], data.dtype)
    for a in range(0, len(sizes), GATHERED):
        part = slice(a, a + GATHERED)
        lo, hi = to[a], to[min(a + GATHERED, len(sizes))]
        out[lo:hi] = data[np.repeat(starts[part] - to[:-1][part], sizes[part]) + np.arange(lo, hi)]
    return out, to


def _share_bytes(low: np.ndarray) -> np.ndarray:
    """A byte of each minimiser, by which the stretches of a bucket are parted."""
    return (tb.mix(low) >> np.uint64(56)).astype(np.uint8)


def _packed(squeeze, ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shares: np.ndarray, data: np.ndarray) -> bytes:
    """Columns that differ little from row to row, then the bytes."""
    steps = np.diff(ids, prepend=0).astype("<i8")
    parts = [np.array([len(ids)], "<i8"), steps.view(np.uint8).reshape(-1, 8).T.copy(), tags.astype("<u4"), starts.astype("<i4").view(np.uint8).reshape(-1, 4).T.copy(), sizes.astype(np.uint8), shares, data]
    return squeeze.compress(b"".join(p.tobytes() for p in parts))


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8, []
    for width in (8, 4, 4, 1, 1):
        out.append(np.frombuffer(raw, np.uint8, n * width, at))
        at += n * width
    ids = np.cumsum(out[0].reshape(8, n).T.copy().view("<i8").ravel())
    starts = out[2].reshape(4, n).T.copy().view("<i4").ravel()
    return ids, out[1].view("<u4"), starts, out[3].astype(np.int64), out[4], np.frombuffer(raw, np.uint8, offset=at)


_MAPPED = "bucket int, block binary, doc_id long, tag long, start int, size int"


def _mapped_rows(bucket=(), block=(), ids=(), tags=(), starts=(), sizes=()) -> pa.RecordBatch:
    n, m = len(bucket), len(ids)
    columns = [
        pa.array([*bucket, *[-1] * m], pa.int32()),
        pa.array([*block, *[None] * m], pa.binary()),
        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(ids, pa.int64())]),
        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(tags, pa.int64())]),
        pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(starts, pa.int32())]),
        pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(sizes, pa.int32())]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "doc_id", "tag", "start", "size"])


def _merged_spans(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of one row that touch or overlap become one."""
    by = np.lexsort((starts, tags, ids))
    ids, tags, starts, ends = ids[by], tags[by], starts[by], ends[by]
    if not len(ids):
        return ids, tags, starts, ends
    other = np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
    row = np.cumsum(other) - 1
    step = int(ends.max()) + 1
    reach = np.maximum.accumulate(ends + row * step) - row * step
    new = other.copy()
    new[1:] |= starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return ids[at], tags[at], starts[at], np.maximum.reduceat(ends, at)


def _dealt(batches: Iterator[pa.RecordBatch], size: int, anchor: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of stretches for each bucket, and the spans that are settled within a block."""
    squeeze = zstandard.ZstdCompressor(level=_LEVEL)

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, tags, starts, low, whole, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
        to = np.concatenate([[0], np.cumsum(sizes)])
        by = np.lexsort((ids, whole))
        new = np.concatenate([[True], whole[by][1:] != whole[by][:-1]])
        least = np.empty(len(ids), np.int64)
        least[by] = ids[by][np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = ids > least
        spans = _merged_spans(ids[late], tags[late], starts[late], starts[late] + sizes[late])
        yield _mapped_rows(ids=spans[0], tags=spans[1], starts=spans[2], sizes=spans[3] - spans[2])
        rest = np.flatnonzero(~late)
        bucket = (low[rest] % np.uint64(buckets)).astype(np.int64)
        rest = rest[np.lexsort((starts[rest], ids[rest], bucket))]
        bucket = np.sort(bucket)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own = rest[a:b]
            text, _ = _gathered(data, to[own], to[own + 1])
            yield _mapped_rows([int(bucket[a])], [_packed(squeeze, ids[own], tags[own], starts[own], sizes[own], _share_bytes(low[own]), text)])

    held, amount = [], 0
    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_numpy()
        tags = batch.column(1).to_numpy()
        for lo, hi, data, offsets in tb.text_blocks(batch.column(2), HASHED_BYTES):
            sums = tb.prefix_hash(data)
            starts, ends, text, low = _stretches(sums, offsets, size, anchor)
            if len(starts):
                whole = tb.span_hash(sums, starts, ends)
                held.append((ids[lo:hi][text], tags[lo:hi][text], starts - offsets[text], low, whole, ends - starts, _gathered(data, starts, ends)[0]))
                amount += hi - lo and len(data)
            if amount >= BLOCK:
                yield from flush(held)
                held, amount = [], 0
    if held:
        yield from flush(held)


def repeated_intervals(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of the strings of a block, and the intervals (first row, row past the last) of their repeated substrings of `size` bytes."""
    order = bounded_order(data, offsets)
    n = len(order)
    begin = np.zeros(n + 1, bool)
    begin[offsets[:-1]] = True
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    # The step of the transform: the row of the suffix that is one byte longer, none at the start of a string.
    longer = np.where(begin[order], np.int32(-1), place[order - 1])
    lead = data[order]
    # Round one: the rows of each byte, those of suffixes that are one byte long among them.
    edges = np.concatenate([np.flatnonzero(np.diff(lead.astype(np.int16), prepend=-1)), [n]])
    low, high = edges[:-1], edges[1:]
    rows, tag, seen = np.arange(n, dtype=np.int32), np.empty(n, np.int32), np.zeros(n, bool)
    for _ in range(1, size):
        to = longer[rows]
        real = to >= 0
        tag[to[real]] = np.repeat(np.arange(len(low), dtype=np.int32), high - low)[real]
        seen[to[real]] = True
        to = np.flatnonzero(seen).astype(np.int32)
        seen[to] = False
        if not len(to):
            return order, to, to
        own, byte = tag[to], lead[to]
        at = np.concatenate([[0], 1 + np.flatnonzero((own[1:] != own[:-1]) | (to[1:] != to[:-1] + 1) | (byte[1:] != byte[:-1])), [len(to)]])
        several = np.diff(at) > 1
        rows = to[np.repeat(several, np.diff(at))]
        low, high = to[at[:-1][several]], to[at[1:][several] - 1] + 1
        if not len(low):
            return order, low, high
    return order, low, high


def _first_holders(strings: np.ndarray, to: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """For each byte place of the distinct strings: the smallest id among all places that begin the same window."""
    least = np.repeat(ids, np.diff(to))
    order, low, high = repeated_intervals(strings, to, size)
    if len(low):
        widths = high - low
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(widths)[:-1]]), widths) + np.arange(widths.sum())
        places = order[rows]
        first = np.minimum.reduceat(least[places], np.concatenate([[0], np.cumsum(widths)[:-1]]))
        least[places] = np.repeat(first, widths)
    return least


def _solved(ids, tags, starts, sizes, data, size: int, anchor: int):
    """Spans (id, tag, start, end) to remove, from all stretches of one bucket."""
    to = np.concatenate([[0], np.cumsum(sizes)])
    sums = tb.prefix_hash(data)
    whole = tb.span_hash(sums, to[:-1], to[1:])
    by = np.lexsort((ids, whole))
    new = np.concatenate([[True], whole[by][1:] != whole[by][:-1]])
    kind = np.empty(len(ids), np.int64)
    kind[by] = np.cumsum(new) - 1
    sample = by[new]  # a stretch of the smallest id for each kind
    late = ids > ids[sample][kind]
    shared, group = _candidates(sums, to[sample], to[sample + 1], size, anchor)
    out = [(ids[late], tags[late], starts[late], starts[late] + sizes[late])]
    if len(shared):
        for part in _parts(shared, group, to[sample + 1] - to[sample]):
            own = sample[part]
            strings, edge = _gathered(data, to[own], to[own + 1])
            least = _first_holders(strings, edge, ids[own], size)
            gone = least < np.repeat(ids[own], np.diff(edge))
            runs = tb.runs(gone)
            # Runs are cut where a string ends: the last windows of a string begin before its last bytes.
            string = np.searchsorted(edge, runs[0], "right") - 1
            begin, end = runs[0] - edge[string], runs[1] - edge[string] + size - 1
            # All stretches of the kind in the same, smallest id lose the same windows.
            same = np.flatnonzero(~late)
            same = same[np.argsort(kind[same], kind="stable")]
            kinds = kind[own][string]
            a, b = np.searchsorted(kind[same], kinds), np.searchsorted(kind[same], kinds, "right")
            which = np.repeat(np.arange(len(kinds)), b - a)
            rows = same[np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())]
            out.append((ids[rows], tags[rows], starts[rows] + begin[which], starts[rows] + end[which]))
    return _merged_spans(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _least_grams(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimiser of each string; the hashes of all its short substrings, and where each string's begin."""
    grams, edges = _gathered(tb.gram_hash(sums, anchor), starts, ends - anchor + 1)
    return np.minimum.reduceat(grams, edges[:-1]) if len(starts) else grams, grams, edges


def _candidates(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings that may share a window with another, and a number for each string's minimiser.

    A window reaches at least `side` bytes beyond the minimiser on its left or on its right, so
    strings that share one have those bytes, and the minimiser, in common.
    """
    side = (size - anchor + 1) // 2
    low, grams, edges = _least_grams(sums, starts, ends, anchor)
    least = np.flatnonzero(grams == np.repeat(low, np.diff(edges)))
    string = np.searchsorted(edges, least, "right") - 1
    place = starts[string] + least - edges[string]
    some = np.bincount(string, minlength=len(starts)) > 1  # where the minimiser occurs again, any place may be the one
    first = np.concatenate([[True], string[1:] != string[:-1]])
    place = place[first]
    for begin, end in ((place - side, place + anchor), (place, place + anchor + side)):
        own = np.flatnonzero((begin >= starts) & (end <= ends))
        _, where, count = np.unique(tb.span_hash(sums, begin[own], end[own]), return_inverse=True, return_counts=True)
        some[own[count[where] > 1]] = True
    group = np.unique(low, return_inverse=True)[1]
    several = np.bincount(group[some], minlength=group.max(initial=0) + 1)[group] > 1
    return np.flatnonzero(some & several), group


def _parts(shared: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """`shared` in parts of whole minimiser groups, of about PART_BYTES each."""
    shared = shared[np.argsort(group[shared], kind="stable")]
    filled = np.cumsum(sizes[shared]) // PART_BYTES
    last = np.flatnonzero(np.diff(group[shared], append=-1))
    part = np.repeat(filled[last], np.diff(last, prepend=-1))
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield shared[a:b]


def _settled(batches: Iterator[pa.RecordBatch], size: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; spans that are settled already pass through."""
    spread = zstandard.ZstdDecompressor()

    def done(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        # A bucket is solved in shares, by minimiser, so that its working arrays stay small.
        shares: list[list] = [[] for _ in range(1 + sum(map(len, blocks)) // SHARE_BYTES)]
        while blocks:
            ids, tags, starts, sizes, share, data = _unpacked(spread.decompress(blocks.pop()))
            to = np.concatenate([[0], np.cumsum(sizes)])
            if len(shares) > 256:  # more than a byte tells apart
                low, _, _ = _least_grams(tb.prefix_hash(data), to[:-1], to[1:], anchor)
                share = (tb.mix(low) % np.uint64(len(shares))).astype(np.int64)
            else:
                share = share.astype(np.int64) * len(shares) >> 8
            for k, held in enumerate(shares):
                own = np.flatnonzero(share == k)
                held.append((ids[own], tags[own], starts[own], sizes[own], _gathered(data, to[own], to[own + 1])[0]))
        while shares:
            columns = [np.concatenate(x) for x in zip(*shares.pop(), strict=True)]
            if len(columns[0]):
                ids, tags, starts, ends = _solved(*columns, size, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends - starts, pa.int32())], names=["key", "tag", "start", "size"])

    now, held = -1, []
    for batch in batches:
        passing = batch.filter(pc.less(batch.column(0), 0))
        yield passing.select(["doc_id", "tag", "start", "size"]).rename_columns(["key", "tag", "start", "size"])
        for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket >= 0:
                if bucket != now and held:
                    yield from done(held)
                    held = []
                now = bucket
                held.append(block.as_py())
    if held:
        yield from done(held)


def removable_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(key, tag, start, size) byte spans of `docs` (doc_id, tag, text) whose windows also start in a row with a smaller id."""
    amount = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + 4 * amount // BUCKET_BYTES
    blocks = docs.select("doc_id", "tag", "text").mapInArrow(lambda b: _dealt(b, window, anchor, buckets), _MAPPED)
    # Settled spans are dealt by their document, blocks by their bucket.
    key = F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(F.xxhash64("doc_id"))
    dealt = blocks.repartition(key).sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda b: _settled(b, window, anchor), "key long, tag long, start int, size int")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """What is left of each row of `docs` without the windows that a smaller id also has."""
    docs = tagged(docs, id_col, text_col)
    return without_spans(docs, removable_spans(docs, window, anchor), keep_text=keep_text)

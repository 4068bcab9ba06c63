"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash of a place is the sum of table values of the bytes before it, each shifted by its
distance, modulo 2^64; a chunk may end where its top bits are zero. It depends on the last 64 bytes
alone, so an insertion moves no boundary beyond the next one. All places of a block are hashed at
once, by doubling the number of bytes that a sum covers. Chunks are named by a digest; the smallest
document that holds one keeps it, at the first place where it has it. A run of chunks that are held
elsewhere is removed when it is at least `least` bytes long or covers the whole text, so that a short
common phrase alone costs a text nothing and an exact copy of any length goes.

Copies within a block of texts are settled before the shuffle, so one very common chunk is a row a
block. What is left is dealt and sorted by digest and streams past: the first row of a digest names
its holder, and no group is gathered.

Cases: a null text counts as empty and has no chunks; a null id counts as larger than all others;
rows with equal ids and texts are one document, and rows with equal ids never cost each other
anything; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb
from .removal import NO_ID, tagged, without_spans

MASK_BITS = 5
MIN_CHUNK = 16
MAX_CHUNK = 1024
LEAST = 96
BLOCK = 16 << 20
_REACH = 64
#: One 64-bit value for each byte.
GEAR = tb.mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, begun anew with each text."""
    sizes = np.diff(offsets)
    n, gap = len(data), _REACH * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    spread = np.zeros(n + _REACH * (len(sizes) + 1), np.uint64)
    to = np.arange(n) + gap
    spread[to] = GEAR[data]
    span = 1
    while span < _REACH:
        spread[span:] += spread[:-span] << np.uint64(span)
        span *= 2
    return spread[to]


def chunk_ends(data: np.ndarray, offsets: np.ndarray, bits: int = MASK_BITS, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of each text, laid out over the block."""
    cuts = np.flatnonzero(gear_hashes(data, offsets) >> np.uint64(64 - bits) == 0) + 1
    bounds = np.searchsorted(cuts, offsets, "right").tolist()
    cuts = cuts.tolist()
    starts, ends = [], []
    for text, (at, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for cut in [*cuts[bounds[text] : bounds[text + 1]], stop]:
            while cut - at > most:
                starts.append(at)
                at += most
                ends.append(at)
            if cut - at >= least or cut == stop > at:
                starts.append(at)
                ends.append(cut)
                at = cut
    return np.array(starts, np.int64), np.array(ends, np.int64)


_NAMES = ["key", "tag", "start", "size", "d0", "d1"]


def _batch(columns: tuple[np.ndarray, ...], settled: bool) -> pa.RecordBatch:
    own = [pa.array(c) for c in columns]
    return pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(columns[0]), settled))], names=[*_NAMES, "settled"])


def _dealt(batches: Iterator[pa.RecordBatch], bits: int, least: int, most: int) -> Iterator[pa.RecordBatch]:
    """Chunks of (key, tag, text) rows; those that a smaller key of the same block, or the same text before, holds are settled."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        columns = tuple(np.concatenate(c) for c in zip(*held, strict=True))
        key, tag, start, _, d0, d1 = columns
        by = np.lexsort((start, tag, key, d1, d0))
        new = np.concatenate([[True], (d0[by][1:] != d0[by][:-1]) | (d1[by][1:] != d1[by][:-1])])
        new_text = new | np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (tag[by][1:] != tag[by][:-1])])
        holder, first = np.empty_like(key), np.empty_like(start)
        holder[by] = key[by][np.flatnonzero(new)[np.cumsum(new) - 1]]
        first[by] = start[by][np.flatnonzero(new_text)[np.cumsum(new_text) - 1]]
        settled = (key > holder) | (start > first)
        for late in (True, False):
            own = settled == late
            yield _batch(tuple(c[own] for c in columns), late)

    held, amount = [], 0
    for batch in batches:
        keys, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo, hi, data, offsets in tb.text_blocks(batch.column(2)):
            starts, ends = chunk_ends(data, offsets, bits, least, most)
            if len(starts):
                raw = data.tobytes()
                digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
                words = np.frombuffer(digests, "<i8").reshape(-1, 2)
                text = np.searchsorted(offsets, starts, "right") - 1
                held.append((keys[lo:hi][text], tags[lo:hi][text], (starts - offsets[text]).astype(np.int32), (ends - starts).astype(np.int32), words[:, 0].copy(), words[:, 1].copy()))
            amount += len(data)
            if amount >= BLOCK and held:
                yield from flush(held)
                held, amount = [], 0
    if held:
        yield from flush(held)


def _late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by digest, key, tag and start: all that a smaller key or an earlier place of their text holds, and what is settled."""
    last: tuple = (None, None, None, 0, 0, None, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, tag, start, _, d0, d1 = (batch.column(k).to_numpy() for k in range(6))
        settled = batch.column(6).to_numpy(zero_copy_only=False)
        # Settled rows have no digest to compare: they stand apart by their flag, after which the sort puts them.
        new = np.concatenate([[(d0[0], d1[0], settled[0]) != last[:3]], (d0[1:] != d0[:-1]) | (d1[1:] != d1[:-1]) | (settled[1:] != settled[:-1])])
        new_text = new | np.concatenate([[(key[0], tag[0]) != last[5:]], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])])
        holder = _firsts(key, new, last[3])
        first = _firsts(start, new_text, last[4])
        late = settled | (key > holder) | (start > first)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(late)) for k in range(4)], names=_NAMES[:4])
        last = (d0[-1], d1[-1], settled[-1], holder[-1], first[-1], key[-1], tag[-1])


def _firsts(values: np.ndarray, new: np.ndarray, before: int) -> np.ndarray:
    """The first value of the group of each row; `before` for rows whose group began in an earlier batch."""
    return np.concatenate([[before], values[new]]).astype(values.dtype)[np.cumsum(new)]


def known_chunks(docs: DataFrame, bits: int = MASK_BITS, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """(key, tag, start, size) of every chunk of `docs` (key, tag, text) that a row with a smaller key, or the same text at an earlier place, holds too."""
    rows = docs.select("key", "tag", "text").mapInArrow(lambda b: _dealt(b, bits, least, most), "key long, tag long, start int, size int, d0 long, d1 long, settled boolean")
    by = F.when(F.col("settled"), F.xxhash64("key")).otherwise(F.col("d0"))
    return rows.repartition(by).sortWithinPartitions("settled", "d0", "d1", "key", "tag", "start").mapInArrow(_late, "key long, tag long, start int, size int")


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MASK_BITS, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK, least: int = LEAST, keep_text: bool = False) -> DataFrame:
    """What is left of each row of `docs` without the runs of chunks that smaller ids, or earlier places of the text, hold."""
    docs = tagged(docs, id_col, text_col)
    late = known_chunks(docs.withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))), bits, min_chunk, max_chunk)
    return without_spans(docs, late, least, keep_text)

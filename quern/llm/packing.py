"""Best-fit packing by exact-complement hashing.

Texts become pieces of at most `capacity` tokens. Only the number of pieces of each length is
gathered: at most `capacity` counts, whatever the size of the corpus. On these counts the plan is
made: for the longest length left, the indexes of single, pair and triple sums are asked for
lengths that fill its gap exactly, and as many sequences as the counts allow are formed at once;
what has no exact complement is packed best-fit, longest first. Every piece then gets its place
from its rank among the pieces of its length, so no task sees more than a share of them.

Cases: a null text counts as empty and is one piece with the end token alone; null ids and repeated
rows are packed like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import written

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
RANK_GROUP = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache
def _encoders(vocabulary: str, ranks: str, pattern: str):
    """The vocabulary file's tokenizer, and the same vocabulary as ranks, which gives the same ids several times faster."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Tokenizer.from_file(vocabulary), tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def default_vocabulary() -> tuple[str, str, str]:
    """(vocabulary file, the same as ranks, split pattern) of the installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_ids(text: str, vocabulary: tuple[str, str, str]) -> np.ndarray:
    """Ids of a text as uint32; a special token in the text is recognised, as the vocabulary file says."""
    slow, fast = _encoders(*vocabulary)
    if SPECIAL in text:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def _pieces(doc_id, ids: np.ndarray, capacity: int) -> Iterator[tuple]:
    count = -(-len(ids) // capacity)
    raw = ids.astype("<u4").tobytes()
    start = 0
    for piece in range(count):
        end = len(ids) - capacity * (count - 1 - piece)
        yield doc_id, piece, start, end - start, zlib.crc32(raw[4 * start : 4 * end])
        start = end


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: tuple[str, str, str]) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's tokens and the end token, cut where longer than `capacity`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            found = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (raw.as_py() or b"").decode("utf-8", "replace")
                found += _pieces(doc_id, np.append(token_ids(text, vocabulary), np.uint32(END_ID)), capacity)
            columns = list(zip(*found, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("binary")).mapInArrow(rows, PIECES)


class Pattern(NamedTuple):
    """`times` sequences that each hold pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    times: int


class _Sums:
    """Which lengths are left, and which sums one, two or three of them can make."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.counts[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        left = self.counts > 0
        longer = np.arange(gap - 1, (gap - 1) // 2, -1)
        fits = longer[left[longer] & left[gap - longer]] if len(longer) else longer
        for a in fits.tolist():
            if 2 * a != gap or self.counts[a] > 1:
                return a, gap - a
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        lengths = np.flatnonzero(self.counts[:gap])
        for a in lengths[::-1].tolist():
            if 3 * a < gap:
                break
            self.counts[a] -= 1
            found = self.pair(gap - a)
            self.counts[a] += 1
            if found and found[0] <= a:
                return (a, *found)
        return None


def _exact(counts: np.ndarray, capacity: int) -> Iterator[Pattern]:
    sums = _Sums(counts)
    for length in range(capacity, 0, -1):
        while counts[length]:
            counts[length] -= 1
            gap = capacity - length
            found = () if not gap else sums.single(gap) or sums.pair(gap) or sums.triple(gap)
            counts[length] += 1
            if found is None:
                break
            lengths, need = np.unique((length, *found), return_counts=True)
            times = int((counts[lengths] // need).min())
            counts[lengths] -= need * times
            yield Pattern((length, *found), times)


def _best_fit(counts: np.ndarray, capacity: int) -> Iterator[Pattern]:
    """Longest first, each into the fullest open sequences that have room; equal sequences are kept as one."""
    bins: dict[int, list[Pattern]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            gap = min((g for g, held in bins.items() if g >= length and held), default=None)
            if gap is None:
                each = capacity // length
                if full := left // each:
                    bins[capacity - each * length].append(Pattern((length,) * each, full))
                if rest := left % each:
                    bins[capacity - rest * length].append(Pattern((length,) * rest, 1))
                break
            held = bins[gap].pop()
            times = min(left, held.times)
            if times < held.times:
                bins[gap].append(Pattern(held.lengths, held.times - times))
            bins[gap - length].append(Pattern((*held.lengths, length), times))
            left -= times
        counts[length] = 0
    for held in bins.values():
        yield from held


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up counts[length] pieces of each length."""
    counts = counts.copy()
    return [*_exact(counts, capacity), *_best_fit(counts, capacity)]


class Places:
    """For each length, which ranks go to which sequences and offsets."""

    def __init__(self, patterns: list[Pattern]):
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        sequence = 0
        for lengths, times in patterns:
            at = 0
            for length in lengths:
                rows[length].append((used[length], sequence, at))
                used[length] += times
                at += length
            sequence += times
        self.by_length = {length: np.array(x, np.int64).T for length, x in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for one in np.unique(length).tolist():
            at = np.flatnonzero(length == one)
            first, base, place = self.by_length[one]
            k = np.searchsorted(first, rank[at], "right") - 1
            sequence[at], offset[at] = base[k] + rank[at] - first[k], place[k]
        return sequence, offset


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: tuple[str, str, str] | None = None) -> DataFrame:
    """A row for each piece, with its sequence and its offset there."""
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, capacity, vocabulary or default_vocabulary()), "pieces")
    total = cut.count()
    groups = 1 + total // RANK_GROUP
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = cut.groupBy("length", "salt").count()
    counts = np.zeros(capacity + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect():  # `capacity` rows at most
        counts[row["length"]] = row["n"]
    places = spark.sparkContext.broadcast(Places(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(inside) - 1).join(firsts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.of(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(rows, f"{PIECES}, sequence_id long, offset long")

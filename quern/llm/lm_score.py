"""Language-model scoring with a log-frequency Bloom filter of quantised bigram counts.

1. Texts are encoded once: per group of texts a dictionary of token hashes and the tokens as places
   in it, a few bits each, in a written table.
2. The tokens and bigrams of the training texts are counted per group, dealt by hash into shards and
   added up. A shard keeps exact token counts, and a Bloom filter of its bigrams: a bigram with
   count c is entered under each level 1 .. 1 + floor(log2 c).
3. The filters are broadcast, while their size, which is checked, is at most `max_filter_bytes`;
   probing a bigram level by level until one is missing gives its quantised count. Beyond that
   size each group asks the shards for its distinct bigrams, as it does for its tokens in any case,
   and the same filters are probed where they lie. Both ways give the same scores.

score is the log10 probability of a text under P(w | u) = (k(u, w) + mu * p(w)) / (c(u) + mu): k is
the quantised count of the pair, at most c(u); p is the smoothed unigram probability of the base
score; the first token follows a mark that each training text begins with. As k is the middle of a
level and not the count, and a filter has some false positives, the probabilities after a token sum
to one only approximately; scores of one corpus compare with one another.

Cases: a null text counts as empty and is one end token; a null id is hashed as an empty string,
which holds it out; repeated rows are scored and counted each; with no training texts all
counts are 0; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import textbytes as tb
from .store import written

GROUP_BYTES = 4 << 20
COUNT_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
MAX_FILTER_BYTES = 64 << 20
HELD_OUT_OF = 10
MU = 50.0
PROBES = 5
BITS_PER_ENTRY = 7.2
#: Tokens that no text has.
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Byte planes of each array, compressed; lengths and types are part of it."""
    parts = []
    for a in arrays:
        parts.append(np.array([len(a), a.dtype.itemsize], "<i8").tobytes())
        parts.append(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _spread(raw: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    for kind in kinds:
        n, width = np.frombuffer(raw, "<i8", 2, at).tolist()
        out.append(np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T.copy().view(kind).ravel())
        at += 16 + n * width
    return out


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % HELD_OUT_OF == 0 for i in ids], bool)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block, the end of each text among them, and the offsets of the texts in it."""
    lowered = tb.LOWER[data]
    starts, ends, first = tb.word_spans(~tb.SPACE[lowered], offsets)
    words = tb.text_hash(lowered, starts, ends)
    n = len(offsets) - 1
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))] = words
    return out, first + np.arange(n + 1)


def pair_hashes(tokens: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the start mark before the first of each text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[firsts] = START
    return tb.mix(before * np.uint64(tb._BASE) + tokens)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0

    def group(held) -> pa.RecordBatch:
        nonlocal number
        number += 1
        ids, known, tokens, offsets = (np.concatenate(x) for x in zip(*held, strict=True))
        words, places = np.unique(tokens, return_inverse=True)
        blob = _squeezed(ids, known.view(np.uint8), np.diff(offsets, append=len(tokens)).astype("<i8"), places.astype("<u4"))
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([blob], pa.binary()), pa.array([_squeezed(words)], pa.binary())], names=["part", "texts", "words"])

    held, amount, count = [], 0, 0
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in tb.text_blocks(batch.column(1)):
            tokens, first = _tokens(data, offsets)
            own = ids.slice(lo, hi - lo)
            held.append((own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False), tokens, first[:-1] + count))
            amount, count = amount + len(data), count + len(tokens)
            if amount >= GROUP_BYTES:
                yield group(held)
                held, amount, count = [], 0, 0
    if held:
        yield group(held)


class _Group(NamedTuple):
    ids: np.ndarray
    known_id: np.ndarray
    firsts: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    places: np.ndarray
    held: np.ndarray


def _group(texts: bytes, words: bytes) -> _Group:
    ids, known, sizes, places = _spread(texts, "<i8", "u1", "<i8", "<u4")
    known = known.astype(bool)
    held = held_out([i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)])
    return _Group(ids, known, np.cumsum(sizes) - sizes, sizes, _spread(words, "<u8")[0], places, held)


def _dealt(keys: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    shard = (keys % np.uint64(shards)).astype(np.int64)
    by = np.lexsort((keys, shard))
    edges = np.flatnonzero(np.diff(shard[by], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = by[a:b]
        yield int(shard[own[0]]), keys[own], counts[own]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    by = np.argsort(keys)
    new = np.flatnonzero(np.diff(keys[by], prepend=~keys[by][:1]))
    return keys[by][new], np.add.reduceat(counts[by], new)


def _counted(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Blocks (shard, kind, keys with counts) of the training texts; kind 0: tokens, 1: bigrams."""

    def flush(held) -> Iterator[pa.RecordBatch]:
        for kind in (0, 1):
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*(h[kind] for h in held), strict=True)))
            rows = [(k, kind, _squeezed(a, b.astype("<u4"))) for k, a, b in _dealt(keys, counts, shards)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["shard", "kind", "block"])

    held, amount = [], 0
    for batch in batches:
        for texts, words in zip(batch.column(0), batch.column(1), strict=True):
            g = _group(texts.as_py(), words.as_py())
            keep = np.repeat(~g.held, g.sizes)
            tokens = g.words[g.places]
            pairs = pair_hashes(tokens, g.firsts)[keep]
            counts = np.bincount(g.places[keep], minlength=len(g.words))
            some = np.flatnonzero(counts)
            held.append(((g.words[some], counts[some]), _summed(pairs, np.ones(len(pairs), np.int64))))
            amount += GROUP_BYTES
            if amount >= COUNT_BYTES:
                yield from flush(held)
                held, amount = [], 0
    if held:
        yield from flush(held)


class Filter:
    """A log-frequency Bloom filter of the keys of one shard."""

    def __init__(self, bits: np.ndarray, n_bits: int):
        self.bits, self.n_bits = bits, n_bits

    @staticmethod
    def places(keys: np.ndarray, level: int, n_bits: int) -> Iterator[np.ndarray]:
        one = tb.mix(keys + np.uint64(level * 0xA0761D6478BD642F % (1 << 64)))
        two = tb.mix(one ^ np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)
        for k in range(PROBES):
            yield (one + np.uint64(k) * two) % np.uint64(n_bits)

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Filter:
        levels = np.frexp(counts.astype(float))[1]  # 1 + floor(log2 c)
        n_bits = int(levels.sum() * BITS_PER_ENTRY) // 8 * 8 + 8
        flags = np.zeros(n_bits, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for at in cls.places(keys[levels >= level], level, n_bits):
                flags[at] = True
        return cls(np.packbits(flags), n_bits)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts: the middle of the last level whose probes all hit."""
        out = np.zeros(len(keys))
        at, level = np.arange(len(keys)), 0
        while len(at):
            level += 1
            hit = np.ones(len(at), bool)
            for place in self.places(keys[at], level, self.n_bits):
                hit &= (self.bits[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
            at = at[hit]
            out[at] = (3 * 2.0 ** (level - 1) - 1) / 2
        return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shard: its token counts, its filter, and sums; rows come sorted by shard."""

    def done(shard: int, held: dict[int, list]) -> pa.RecordBatch:
        tokens, pairs = (_summed(*(np.concatenate(x) for x in zip(*held[k], strict=True))) if held[k] else (np.zeros(0, "<u8"), np.zeros(0, "<i8")) for k in (0, 1))
        own = Filter.of(*pairs)
        columns = [shard, _squeezed(tokens[0], tokens[1].astype("<i8")), own.bits.tobytes(), own.n_bits, len(tokens[0]), int(tokens[1].sum())]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "tokens", "bits", "n_bits", "v", "n"])

    now, held = -1, {0: [], 1: []}
    for batch in batches:
        for shard, kind, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if shard != now and now >= 0:
                yield done(now, held)
                held = {0: [], 1: []}
            now = shard
            keys, counts = _spread(block.as_py(), "<u8", "<u4")
            held[kind].append((keys, counts.astype(np.int64)))
    if now >= 0:
        yield done(now, held)


class Filters:
    """The filters of all shards; which one a key belongs to follows from the key."""

    def __init__(self, rows: list, shards: int):
        self.shards = shards
        self.by_shard = {r["shard"]: Filter(np.frombuffer(r["bits"], np.uint8), r["n_bits"]) for r in rows}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        shard = (keys % np.uint64(self.shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[by], np.arange(self.shards + 1))
        for k, own in self.by_shard.items():
            at = by[edges[k] : edges[k + 1]]
            out[at] = own.counts(keys[at])
        return out


def _asked(batches: Iterator[pa.RecordBatch], shards: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    """(shard, part, kind, keys): what each group asks of each shard."""
    for batch in batches:
        for part, texts, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            g = _group(texts.as_py(), words.as_py())
            wanted = [(0, g.words)] + [(1, np.unique(pair_hashes(g.words[g.places], g.firsts)))] * pairs
            rows = [(k, part, kind, _squeezed(keys)) for kind, all_keys in wanted for k, keys, _ in _dealt(all_keys, all_keys, shards)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["shard", "part", "kind", "keys"])


def _answered(asked: pa.Table, known: pa.Table) -> pa.Table:
    """What one shard says to all questions it gets; a shard without training texts answers 0."""
    tokens = _spread(known["tokens"][0].as_py(), "<u8", "<i8") if len(known) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    bits = known["bits"][0].as_py() if len(known) else None
    out = []
    for kind, keys in zip(asked["kind"].to_pylist(), asked["keys"], strict=True):
        wanted = _spread(keys.as_py(), "<u8")[0]
        found = np.zeros(len(wanted))
        if kind == 0 and len(tokens[0]):
            at = np.minimum(np.searchsorted(tokens[0], wanted), len(tokens[0]) - 1)
            found = np.where(tokens[0][at] == wanted, tokens[1][at], 0).astype(float)
        elif kind == 1 and bits is not None:
            found = Filter(np.frombuffer(bits, np.uint8), known["n_bits"][0].as_py()).counts(wanted)
        out.append(_squeezed(found))
    return pa.table({"part": asked["part"], "kind": asked["kind"], "keys": asked["keys"], "counts": pa.array(out, pa.binary())})


def _table(answers: list, kind: int) -> tuple[np.ndarray, np.ndarray]:
    own = [(_spread(a["keys"], "<u8")[0], _spread(a["counts"], "<f8")[0]) for a in answers if a["kind"] == kind]
    keys, counts = (np.concatenate(x) for x in zip(*own, strict=True)) if own else (np.zeros(0, np.uint64), np.zeros(0))
    by = np.argsort(keys)
    return keys[by], counts[by]


def _scored(batches: Iterator[pa.RecordBatch], filters, n: int, v: int, n_texts: int, mu: float) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for batch in batches:
        for texts, words, answers in zip(*(batch.column(k) for k in range(3)), strict=True):
            g = _group(texts.as_py(), words.as_py())
            if not len(g.ids):
                continue
            answers = answers.as_py()
            count = _table(answers, 0)[1]  # keys are the group's words, in order
            c = count[g.places]
            p = (c + 0.1) / (n + 0.1 * (v + 1))
            tokens = g.words[g.places]
            pairs = pair_hashes(tokens, g.firsts)
            if filters is not None:
                distinct, where = np.unique(pairs, return_inverse=True)
                k = filters.value.counts(distinct)[where]
            else:
                keys, counts = _table(answers, 1)
                k = counts[np.searchsorted(keys, pairs)]
            before = np.empty(len(c))
            before[1:] = c[:-1]
            before[g.firsts] = n_texts
            conditional = (np.minimum(k, before) + mu * p) / (before + mu)
            total = lambda x: np.add.reduceat(x, g.firsts)
            columns = [pa.array(g.ids, mask=~g.known_id), pa.array(g.held), pa.array(g.sizes), pa.array(total((c > 0).astype(np.int64))), pa.array(np.full(len(g.ids), n)), pa.array(total(np.log10(p))), pa.array(total(np.log10(conditional)))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Base and model log10 probability of each row of `docs`, learned from the rows that are not held out."""
    spark = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    amount = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + amount // SHARD_BYTES
    groups = written(docs.mapInArrow(_encoded, "part long, texts binary, words binary"), "encoded")
    blocks = groups.select("texts", "words").mapInArrow(lambda b: _counted(b, shards), "shard int, kind int, block binary")
    kept = written(blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards, "shard int, tokens binary, bits binary, n_bits long, v long, n long"), "shards")
    sums = kept.agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum(F.length("bits")).alias("size")).first()
    n, v, size = sums["n"] or 0, sums["v"] or 0, sums["size"] or 0
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    n_texts = docs.where(crc % HELD_OUT_OF != 0).count()
    filters = None
    if size <= max_filter_bytes:
        filters = spark.sparkContext.broadcast(Filters(kept.select("shard", "bits", "n_bits").collect(), shards))
    asked = groups.mapInArrow(lambda b: _asked(b, shards, filters is None), "shard int, part long, kind int, keys binary")
    bits = F.col("bits") if filters is None else F.lit(None).cast("binary")
    known = kept.select("shard", "tokens", bits.alias("bits"), "n_bits")
    answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_answered, "part long, kind int, keys binary, counts binary")
    answers = answers.groupBy("part").agg(F.collect_list(F.struct("kind", "keys", "counts")).alias("answers"))
    joined = groups.join(answers, "part").select("texts", "words", "answers")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.mapInArrow(lambda b: _scored(b, filters, n, v, n_texts, mu), schema)

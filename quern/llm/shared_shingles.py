"""Links between texts that share most of their five-word shingles: quick ones by a signature, then all others by prefixes.

A signature has 96 positional bytes, each cut from the least value of a permutation over the distinct
shingles of a text, so two texts agree in a byte about as often as they share shingles. The index
holds the sixteen groups of six positions. Each entry of a posting is paired with the posting's
ends, its least and its greatest entry in two orders; the shared positional bytes of a pair are
tallied, pairs that reach the minimum are kept, and their shingles are compared.

This joins most groups at little cost but may miss a link, so remaining_links() finds every link
between texts that are not joined yet. All texts order their shingles alike, rare ones first: those that a
sample shows as frequent come last, the others by how common their words are, for texts that are not alike
share shingles of common words by chance, the more the more texts there are. Of two
sets that share `least` of their union, the first n - ceil(least * n) + 1 shingles of each have one
in common, so the postings of these prefixes lose nothing. Postings of one group alone go; in the
others all pairs of different groups are held against two bounds that no link fails, sizes and
the parity bits of the sets, and what is left is compared shingle by shingle. A long posting is dealt
over tasks by pairs of its parts, and what is dealt, then what is compared, goes in rounds, each of a part of the index' size.
How often a shingle or word occurs is counted in a bounded sample of the rows;
it decides the order, so how long postings are, never what is found.

Texts of one signature and one fingerprint, or of one set of shingles, are one entry, so copies of any number are one. A text's
shingles travel once for each text that it is compared with; the comparisons with one
text are dealt over tasks by a number that follows from how many there are.

Cases: a text without words has no signature and no links here; one of fewer than five words is one
shingle. Shingles are told apart by 64 bits of their hash, when two texts are compared by 32.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from . import textbytes as tb
from .removal import squeezed
from .store import dropped, written

WORDS = 5
SIMILARITY = 0.8
POSITIONS = 96
GROUP = 6
#: Comparisons with one text that a task takes.
PART = 2000
#: Rows of which the frequencies of shingles and words are counted, how often one occurs there to be called frequent, and how many of each are told.
SAMPLE, FREQUENT, TOLD = 20_000, 3, 200_000
#: Parity bits of a set.
PARITY = 1024
#: Texts whose parity bits are counted at once.
_COUNTED = 2048
#: Bits of a word's hash that name its place in the table of levels; levels of a shingle's words add up to less than _LEVELS.
_PLACE, _LEVELS = 21, 1 << 10
#: Entries of the index for each row that a round of comparisons sends, and rows that any round may send.
SHARE, ROUND = 8, 1 << 20
#: Bytes of shingles for each entry of the index that a round of exact comparisons sends, and bytes that any round may send.
SENT_SHARE, SENT_ROUND = 32, 1 << 28
#: Texts of which more are read by an exchange of all texts.
FEW = 50_000
_U64 = np.uint64
_XOR = tb.mix(np.arange(1, POSITIONS + 1, dtype=_U64) * _U64(0xD1B54A32D192ED03))
_FACTOR = tb.mix(_XOR) | _U64(1)


def word_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return tb.text_hash(np.frombuffer(joined, np.uint8), starts, ends)


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's shingles begin, the end of all last; and of each shingle the first word, and the end of its text's words."""
    n_words = np.diff(first)
    size = np.where(n_words > 0, np.maximum(n_words - WORDS + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(size)])
    text = np.repeat(np.arange(len(size)), size)
    return begin, first[text] + np.arange(begin[-1]) - begin[text], first[text + 1]


def shingles(joined: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, and where each text's begin, the end of all last."""
    return word_shingles(word_hashes(joined, starts, ends), first)


def word_shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """shingles() from the hashes of the words."""
    begin, at, end = _windows(first)
    out = np.zeros(begin[-1], _U64)
    for k in range(WORDS if len(words) else 0):
        out = tb.mix(out + np.where(at + k < end, words[np.minimum(at + k, len(words) - 1)], _U64(0)) + _U64(k + 1))
    return out, begin


def commonness(words: np.ndarray, first: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Of each of word_shingles(), how common its words are together: the sum of their levels."""
    sums = np.concatenate([[0], np.cumsum(levels[words >> _U64(64 - _PLACE)], dtype=np.int64)])
    _, at, end = _windows(first)
    return sums[np.minimum(at + WORDS, end)] - sums[at]


def signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The positional bytes of each text, a row each; zeros where a text has no shingles."""
    out = np.zeros((len(begin) - 1, POSITIONS), np.uint8)
    some = np.flatnonzero(np.diff(begin))
    if len(some):
        for k in range(POSITIONS):
            least = np.minimum.reduceat((hashes ^ _XOR[k]) * _FACTOR[k], begin[some])
            out[some, k] = tb.mix(least).astype(np.uint8)
    return out


def _distinct(hashes: np.ndarray, begin: np.ndarray, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ordered by level and hash, and the text of each."""
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    by = np.lexsort((hashes, text) if level is None else (hashes, level, text))
    hashes, text = hashes[by], text[by]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def word_levels(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A table by the first bits of a word's hash: about log2 of how often it occurs, 0 where it is rare."""
    levels = np.zeros(1 << _PLACE, np.uint8)
    np.maximum.at(levels, words >> _U64(64 - _PLACE), np.log2(times).astype(np.uint8) + 1)
    return levels


def frequencies(texts: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of frequent shingles, ascending, with how often each occurs, and word_levels(), in a sample of `texts` (key, tag, text)."""
    key, tag, text_col = texts.columns
    sample = texts.where(F.pmod(F.xxhash64(key, tag), F.lit(1 + texts.count() // SAMPLE)) == 0).select(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tb.text_blocks(batch.column(0), tb.SMALL_BLOCK_BYTES):
                *normal, first = tb.normal_words(data, offsets)
                words = word_hashes(*normal)
                for is_word, all_of in ((True, words), (False, _distinct(*word_shingles(words, first))[0])):
                    found, times = np.unique(all_of, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), is_word)), pa.array(found.view(np.int64)), pa.array(times)], names=["is_word", "h", "n"])

    counts = sample.mapInArrow(rows, "is_word boolean, h long, n long").groupBy("is_word", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    counts = written(counts, "frequencies")

    def told(which: Column) -> tuple[np.ndarray, np.ndarray]:
        most = counts.where(which).orderBy(F.desc("n"), "h").limit(TOLD).toArrow()
        hashes, times = most.column("h").to_numpy().view(np.uint64), most.column("n").to_numpy()
        by = np.argsort(hashes)
        return hashes[by], times[by]

    out = told(~F.col("is_word")), word_levels(*told(F.col("is_word")))
    dropped(counts)
    return out


def prefix_size(size: np.ndarray, least: float) -> np.ndarray:
    """How many of the first shingles of a set have one in common with those of any set that shares `least` with it."""
    return size - np.ceil(least * size - 1e-9).astype(np.int64) + 1


def set_prints(hashes: np.ndarray, begin: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: float, common: np.ndarray | None = None) -> list[pa.Array]:
    """Of each text's set of shingles: a hash of all, their number, parity bits, and the prefix; `common` has commonness() of each shingle."""
    n = len(begin) - 1
    level = np.zeros(len(hashes), np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], hashes), len(frequent[0]) - 1)
        level = np.where(frequent[0][at] == hashes, frequent[1][at], 0)
    if common is not None:
        level = level * _LEVELS + common
    own, text = _distinct(hashes, begin, level)
    first = np.searchsorted(text, np.arange(n + 1))
    size = np.diff(first)
    node = np.zeros(n, np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        node[some] = tb.mix(np.add.reduceat(tb.mix(own + _U64(1)), first[some]) + size[some].astype(np.uint64))
    bits = []
    for a in range(0, n, _COUNTED):
        b = min(a + _COUNTED, n)
        part = slice(first[a], first[b])
        odd = np.bincount((text[part] - a) * PARITY + (own[part] % _U64(PARITY)).astype(np.int64), minlength=(b - a) * PARITY) & 1
        bits += [x.tobytes() for x in np.packbits(odd.astype(np.uint8).reshape(b - a, PARITY), axis=1)]
    head = np.where(size > 0, prefix_size(size, least), 0)
    edge = np.concatenate([[0], np.cumsum(head)])
    taken = own[np.repeat(first[:-1] - edge[:-1], head) + np.arange(edge[-1])]
    prefix = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(taken.view(np.int64)))
    return [pa.array(node.view(np.int64)), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), prefix]


def tally_minimum(least: float) -> int:
    """Shared positional bytes that a pair of similarity `least` reaches but for three standard deviations."""
    return math.floor(POSITIONS * least - 3 * math.sqrt(POSITIONS * least * (1 - least)))


def _tallied(batches: Iterator[pa.RecordBatch], minimum: int) -> Iterator[pa.RecordBatch]:
    """Pairs (node, centre, own signature, the centre's) that share enough positional bytes."""
    for batch in batches:
        if batch.num_rows:
            one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, POSITIONS) for k in (2, 3))
            enough = pa.array((one == other).sum(axis=1) >= minimum)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(enough), batch.column(1).filter(enough)], names=["node", "centre"])


def candidates(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (node, centre) of `nodes` (node, sig) that meet in a posting and share enough positional bytes."""
    keys = (F.xxhash64(F.substring("sig", 1 + k, GROUP), F.lit(k)) for k in range(0, POSITIONS, GROUP))
    index = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    other = F.struct(F.xxhash64("node").alias("h"), "node")
    ends = index.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min(other)["node"].alias("c"), F.max(other)["node"].alias("d")).where("a <> b")
    met = index.join(ends, "key").select("node", F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("centre")).where("node <> centre").distinct()
    own = nodes.select("node", "sig")
    met = met.join(own, "node").join(own.select(F.col("node").alias("centre"), F.col("sig").alias("centre_sig")), "centre")
    minimum = tally_minimum(least)
    return met.select("node", "centre", "sig", "centre_sig").mapInArrow(lambda batches: _tallied(batches, minimum), "node long, centre long")


_SENT = "centre long, part int, is_member boolean, fp long, shingles binary"
_SENT_BYTES = 8 << 20
#: Rows of one root of a posting that wait for another root.
_HELD = 1 << 20


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingles of each text, to each text that it is compared with and to the parts of its own."""
    out, size = [], 0
    for batch in batches:
        squeeze = zstandard.ZstdDecompressor()
        node, fp, own, centres = (batch.column(k).to_pylist() for k in range(1, 5))
        for row, text in enumerate(batch.column(0)):
            data = np.frombuffer(squeeze.decompress(text.as_py()), np.uint8)
            hashes, _ = shingles(*tb.normal_words(data, np.array([0, len(data)])))
            packed = np.unique(hashes.astype(np.uint32)).tobytes()
            to = [(node[row], part, False) for part in range(own[row] or 0)] + [(c["centre"], c["part"], True) for c in centres[row] or ()]
            for centre, part, is_member in to:
                out.append((centre, part, is_member, fp[row], packed))
                size += len(packed)
                if size > _SENT_BYTES:
                    yield _batch_of(out)
                    out, size = [], 0
    if out:
        yield _batch_of(out)


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["centre", "part", "is_member", "fp", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between fingerprints; rows come sorted, a centre before what is compared with it."""
    held, held_fp = np.zeros(0, np.uint32), None
    for batch in batches:
        a, b = [], []
        is_member, fp = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for row, packed in enumerate(batch.column(4)):
            own = np.frombuffer(packed.as_buffer(), np.uint32)
            if not is_member[row]:
                held, held_fp = own.copy(), fp[row]
            elif fp[row] != held_fp and len(own) and min(len(own), len(held)) >= least * max(len(own), len(held)):
                shared = int((held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own).sum())
                if shared >= least * (len(own) + len(held) - shared):
                    a.append(fp[row])
                    b.append(held_fp)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compared(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, text_col: str, least: float) -> DataFrame:
    """Links (a, b) between the fingerprints of those `pairs` (node, centre) that share `least`; `nodes` has node, fp and the row whose text it is."""
    parts = pairs.groupBy(F.col("centre").alias("node")).agg(F.ceil(F.count("*") / PART).cast("int").alias("own"))
    place = F.pmod(F.xxhash64("node"), F.col("own")).cast("int").alias("part")
    members = pairs.join(parts.withColumnRenamed("node", "centre"), "centre").groupBy("node").agg(F.collect_list(F.struct("centre", place)).alias("centres"))
    asked = parts.join(members, "node", "full").join(nodes.select("node", "fp", "_q_key", "_q_tag"), "node")
    texts = docs.select("_q_key", "_q_tag", text_col)
    rows = pairs.select("node").union(pairs.select("centre")).distinct().join(nodes.select("node", "_q_key", "_q_tag"), "node").select("_q_key", "_q_tag")
    if rows.limit(FEW + 1).count() <= FEW:
        texts = texts.join(F.broadcast(rows), ["_q_key", "_q_tag"], "left_semi")
    found = squeezed(texts, text_col).join(asked.hint("shuffle_merge"), ["_q_key", "_q_tag"]).select(text_col, "node", "fp", "own", "centres").mapInArrow(_sent, _SENT)
    # A centre comes before its members: false sorts before true.
    found = found.repartition("centre", "part").sortWithinPartitions("centre", "part", "is_member").mapInArrow(lambda batches: _similar(batches, least), "a long, b long")
    return written(found, "shingle-links")


def shingle_links(docs: DataFrame, marked: DataFrame, text_col: str, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between fingerprints of texts that share `least` of their shingles; most of them, see remaining_links().

    `marked` has (_q_key, _q_tag, fp, sig) for each row of `docs`, which has _q_key and _q_tag too.
    """
    first = F.min(F.struct("_q_key", "_q_tag")).alias("first")
    nodes = written(marked.where("sig IS NOT NULL").groupBy("fp", "sig").agg(first).select(F.xxhash64("fp", "sig").alias("node"), "fp", "sig", "first.*"), "signatures")
    pairs = written(candidates(nodes, least), "candidates")
    links = _compared(docs, nodes, pairs, text_col, least)
    dropped(pairs)
    dropped(nodes)
    return links


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of the postings that have several roots; rows come sorted by key and root.

    A very long posting passes before its second root is seen, so what waits is bounded; one that has
    a single root finds no pair later.
    """
    held, passed = None, None
    for batch in batches:
        batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        key, root = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        several = root[edge[:-1]] != root[edge[1:] - 1]
        several[0] |= key[0] == passed
        last = edge[-2]
        if last > 0 or len(key) < _HELD:
            # The last posting may go on.
            several[-1], held = False, batch.slice(last)
            passed = key[-1] if key[-1] == passed else None
        else:
            several[-1], held, passed = True, None, key[-1]
        yield batch.filter(pa.array(np.repeat(several, np.diff(edge)))).select([0, 1])
    if held is not None and (held.column(0)[0].as_py() == passed or held.column(2)[0] != held.column(2)[held.num_rows - 1]):
        yield held.select([0, 1])


def _unlike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of different roots that sizes and parity bits leave; rows (key, x, y, own, node, root, size, bits) come sorted by group (key, x, y)."""

    def pairs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        key, x, y, own, node, root, size = (table.column(k).to_numpy() for k in range(7))
        bits = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint64).reshape(-1, PARITY // 64)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        group = np.cumsum(new)
        a = np.arange(len(group))
        for gap in range(1, len(group)):
            a = a[a < len(group) - gap]
            a = a[group[a + gap] == group[a]]
            if not len(a):
                return
            b = a + gap
            fits = (root[a] != root[b]) & ((x[a] == y[a]) | (own[a] != own[b])) & (np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b]) - 1e-9)
            one, other = a[fits], b[fits]
            apart = np.bitwise_count(bits[one] ^ bits[other]).sum(axis=1, dtype=np.int64)
            near = apart <= (1 - least) / (1 + least) * (size[one] + size[other].astype(np.int64)) + 1e-9
            one, other = node[one[near]], node[other[near]]
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, other)), pa.array(np.minimum(one, other))], names=["node", "centre"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = [batch.column(k).to_numpy() for k in range(3)]
        same = np.logical_and.reduce([g == g[-1] for g in group])
        cut = int(np.argmax(same))
        if held and (cut or any(held[-1].column(k)[0] != batch.column(k)[0] for k in range(3))):
            done, held = [*held, batch.slice(0, cut)], []
            yield from pairs(done)
        elif cut:
            yield from pairs([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield from pairs(held)


def _unlike_pairs(met: DataFrame, named: DataFrame, least: float, most: int) -> list[DataFrame]:
    """Written pairs (node, centre) of the postings `met` (key, node) that sizes and parity bits leave; a pair may be in several tables.

    A posting is dealt over tasks by pairs of its parts, and all that is dealt goes in rounds of about
    `most` rows, as rows with their bits are many times as wide as the index.
    """
    long = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    long = written(long.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")), "long-sets")
    n_rows = met.count() + (long.agg(F.sum(F.col("n") * (F.col("parts") - 1))).first()[0] or 0)
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = met.join(long.select("key", "parts"), "key", "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("node", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    rounds, found = max(1, math.ceil(n_rows / most)), []
    for k in range(rounds):
        part = dealt.where(F.pmod(F.xxhash64("key", "x", "y"), F.lit(rounds)) == k) if rounds > 1 else dealt
        part = part.join(named.select("node", "root", "size", "bits"), "node").select("key", "x", "y", "own", "node", "root", "size", "bits")
        part = part.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        found.append(written(part.mapInArrow(lambda batches: _unlike(batches, least), "node long, centre long").distinct(), "unlike"))
    dropped(long)
    return found


def _compared_in_rounds(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, text_col: str, least: float, most: int) -> list[DataFrame]:
    """_compared() of all `pairs`, in rounds that send about `most` bytes of shingles each: parity bits tell little of large sets, so these make many pairs."""
    sent = pairs.select("node").union(pairs.select("centre").distinct()).join(nodes.select("node", "size"), "node").agg(F.sum("size")).first()[0]
    rounds = max(1, math.ceil(4 * (sent or 0) / most))
    parts = [pairs.where(F.pmod(F.xxhash64("node", "centre"), F.lit(rounds)) == k) for k in range(rounds)] if rounds > 1 else [pairs]
    return [_compared(docs, nodes, part, text_col, least) for part in parts]


def remaining_links(docs: DataFrame, marked: DataFrame, roots: DataFrame, text_col: str, least: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between fingerprints: with those behind `roots` (node, root) they join all texts that share `least` of their shingles.

    `marked` has (_q_key, _q_tag, fp, node, size, bits, prefix) for each row of `docs`, which has _q_key and _q_tag too.
    Its files go once its sets are written, each once.
    """
    sets = marked.where("size > 0")
    once = sets.select("node", "fp", "_q_key", "_q_tag", "size", "bits", "prefix").dropDuplicates(["node"])
    named = once.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = written(named, "sets")
    equal = sets.select("node", F.col("fp").alias("a")).distinct().join(nodes.select("node", F.col("fp").alias("b")), "node").where("a <> b").select("a", "b")
    equal = written(equal, "equal-sets")
    dropped(marked)
    index = nodes.select(F.explode("prefix").alias("key"), "node", "root")
    met = written(index.repartition("key").sortWithinPartitions("key", "root").mapInArrow(_several, "key long, node long"), "met")
    size, n_sets = nodes.agg(F.sum("size"), F.count("*")).first()
    entries = (1 - least) * (size or 0) + n_sets
    rounds = _unlike_pairs(met, nodes, least, max(ROUND, int(entries / SHARE)))
    dropped(met)
    pairs = rounds[0]
    if len(rounds) > 1:
        pairs = written(reduce(DataFrame.union, rounds).distinct(), "unlike")
    links = _compared_in_rounds(docs, nodes, pairs, text_col, least, max(SENT_ROUND, int(entries * SENT_SHARE)))
    out = written(reduce(DataFrame.union, links, equal), "remaining-links")
    for table in (*rounds, pairs, nodes, equal, *links):
        dropped(table)
    return out

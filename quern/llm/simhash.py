"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in at most three bits share at least five of the
eight (position, byte) postings, and so at least three in its first or its last four bytes. The
index therefore holds, for each half, the four triples of positions: eight postings a fingerprint
instead of eight lists as long as a 256th of the corpus. Within a posting the shared positional
bytes of a pair are tallied, pairs with five or more are kept, and their bits are compared.

A long posting is dealt again by further bytes, then by half bytes, so none is compared pair by pair.

Equal fingerprints are merged before anything else, so a group of copies of any size is one entry.
Within a posting only the links of a spanning forest leave the task, never all pairs.

Cases: a null text counts as empty; texts with no words have the fingerprint zero; a null id stays
null, never names a component, and a component of null ids alone is named null; repeated rows
share a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import textbytes as tb
from .components import connected_components
from .removal import NO_ID, spread, squeezed
from .shared_shingles import SIMILARITY, commonness, frequencies, remaining_links, set_prints, shingle_links, signatures, word_hashes, word_shingles
from .store import dropped, released_shuffles, written

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Position triples of which any five of eight positions contain one.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
_SMALL_POSTING = 64
#: Entries of a posting beyond which it is dealt over tasks.
LONG_POSTING = 200_000


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit fingerprint of each text of a block."""
    return _fingerprints(*tb.normal_words(data, offsets), shingle)


def _fingerprints(joined: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    n_words = np.diff(first)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(n_words)), n_shingles)
    begin = np.cumsum(n_shingles) - n_shingles
    low = first[text] + np.arange(len(text)) - begin[text]
    high = np.minimum(low + shingle, first[text + 1]) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[low].tolist(), ends[high].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(text))
    out = np.zeros(len(n_words), np.uint64)
    some = np.flatnonzero(n_shingles)
    if len(some):
        for bit in range(64):
            ones = np.add.reduceat((hashes >> np.uint64(bit) & np.uint64(1)).astype(np.int32), begin[some])
            out[some] |= (2 * ones > n_shingles[some]).astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprints(texts: DataFrame) -> DataFrame:
    """`texts`, whose last column is the text, with `fp` in its place: the 64 bits as a signed long."""
    schema = T.StructType([*texts.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.text_blocks(batch.columns[-1]):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(fingerprints(data, offsets).view(np.int64))], names=schema.names)

    return texts.mapInArrow(rows, schema)


def with_prints(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray] | None = None, least: float = SIMILARITY, levels: np.ndarray | None = None) -> DataFrame:
    """`texts`, whose last column is the text, with `fp` and `sig` in its place: the fingerprint and the signature, null without words.

    With `frequent` shingles also node, size, bits and prefix of its set of shingles; `levels` of words order those that are not frequent.
    """
    schema = T.StructType([*texts.schema.fields[:-1], T.StructField("fp", T.LongType()), T.StructField("sig", T.BinaryType())])
    if frequent is not None:
        schema = schema.add("node", T.LongType()).add("size", T.IntegerType()).add("bits", T.BinaryType()).add("prefix", T.ArrayType(T.LongType()))

    return texts.mapInArrow(lambda batches: _prints(batches, frequent, least, levels, schema.names), schema)


def _prints(batches: Iterator[pa.RecordBatch], frequent: tuple[np.ndarray, np.ndarray] | None, least: float, levels: np.ndarray | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in tb.text_blocks(batch.columns[-1], tb.SMALL_BLOCK_BYTES):
            normal = tb.normal_words(data, offsets)
            words = word_hashes(*normal[:3])
            hashes, begin = word_shingles(words, normal[3])
            sig = [x.tobytes() if n else None for x, n in zip(signatures(hashes, begin), np.diff(begin), strict=True)]
            common = None if levels is None else commonness(words, normal[3], levels)
            sets = [] if frequent is None else set_prints(hashes, begin, frequent, least, common)
            yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(_fingerprints(*normal).view(np.int64)), pa.array(sig, pa.binary()), *sets], names=names)


def _linked(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are links: the shared positional bytes are tallied, and pairs with 8 - most of them are verified bit by bit."""
    apart = a ^ b
    enough = np.flatnonzero((apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - most)
    out = np.zeros(len(apart), bool)
    out[enough] = np.bitwise_count(apart[enough]) <= most
    return out


def _small_links(key: np.ndarray, fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within short postings, compared at each distance along the sorted entries."""
    for gap in range(1, _SMALL_POSTING):
        at = np.flatnonzero(key[gap:] == key[:-gap])
        if not len(at):
            return
        near = at[_linked(fp[at], fp[at + gap], most)]
        yield fp[near + gap], fp[near]


def _forest(fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest: each entry is reached once, then leaves the comparison."""
    rest = fp
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = _linked(rest, np.full(len(rest), one), most)
            if near.any():
                found = rest[near]
                yield found, np.full(len(found), one)
                queue.extend(found)
                rest = rest[~near]


def _parted(fp: np.ndarray, masks: list[int]) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """The parts of `fp` whose entries agree in the bits of a mask, for each mask: all short ones together, with their keys, and each long one."""
    for mask in masks:
        key = fp & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        key, own = key[order], fp[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        short = np.repeat(size <= _SMALL_POSTING, size)
        yield True, key[short], own[short]
        for k in np.flatnonzero(size > _SMALL_POSTING):
            yield False, key[edge[k] : edge[k + 1]], own[edge[k] : edge[k + 1]]


def _signed(mask: int) -> int:
    return mask - ((mask >> 63) << 64)


def _bits(places: Iterable[int], width: int) -> int:
    """A mask of the pieces of `width` bits at `places`."""
    return sum(((1 << width) - 1) << (width * p) for p in places)


def _long_links(fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one long posting, that is of entries that share a triple of bytes.

    A link shares at least two of the five other bytes, so the posting is dealt once for each two of
    them into parts that share five bytes. A part that is still long is dealt again, by three of the
    six half bytes in which its entries may differ: a link shares three of them. What is then still
    long has twelve bits left, in which nearly every entry is linked with others, so a spanning
    forest of it takes few comparisons.
    """
    masks = [_bits(t, 8) for t in TRIPLES]
    apart = int(np.bitwise_or.reduce(fp ^ fp[0]))
    # Two postings whose hashes are equal by chance come apart by all triples.
    for is_short, key, own in _parted(fp, [m for m in masks if not apart & m][:1] or masks):
        if is_short:
            yield from _small_links(key, own, most)
            continue
        triple = next(t for t in TRIPLES if len(np.unique(own & np.uint64(_bits(t, 8)))) == 1)
        rest = [p for p in range(8) if p not in triple]
        for two in combinations(rest, 2):
            halves = [h for p in rest if p not in two for h in (2 * p, 2 * p + 1)]
            for is_short, key, part in _parted(own, [_bits(two, 8)]):
                if is_short:
                    yield from _small_links(key, part, most)
                    continue
                for is_short, key, dense in _parted(part, [_bits(h, 4) for h in combinations(halves, 3)]):
                    yield from _small_links(key, dense, most) if is_short else _forest(dense, most)


def _posting_links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by posting; the last posting of a batch may go on in the next."""

    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        long = np.flatnonzero(size > _SMALL_POSTING)
        short = np.repeat(size <= _SMALL_POSTING, size)
        yield from sent(_small_links(key[short], fp[short], most))
        for k in long:
            yield from sent(_long_links(fp[edge[k] : edge[k + 1]], most))

    def sent(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Each link once."""
        if found := list(found):
            a, b = (np.concatenate(side) for side in zip(*found, strict=True))
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            done = [*held, (key[:cut], fp[:cut])]
            yield from links(np.concatenate([k for k, _ in done]), np.concatenate([f for _, f in done]))
            held = []
        elif len(held[-1][0]) and held[-1][0][-1] != key[-1]:
            yield from links(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))
            held = []
        held.append((key[cut:], fp[cut:]))
    yield from links(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))


def near_links(distinct: DataFrame, most: int = MAX_BITS, long_posting: int = LONG_POSTING) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints `fp` at most `most` (up to 3) bits apart.

    Postings are counted first. One of over `long_posting` entries is dealt over tasks by each two of
    the five other bytes, of which a link shares two; so is each of these parts, whatever the size.
    """
    postings = []
    for number, places in enumerate(TRIPLES):
        # The masked value is spread over 64 bits, with the number of the triple.
        postings.append(F.struct(F.xxhash64(F.col("fp").bitwiseAND(F.lit(_signed(_bits(places, 8)))), F.lit(number)).alias("key"), F.lit(number).alias("triple"), F.col("fp")))
    index = distinct.select(F.explode(F.array(*postings)).alias("x")).select("x.*")
    long = written(index.groupBy("key").count().where(F.col("count") > long_posting).select("key"), "long-postings")
    if long.limit(1).count():
        parts = F.array(*(F.array(*(F.xxhash64("key", F.col("fp").bitwiseAND(F.lit(_signed(_bits(two, 8)))), F.lit(n)) for n, two in enumerate(combinations([p for p in range(8) if p not in t], 2)))) for t in TRIPLES))
        found = index.join(long.withColumn("_long", F.lit(True)), "key", "left")
        index = found.select(F.explode(F.when(F.col("_long"), parts[F.col("triple")]).otherwise(F.array("key"))).alias("key"), "fp")
    return index.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _posting_links(batches, most), "a long, b long")


def _named(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, first, root) for each distinct fingerprint; equal roots are connected."""
    roots = connected_components(links)
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`; component_id is the smallest id reachable over links."""
    marked = written(with_fingerprints(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col])), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = _named(distinct, near_links(distinct.select("fp"), most))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_BITS, least: float | None = SIMILARITY) -> DataFrame:
    """`docs` with one row of each component, that of the smallest id; null ids come last.

    Fingerprints at most `most` bits apart are linked, and so are texts that share `least` of their
    five-word shingles (None: fingerprints alone). Fingerprints are written with the id and a hash of
    the text, without texts; the decisions then meet the texts in one exchange, in which texts travel
    compressed. Rows of the smallest id that differ in their text: the one with the smallest hash
    stays. Rows that repeat are one row.
    """
    key, tag = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumn("_q_key", key).withColumn("_q_tag", tag)
    with released_shuffles(docs.sparkSession):
        kept, repeated = _kept(keyed, text_col, most, least)
    # Both sides are dealt, however small `kept` is, so that the texts of a task are never more than its share.
    found = squeezed(keyed, text_col).join(kept.hint("shuffle_merge"), ["_q_key", "_q_tag"], "left_semi")
    if repeated:
        found = found.dropDuplicates(["_q_key", "_q_tag"])
    return spread(found.select(*docs.columns), text_col)


def _kept(keyed: DataFrame, text_col: str, most: int, least: float | None) -> tuple[DataFrame, bool]:
    """The rows (_q_key, _q_tag) of one_of_each(), written, and whether rows of `keyed` share both; other tables go as soon as they are read."""
    texts = keyed.select("_q_key", "_q_tag", text_col)
    if least is None:
        rows = written(with_fingerprints(texts), "fingerprints")
    else:
        frequent, levels = frequencies(texts)
        marked = written(with_prints(texts, frequent, least, levels), "fingerprints")
        rows = written(marked.select("_q_key", "_q_tag", "fp"), "rows")
    distinct = rows.groupBy("fp").agg(F.min(F.struct("_q_key", "_q_tag")).alias("first"))
    links, tables = near_links(distinct.select("fp"), most), [rows]
    if least is not None:
        first = written(links.union(shingle_links(keyed, marked, text_col, least)), "first-links")
        more = remaining_links(keyed, marked, connected_components(first), text_col, least)
        links = first.union(more)
        tables += [first, more]
    kept = written(_named(distinct, links).groupBy("root").agg(F.min("first").alias("x")).select("x.*"), "kept")
    repeated = rows.groupBy("_q_key", "_q_tag").count().where("count > 1").limit(1).count() > 0
    for table in tables:
        dropped(table)
    return kept, repeated

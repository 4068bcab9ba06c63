"""SentencePiece encoding and decoding by way of a distinct-chunk table.

No piece of the vocabulary goes on past a white-space marker that follows another character, so a
text is cut before each run of markers, and each chunk is segmented by itself. Texts are packed into
blocks. A block sends each shard of the table its distinct chunks of that shard, once; the shard
segments a chunk the first time it is asked for, by the library, and answers with ids alone, in the
order asked; the block joins them back by position. So a very common chunk costs a row of a message
a block, and each distinct chunk is segmented once in all. Blocks travel compressed, once.

The number of shards follows from a sketch of the number of distinct chunks, so that a shard's part
of the table is of bounded size, however large the corpus is; each block and each shard is one share
of work, and nothing reaches the driver or is broadcast.

Cases: a null text counts as empty, and an empty text has no ids; a marker character in a text is a
marker like those that stand for spaces, so it decodes to a space; repeated rows are encoded each;
null and equal ids are kept as they are; a text of any length is encoded whole, in one task; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .textbytes import text_blocks

MARK = "▁"
#: Bytes of text of a block; more only where a single text is longer.
BLOCK_BYTES = 8 << 20
#: Chunks of the texts that are decoded at once.
GROUP_CHUNKS = 100_000
#: Distinct chunks of a shard's part of the table.
SHARD_CHUNKS = 200_000


@lru_cache(maxsize=1)
def processor(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


def fits(model_path: str) -> bool:
    """Whether no piece of the model crosses from another character to a marker, and texts are neither rewritten nor trimmed."""
    own = processor(model_path)
    pieces = (own.id_to_piece(k) for k in range(own.get_piece_size()))
    probe = f" a  b\tﬁ Å {MARK} "
    return all(MARK not in p.lstrip(MARK) for p in pieces) and own.decode(own.encode(probe)) == probe.replace(MARK, " ")


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts, each without its first marker, and the number of chunks before each text.

    The marker before a text is not part of it, so the first chunk is spelled as it stands.
    """
    marked = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
    found = list(text_blocks(marked, 1 << 62))
    words, counts = [], [np.zeros(1, np.int64)]
    for _, _, data, offsets in found:
        space = data == 0x20
        cut = np.zeros(len(data), bool)
        cut[1:] = space[1:] & ~space[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        cut[first] = False
        begins = np.union1d(first, np.flatnonzero(cut))
        gone = np.concatenate([[0], np.cumsum(cut)])
        edges = np.append(begins - gone[begins], len(data) - gone[-1])
        words.append(pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data[~cut])))
        counts.append(counts[-1][-1] + np.searchsorted(begins, offsets[1:]))
    return pa.concat_arrays(words) if words else pa.array([], pa.large_string()), np.concatenate(counts)


def segmented(words: list[str], model_path: str) -> list[list[int]]:
    """The ids of each chunk; a marker alone is written as the empty chunk."""
    own = processor(model_path)
    found = own.encode(words, num_threads=1) if words else []
    return [ids if word else [own.piece_to_id(MARK)] for word, ids in zip(words, found, strict=True)]


def _shard(words: list[str], n: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) % n for w in words), np.int64, len(words))


def _packed(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join((struct.pack("<q", len(parts)), np.array([len(p) for p in parts], "<i4").tobytes(), *parts)))


def _unpacked(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    ends = 8 + 4 * n + np.cumsum(np.frombuffer(raw, "<i4", n, 8), dtype=np.int64)
    return [raw[a:b] for a, b in zip([8 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in blocks, each named by a digest of what it holds."""

    def block(ids: list, texts: list) -> pa.RecordBatch:
        blob = _packed([b"" if i is None else str(i).encode() for i in ids] + [(t or "").encode() for t in texts])
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(blob).digest()[:16]], pa.binary()), pa.array([blob], pa.large_binary()).cast(pa.binary())], names=["block", "blob"])

    ids, texts, size = [], [], 0
    for batch in batches:
        for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and size + len(text or "") > most:
                yield block(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(one)
            texts.append(text)
            size += len(text or "")
    if texts:
        yield block(ids, texts)


def _rows(blob: bytes) -> tuple[list, pa.Array]:
    parts = _unpacked(blob)
    half = len(parts) // 2
    return [int(p) if p else None for p in parts[:half]], pa.array(parts[half:], pa.large_binary()).cast(pa.large_string())


def _asked(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """What each block asks each shard: its distinct chunks there."""
    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = pc.unique(chunks(_rows(blob)[1])[0]).to_pylist()
            place = _shard(words, shards)
            order = np.argsort(place, kind="stable")
            edges = np.searchsorted(place[order], np.arange(shards + 1))
            own = np.flatnonzero(np.diff(edges))
            out = [_packed([words[k].encode() for k in order[edges[s] : edges[s + 1]]]) for s in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([block] * len(own), pa.binary()), pa.array(out, pa.binary())], names=["shard", "block", "blob"])


def _answered(batches: Iterator[pa.RecordBatch], model_path: str) -> Iterator[pa.RecordBatch]:
    """Questions come sorted by shard; a chunk is segmented where it is first asked for."""
    now, table = None, {}
    for batch in batches:
        out = []
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if shard != now:
                now, table = shard, {}
            words = _unpacked(blob)
            new = [w for w in words if w not in table]
            table.update(zip(new, (np.array(ids, "<u4").tobytes() for ids in segmented([w.decode() for w in new], model_path)), strict=True))
            out.append(_packed([table[w] for w in words]))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.binary())], names=["block", "shard", "blob"])


def ids_of(texts: pa.Array, shards: int, answers: dict[int, bytes], most: int = GROUP_CHUNKS) -> Iterator[tuple[int, int, list[list[int]], pa.Array]]:
    """Groups of texts of `most` chunks at most, or one text: the first, one past the last, the ids of each, and the same as decimal text joined by commas."""
    words, before = chunks(texts)
    named = words.dictionary_encode()
    distinct, at = named.dictionary.to_pylist(), named.indices.to_numpy()
    place, found = _shard(distinct, shards), [b""] * len(distinct)
    order = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        for k, ids in zip(order[edges[s] : edges[s + 1]].tolist(), _unpacked(answers[s]), strict=True):
            found[k] = ids
    sizes = np.array([len(f) // 4 for f in found], np.int64)
    flat = np.frombuffer(b"".join(found), "<u4")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    spelled = pa.array([",".join(map(str, np.frombuffer(f, "<u4").tolist())) for f in found], pa.large_string())
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(before, before[low] + most, "right")) - 1)
        own = at[before[low] : before[high]].astype(np.int64)
        to = np.concatenate([[0], np.cumsum(sizes[own])])
        ids = flat[np.repeat(starts[own] - to[:-1], sizes[own]) + np.arange(to[-1])]
        edges = before[low : high + 1] - before[low]
        listed = pa.LargeListArray.from_arrays(pa.array(edges), spelled.take(pa.array(own)))
        cuts = to[edges].tolist()
        yield low, high, [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])], pc.binary_join(listed, pa.scalar(",", pa.large_string()))
        low = high


def _joined(shards: int, model_path: str, keep: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def rows(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        said = dict(zip(answers.column("shard").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        own, out = processor(model_path), []
        for blob in blocks.column("blob").to_pylist():
            doc_ids, texts = _rows(blob)
            for low, high, ids, spelled in ids_of(texts, shards, said):
                decoded = own.decode(ids, num_threads=1)
                columns = [pa.array(doc_ids[low:high], pa.int64()), pa.array(map(len, ids), pa.int64()), *(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in x], pa.string()) for x in (spelled.to_pylist(), decoded))]
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if keep else []
                out.append(pa.Table.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)]))
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if keep else [])]))

    return rows


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_chunks: int = SHARD_CHUNKS, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of `docs`, and with keep_ids its ids and the decoded text.

    model_path must name the same file on all workers.
    """
    if not fits(model_path):
        raise ValueError("a piece of this model crosses a white-space marker, or its normaliser rewrites texts")
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    distinct = docs.select(F.explode(F.split("text", " ")).alias("chunk")).agg(F.approx_count_distinct("chunk")).first()[0]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(partitions, -(-distinct // shard_chunks))
    blocks = docs.mapInArrow(lambda b: _blocks(b, block_bytes), "block binary, blob binary").repartition(partitions, "block")
    asked = blocks.mapInArrow(lambda b: _asked(b, shards), "shard long, block binary, blob binary")
    answers = asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda b: _answered(b, model_path), "block binary, shard long, blob binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_joined(shards, model_path, keep_ids), schema)

"""Texts without the byte spans that an operator found in them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

NO_ID = (1 << 63) - 1
_RECODED = 1 << 20


def tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, text): the tag tells rows apart that share an id but not a text; 0 where no id is shared."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    several = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return docs.withColumn("tag", F.pmod(F.xxhash64("text"), F.lit(1 << 32)) if several else F.lit(0).cast("long"))


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = pa.array([squeeze.compress(x.as_py() or b"") for x in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc_id", "tag", "squeezed"])


def _recoded(df: DataFrame, column: str, coder: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """`df` with each value of a binary column recoded; nulls stay null."""
    place, schema = df.columns.index(column), df.schema

    return df.mapInArrow(lambda batches: _recoded_rows(batches, place, coder(), schema.names), schema)


def _recoded_rows(batches: Iterator[pa.RecordBatch], place: int, recode: Callable[[bytes], bytes], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of about _RECODED bytes, so that a worker holds little beside the batch that came."""

    def part(values: list[bytes | None], end: int) -> pa.RecordBatch:
        own = batch.slice(end - len(values), len(values)).columns
        return pa.RecordBatch.from_arrays([pa.array(values, pa.binary()) if k == place else c for k, c in enumerate(own)], names=names)

    for batch in batches:
        values, size = [], 0
        for row, x in enumerate(batch.column(place)):
            values.append(recode(x.as_py()) if x.is_valid else None)
            size += len(values[-1] or b"")
            if size > _RECODED:
                yield part(values, row + 1)
                values, size = [], 0
        yield part(values, batch.num_rows)


def squeezed(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with its texts as compressed bytes, to travel."""
    return _recoded(docs.withColumn(text_col, F.col(text_col).cast("binary")), text_col, lambda: zstandard.ZstdCompressor(level=3).compress)


def spread(docs: DataFrame, text_col: str) -> DataFrame:
    """The texts of squeezed() as they were."""
    return _recoded(docs, text_col, lambda: zstandard.ZstdDecompressor().decompress).withColumn(text_col, F.col(text_col).cast("string"))


def _report(batches: Iterator[pa.RecordBatch], least: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    spread = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc_id, squeezed, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = spread.decompress(squeezed.as_py())
            spans: list[list[int]] = []
            for start, end in sorted((s["start"], s["start"] + s["size"]) for s in found or ()):
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = max(end, spans[-1][1])
                else:
                    spans.append([start, end])
            spans = [s for s in spans if s[1] - s[0] >= min(least, len(raw))]
            edges = [0, *(x for s in spans for x in s), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if keep_text else [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * (5 + keep_text)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: len(columns)])


def without_spans(docs: DataFrame, spans: DataFrame, least: int = 1, keep_text: bool = False) -> DataFrame:
    """A row for each of `docs` (doc_id, tag, text): sizes, the runs removed, and a digest of what is kept.

    spans: (key, tag, start, size) in bytes, key being the id or NO_ID; runs under `least` bytes stay,
    but for one that is the whole text.
    Texts travel to their spans compressed.
    """
    own = spans.groupBy("key", "tag").agg(F.collect_list(F.struct("start", "size")).alias("spans")).withColumnsRenamed({"key": "_key", "tag": "_tag"})
    texts = docs.select("doc_id", "tag", F.col("text").cast("binary")).mapInArrow(_squeezed, "doc_id long, tag long, squeezed binary")
    joined = texts.join(own, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("_key")) & (F.col("tag") == F.col("_tag")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text
    return joined.select("doc_id", "squeezed", "spans").mapInArrow(lambda b: _report(b, least, keep_text), schema)

"""Quality rules: word and line counts, and repeated substrings from a suffix array.

The repetition rule sorts the suffixes of each text, takes the common prefixes of neighbours, and
so knows for every suffix the deepest interval of suffixes that it shares a prefix with. Those
prefixes are the occurrences of the maximal repeated substrings. A text fails when the union of
their spans covers too much of it, or when one of them is too long.

Cases: a null or empty text has no words and fails the base rule; a null id stays null; rows are
judged one by one, so repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb
from .suffixes import long_prefixes, suffix_order

SYMBOLS = tb._table(b"#*$%&|<>")
MIN_REPEAT_BYTES = 50
MAX_COVERED = 0.4
MAX_REPEAT_BYTES = 1000
#: The sorts run fastest when a block and its ranks stay in the cache.
SORT_BLOCK = 1 << 18
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_bytes long, longest_repeat long"


def _in_text(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal values in the same text."""
    return tb.mix(values ^ tb.mix(text.astype(np.uint64) + np.uint64(1)))


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    wordy = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[wordy], ends[wordy]
    text = np.searchsorted(offsets, starts, "right") - 1
    keys = _in_text(tb.text_hash(data, starts, ends, sums), text)
    _, first = np.unique(keys, return_index=True)
    return np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)


def _repeated_words(words: np.ndarray, first: np.ndarray, size: int = 5) -> np.ndarray:
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    windows = tb.window_hash(words, size)
    at = np.flatnonzero(text[: len(windows)] == text[size - 1 :]) if len(windows) else np.zeros(0, np.int64)
    _, where, count = np.unique(_in_text(windows[at], text[at]), return_inverse=True, return_counts=True)
    again = at[count[where] > 1]
    return tb.per_text(tb.covered(again, again + size, len(words)), first)


def repeats(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text that lie in a maximal repeat of `least` bytes or more, and its longest repeat."""
    order, bound = suffix_order(data, offsets)
    lcp = long_prefixes(data, offsets, order, bound, least)
    depth = np.maximum(lcp[:-1], lcp[1:])
    at = np.flatnonzero(depth)
    starts = order[at]
    longest = np.zeros(len(offsets) - 1, np.int64)
    np.maximum.at(longest, np.searchsorted(offsets, starts, "right") - 1, depth[at])
    return tb.per_text(tb.covered(starts, starts + depth[at], len(data)), offsets), longest


def measured(data: np.ndarray, offsets: np.ndarray, min_repeat: int, max_covered: float, max_repeat: int) -> dict[str, np.ndarray]:
    """The rule columns for the texts of one block."""
    sums = tb.prefix_hash(data)
    is_word = ~tb.SPACE[data]
    starts, ends, first = tb.word_spans(is_word, offsets)
    words = tb.text_hash(data, starts, ends, sums)
    n_words = np.diff(first)
    repeat_words = _repeated_words(words, first)
    spans, longest = repeats(data, offsets, min_repeat)
    failed = (n_words < 10) | (100 * repeat_words > 20 * n_words)
    sizes = np.diff(offsets)
    return {
        "n_words": n_words,
        "word_chars": tb.per_text(is_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": tb.per_text(SYMBOLS[data], offsets),
        "n_dup_lines": _repeated_lines(data, offsets, starts, sums),
        "n_repeat_words": repeat_words,
        "base_failed": failed,
        "kept": ~failed & (spans <= max_covered * sizes) & (longest <= max_repeat),
        "covered_bytes": spans,
        "longest_repeat": longest,
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT_BYTES, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT_BYTES) -> DataFrame:
    """One row of counts and verdicts for each row of `docs`; no shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.text_blocks(batch.column(1), SORT_BLOCK):
                columns = measured(data, offsets, min_repeat, max_covered, max_repeat)
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns.values())], names=["doc_id", *columns])

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(rows, SCHEMA)


def passing(docs: DataFrame, text_col: str = "text", min_repeat: int = MIN_REPEAT_BYTES, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT_BYTES) -> DataFrame:
    """The rows of `docs` that the rules keep, as they are."""
    place = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tb.text_blocks(batch.column(place), SORT_BLOCK):
                kept = measured(data, offsets, min_repeat, max_covered, max_repeat)["kept"]
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    return docs.mapInArrow(rows, docs.schema)

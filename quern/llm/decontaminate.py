"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Every item is fed into one automaton over word numbers, which is broadcast; the words of each text
run through it, and the length of the longest match is tracked. A word is hit when it lies in an
occurrence of a window: ten consecutive words of an item, or the whole of a shorter item.
Words and pairs of neighbours that no item has are sorted out first, in bulk, so that the automaton
only steps over stretches that could hold a window.

Size bound: items are dealt into slices of about MAX_ITEM_WORDS words, each slice has an automaton
of its own, and the corpus is scanned once for each slice; only one slice is in memory at a time.
Between slices nothing but what was found is written.

Cases: null and empty texts have no words; a null item id is written as an empty string; items
with equal ids count once; repeated rows give repeated results; other columns are kept untouched by
cleaned() and not read by contamination().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import textbytes as tb
from .store import written

WINDOW = 10
MAX_ITEM_WORDS = 200_000
MAX_COVERAGE = 0.5
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Internal columns; the prefix keeps clear of the columns of the documents.
_STATE = "_q_spans array<struct<first:long,last:long>>, _q_items array<string>, _q_words long"
_FILTER = 1 << 20


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def _hashes(words: list[str]) -> np.ndarray:
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    ends = np.cumsum([len(w) for w in data], dtype=np.int64)
    return tb.text_hash(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


class _Set:
    """Membership of many 64-bit keys: a table of bits sorts most out, a binary search settles the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = np.zeros(_FILTER, bool)
        self.bits[self.keys & np.uint64(_FILTER - 1)] = True

    def rank(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is absent."""
        out = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            maybe = np.flatnonzero(self.bits[keys & np.uint64(_FILTER - 1)])
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == keys[maybe], at, -1)
        return out


class ItemAutomaton:
    """Suffix automaton of all items, with the windows that end in each of its states."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.size, self.link, self.step = [0], [-1], [{}]
        items = [(name, words) for name, words in items if words]
        hashes = [_hashes(words) for _, words in items]
        self.words = _Set(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64))
        self.pairs = _Set(np.concatenate([tb.window_hash(h, 2) for h in hashes]) if hashes else np.zeros(0, np.uint64))
        self.shortest = min((min(len(w), window) for _, w in items), default=window)
        coded = [(name, self.words.rank(h).tolist()) for (name, _), h in zip(items, hashes, strict=True)]
        for _, codes in coded:
            state = 0
            for c in codes:
                state = self._extended(state, c)
        self.full: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for name, codes in coded:
            for end, state, _ in self.matches(codes):
                if end + 1 >= window:
                    self.full.setdefault(self._holding(state, window), set()).add(name)
                elif end + 1 == len(codes):
                    short.setdefault(self._holding(state, len(codes)), []).append((len(codes), name))
        self.short: list[tuple[tuple[int, str], ...]] = [()] * len(self.size)
        for state in sorted(range(len(self.size)), key=self.size.__getitem__):
            self.short[state] = (*short.get(state, ()), *(self.short[self.link[state]] if state else ()))

    def _new(self, size: int, link: int, step: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.step.append(step)
        return len(self.size) - 1

    def _split(self, parent: int, code: int) -> int:
        """The state for exactly the strings of `parent` and one more word."""
        old = self.step[parent][code]
        if self.size[old] == self.size[parent] + 1:
            return old
        copy = self._new(self.size[parent] + 1, self.link[old], dict(self.step[old]))
        self.link[old] = copy
        while parent >= 0 and self.step[parent].get(code) == old:
            self.step[parent][code] = copy
            parent = self.link[parent]
        return copy

    def _extended(self, last: int, code: int) -> int:
        if code in self.step[last]:
            return self._split(last, code)
        state = self._new(self.size[last] + 1, 0, {})
        while last >= 0 and code not in self.step[last]:
            self.step[last][code] = state
            last = self.link[last]
        if last >= 0:
            self.link[state] = self._split(last, code)
        return state

    def _holding(self, state: int, size: int) -> int:
        while self.size[self.link[state]] >= size:
            state = self.link[state]
        return state

    def matches(self, codes) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest match that ends at each word."""
        state = length = 0
        for place, code in enumerate(codes):
            while state and code not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            if code in self.step[state]:
                state, length = self.step[state][code], length + 1
            yield place, state, length

    def hits(self, codes) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, end, items) of each window that occurs."""
        for place, state, length in self.matches(codes):
            if length >= self.window:
                yield place + 1 - self.window, place + 1, self.full.get(self._holding(state, self.window), set())
            for size, name in self.short[state]:
                if size <= length:
                    yield place + 1 - size, place + 1, {name}

    def stretches(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the stretches of words whose neighbours all occur as neighbours in items, and the words' numbers."""
        code = self.words.rank(words)
        known = code >= 0
        joined = np.zeros(len(words), bool)
        if len(words) > 1:
            both = np.flatnonzero(known[:-1] & known[1:])
            keys = tb.mix((words[both] * np.uint64(tb._BASE)) + words[both + 1])
            joined[both[self.pairs.rank(keys) >= 0]] = True
            inner = first[1:-1]
            joined[inner[(inner > 0) & (inner <= len(words))] - 1] = False
        starts = np.flatnonzero(known & ~np.concatenate([[False], joined[:-1]])[: len(words)])
        ends = np.flatnonzero(known & ~joined) + 1
        long = ends - starts >= self.shortest
        return starts[long], ends[long], code


def _scan_block(automaton: ItemAutomaton, data: np.ndarray, offsets: np.ndarray):
    """Hit flags of all words, the items found in each text, and the words' spans."""
    lowered = tb.LOWER[data]
    starts, ends, first = tb.word_spans(tb.ALNUM[lowered], offsets)
    words = tb.text_hash(lowered, starts, ends)
    hit = np.zeros(len(words), bool)
    items: dict[int, set[str]] = {}
    lows, highs, code = automaton.stretches(words, first)
    for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
        for start, end, names in automaton.hits(code[low:high].tolist()):
            hit[low + start : low + end] = True
            text = int(np.searchsorted(first, low, "right")) - 1
            items.setdefault(text, set()).update(names)
    return hit, items, starts, ends, first


def _without(data: np.ndarray, offsets: np.ndarray, hit: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, row: int) -> str:
    """The text with its hit stretches cut out, a space in the place of each."""
    lo, hi = first[row], first[row + 1]
    parts, at = [], offsets[row]
    for a, b in zip(*tb.runs(hit[lo:hi]), strict=True):
        parts.append(data[at : starts[lo + a]].tobytes())
        at = ends[lo + b - 1]
    parts.append(data[at : offsets[row + 1]].tobytes())
    return b"".join(parts).decode("utf-8", "replace")


def _found(batches: Iterator[pa.RecordBatch], own: ItemAutomaton, n_carry: int, cut: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of _scanned(); `cut` is the place of the text whose hit stretches go, else the text follows what is carried and goes itself."""
    for batch in batches:
        n = batch.num_columns
        for lo, hi, data, offsets in tb.text_blocks(batch.column(n_carry if cut is None else cut), tb.SMALL_BLOCK_BYTES):
            before = batch.slice(lo, hi - lo)
            hit, items, starts, ends, first = _scan_block(own, data, offsets)
            for row, spans in enumerate(before.column(n - 2).to_pylist()):
                for span in spans:
                    hit[first[row] + span["first"] : first[row] + span["last"]] = True
            names = [sorted(items.get(row, set()).union(old)) for row, old in enumerate(before.column(n - 1).to_pylist())]
            lows, highs = _runs_by_text(hit, first)
            text = np.searchsorted(first, lows, "right") - 1
            bounds = np.searchsorted(text, np.arange(hi - lo + 1))
            spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(lows - first[text]), pa.array(highs - first[text])], names=["first", "last"]))
            columns = [before.column(k) for k in range(n_carry)]
            if cut is not None:
                texts = before.column(cut).to_pylist()
                for row in np.unique(text).tolist():
                    texts[row] = _without(data, offsets, hit, starts, ends, first, row)
                columns[cut] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, spans, pa.array(names, pa.list_(pa.string())), pa.array(np.diff(first))], names=[f"c{k}" for k in range(n_carry + 3)])


def _scanned(docs: DataFrame, text_col: str, automaton, carry: list[str], cut: bool) -> DataFrame:
    """`carry` columns, spans, items and n_words; what earlier slices found is merged in."""
    fields = [docs.schema[c] for c in carry]
    schema = T.StructType([*fields, *T._parse_datatype_string(_STATE).fields])
    n_carry, place = len(carry), carry.index(text_col) if cut else None
    # A text that is carried is not sent twice.
    text = [] if cut else [docs[text_col].alias("_q_text")]
    return docs.select(*[docs[c] for c in carry], *text, "_q_spans", "_q_items").mapInArrow(lambda batches: _found(batches, automaton.value, n_carry, place), schema)


def _runs_by_text(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of hit words, cut where a new text begins."""
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(hit) + 1, bool)
    edge[first] = True
    before, after = np.concatenate([[False], hit]), np.concatenate([hit, [False]])
    return np.flatnonzero(after & (~before | edge)), np.flatnonzero(before & (~after | edge))


def _with_slices(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, carry: list[str], cut: bool, window: int, max_item_words: int) -> DataFrame:
    """What the slices of items find in `docs`.

    All slices but the last write what they find, by the hash of the text: texts without a hit, and
    texts themselves, are not written. The last pass merges that in.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("name"), benchmark[item_text_col].alias("text"))
    size = items.agg(F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))).alias("n")).first()["n"] or 0
    slices = max(1, -(-size // max_item_words))

    def automaton(k: int):
        part = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(slices)) == k).collect()
        return spark.sparkContext.broadcast(ItemAutomaton([(r["name"], item_words(r["text"])) for r in part], window))

    nothing = {"_q_spans": F.array().cast("array<struct<first:long,last:long>>"), "_q_items": F.array().cast("array<string>")}
    name = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    found = None
    for k in range(slices - 1):
        rows = _scanned(docs.select(name.alias("_q_name"), docs[text_col].alias("_q_whole")).withColumns(nothing), "_q_whole", automaton(k), ["_q_name"], False)
        # Equal texts have equal hits: one row each is kept, before the shuffle.
        rows = written(rows.where(F.size("_q_spans") > 0).drop("_q_words").groupBy("_q_name").agg(F.first("_q_spans").alias("_q_spans"), F.first("_q_items").alias("_q_items")), "decontaminate")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        docs = docs.withColumns(nothing)
    else:
        merged = found.groupBy("_q_name").agg(F.flatten(F.collect_list("_q_spans")).alias("_q_spans"), F.flatten(F.collect_list("_q_items")).alias("_q_items"))
        docs = docs.withColumn("_q_name", name).join(written(merged, "decontaminate"), "_q_name", "left")
        docs = docs.withColumns({c: F.coalesce(c, empty) for c, empty in nothing.items()})
    return _scanned(docs, text_col, automaton(slices - 1), carry, cut)


def _n_hit():
    return F.aggregate("_q_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """doc_id, hit spans (word numbers, end exclusive), items found, n_words and n_hit for each row of `docs`."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = _with_slices(docs, benchmark, "text", item_col, item_text_col, ["doc_id"], False, window, max_item_words)
    return found.withColumn("n_hit", _n_hit()).withColumnsRenamed({"_q_spans": "spans", "_q_items": "items", "_q_words": "n_words"})


def cleaned(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_coverage: float = MAX_COVERAGE, window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """`docs` with every hit span cut out of its text; rows go whose words are covered beyond `max_coverage`."""
    found = _with_slices(docs, benchmark, text_col, item_col, item_text_col, docs.columns, True, window, max_item_words)
    return found.where(_n_hit() <= max_coverage * F.col("_q_words")).select(*[found[c] for c in docs.columns])

"""Operators over all texts at once: substrings, near-duplicates, chunks, language model, packing, and the pipeline."""

import hashlib
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chunks as K
from quern.llm import lm_score as L
from quern.llm import packing as P
from quern.llm import shared_shingles as N
from quern.llm import simhash as H
from quern.llm import substrings as W
from quern.llm.components import connected_components
from quern.llm.decontaminate import cleaned
from quern.llm.lm_score import Filter, lm_scores
from quern.llm.removal import spread, squeezed
from quern.llm.simhash import near_duplicates, near_links, one_of_each

from . import samples as S


def test_substring_dedup_against_all_windows(spark):
    rows = [r for r in S.texts() if len(r[1] or "") < 10_000]
    rows += [(70, rows[0][1][:49]), (71, rows[0][1][10:60]), (72, "z" + rows[1][1][5:60] + "q"), (73, "a" * 300 + "b"), (74, "b" + "a" * 120), (None, rows[2][1] + "!"), (54, "other text, same id: " + (rows[3][1] or ""))]
    got = S.rows_of(W.substring_dedup(S.documents(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == S.removed_windows(rows)


def test_substring_dedup_of_very_long_texts(spark):
    rng = random.Random(6)
    passage = S.prose(rng, 20_000)
    rows = [(1, passage), (2, S.prose(rng, 300) + passage[1000:90_000] + S.prose(rng, 300)), (3, "ab" * 60_000), (4, "ab" * 3000 + passage[:49]), (5, "\u6f22" * 30_000)]
    got = S.rows_of(W.substring_dedup(S.documents(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == S.removed_windows(rows)


def test_substring_dedup_of_many_small_shares(spark, monkeypatch):
    monkeypatch.setattr(W, "PART_BYTES", 300)
    rng = random.Random(1)
    pool = [S.prose(rng, 30) for _ in range(12)]
    rows = [(k, " ".join(rng.choice(pool)[rng.randrange(40) :] for _ in range(4))) for k in rng.sample(range(1000), 40)]
    df = W.substring_dedup(S.documents(spark, rows), keep_text=True)
    assert S.rows_of(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == S.removed_windows(rows)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in df.collect())


def test_repeated_intervals_are_the_repeated_strings():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(4, 30))) for _ in range(40)]
    to = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    order, low, high = W.repeated_intervals(np.frombuffer(b"".join(strings), np.uint8), to, 5)
    places = defaultdict(set)
    for s, begin in zip(strings, to):
        for k in range(len(s) - 4):
            places[s[k : k + 5]].add(int(begin) + k)
    assert sorted(sorted(order[a:b].tolist()) for a, b in zip(low, high)) == sorted(sorted(p) for p in places.values() if len(p) > 1)


@pytest.mark.parametrize("share_bytes", [1 << 30, 400, 1])
def test_shares_of_a_bucket_are_told_without_hashing_it_again(monkeypatch, share_bytes):
    monkeypatch.setattr(W, "SHARE_BYTES", share_bytes)
    rng, solved, hashed = random.Random(8), [], []
    one, other = S.prose(rng, 60), S.prose(rng, 60)
    texts = [one, other, S.prose(rng, 30) + " " + one, other + " " + S.prose(rng, 30), S.prose(rng, 30) + " " + one[80:]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array([0] * 5, pa.int64()), pa.array(texts)], names=["doc_id", "tag", "text"])
    blocks = list(W._dealt(iter([batch]), 50, 10, 1))
    solve, least = W._solved, W._least_grams
    monkeypatch.setattr(W, "_solved", lambda *a: solved.append(1) or solve(*a))
    monkeypatch.setattr(W, "_least_grams", lambda *a: hashed.append(1) or least(*a))
    gone = [set() for _ in texts]
    for r in (r for b in W._settled(iter(blocks), 50, 10) for r in b.to_pylist()):
        gone[r["key"]] |= set(range(r["start"], r["start"] + r["size"]))
    wanted = S.removed_windows(list(enumerate(texts)))
    assert [len(g) for g in gone] == [row[2] for row in wanted]
    assert share_bytes == 1 or len(hashed) == len(solved)
    data = np.frombuffer(one.encode(), np.uint8)
    sums, at = W.tb.prefix_hash(data), np.arange(len(data) - 9)
    assert (W.tb.gram_hash(sums, 10) == W.tb.span_hash(sums, at, at + 10)).all()


def test_near_duplicates_against_all_pairs(spark):
    rows = S.texts()
    rng = random.Random(9)
    long = S.prose(rng, 400)
    rows += [(80 + k, long + f" end{k}") for k in range(20)]
    got = S.rows_of(near_duplicates(S.documents(spark, rows)), "doc_id", "fp", "component_id")
    prints = [(i, S.simhash(t)) for i, t in rows]
    root = S.components([f for _, f in prints])
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert got == sorted(((i, signed(f), least.get(root[f])) for i, f in prints), key=repr)


def _linked_in_all(prints: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]], rng: random.Random, n: int) -> None:
    """All links are links, and of `n` entries all linked ones are reached."""
    pairs = {(int(a), int(b)) for x, y in links for a, b in zip(x, y, strict=True)}
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    root: dict[int, int] = {int(f): int(f) for f in prints}

    def find(f: int) -> int:
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for a, b in pairs:
        root[find(a)] = find(b)
    for k in rng.sample(range(len(prints)), n):
        near = prints[np.bitwise_count(prints ^ prints[k]) <= 3]
        assert len({find(int(f)) for f in near}) == 1


@pytest.mark.parametrize("free", [40, 24, 14])
def test_a_posting_of_forty_thousand_is_not_compared_pair_by_pair(free):
    rng = np.random.default_rng(free)
    values = rng.integers(0, 1 << free, 40_000 if free > 14 else 9_000, np.uint64)
    prints = np.unique(np.concatenate([values, values[:5000] ^ (np.uint64(1) << rng.integers(0, free, min(5000, len(values)), np.uint64))])) + np.uint64(0xABCDEF << 40)
    began = time.perf_counter()
    links = list(H._long_links(prints, 3))
    assert time.perf_counter() - began < 20
    _linked_in_all(prints, links, random.Random(1), 300)


def test_long_postings_are_dealt_alike(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 40, 3000, np.uint64)
    prints = np.unique(np.concatenate([values, values[:900] ^ np.uint64(5 << 12)])) + np.uint64(0x123456 << 40)
    called = []
    monkeypatch.setattr(H, "_long_links", lambda fp, most, own=H._long_links: called.append(len(fp)) or own(fp, most))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(prints), np.int64)), pa.array(prints.view(np.int64))], names=["key", "fp"])
    direct = [tuple(r.values()) for b in H._posting_links(iter([batch]), 3) for r in b.to_pylist()]
    assert called == [len(prints)] and len(set(direct)) == len(direct)
    monkeypatch.undo()
    df = spark.createDataFrame([(int(f),) for f in prints.view(np.int64)], "fp long")
    for long_posting in (10, 1_000_000):
        got = connected_components(near_links(df, long_posting=long_posting)).collect()
        want = S.components([int(f) for f in prints])
        mine = {r["node"] % (1 << 64): r["root"] for r in got}
        both = defaultdict(set)
        for f in mine:
            both[want[f]].add(mine[f])
        assert all(len(x) == 1 for x in both.values()) and len({min(x) for x in both.values()}) == len(both) and len(mine) == sum(n for n in Counter(want.values()).values() if n > 1)


def test_links_connect_what_pairs_connect(spark):
    rng = random.Random(4)
    prints = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            prints.add(f)
            for _ in range(rng.randrange(0, 5)):
                f ^= 1 << rng.randrange(64)
    crowd = rng.getrandbits(64)
    prints |= {crowd ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    links = near_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3 for a, b in links.collect())
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want, groups = S.components(list(prints)), defaultdict(set)
    for f, s in zip(prints, signed):
        groups[want[f]].add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


def test_one_of_each_keeps_rows_whole(spark):
    rows = [(5, "same text in a few words"), (3, "same text in a few words"), (3, "same text in a few words"), (None, "same text in a few words"), (9, "quite another text, of some other words"), (None, "only null ids have these words")]
    docs = S.documents(spark, rows)
    got = one_of_each(docs)
    assert got.columns == docs.columns and sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(3, rows[0][1]), (9, rows[4][1]), (None, rows[5][1])], key=repr)


def test_gear_hash_and_chunks_round_trip():
    rng = random.Random(2)
    texts = [b"", b"x", bytes(rng.randrange(256) for _ in range(5000)), b"ab" * 3000]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    got, at = K.gear_hashes(data, offsets), 0
    for t in texts:
        h = 0
        for c in t:
            h = (2 * h + int(K.GEAR[c])) % (1 << 64)
            assert int(got[at]) == h
            at += 1
    starts, ends = K.chunk_ends(data, offsets)
    assert all(b"".join(data[a:b].tobytes() for a, b in zip(starts, ends) if lo <= a < hi) == t for t, lo, hi in zip(texts, offsets, offsets[1:]))
    assert (ends - starts).max() <= K.MAX_CHUNK


def test_chunks_resist_insertions(spark):
    rng = random.Random(7)
    passage, other = S.prose(rng, 150), [S.prose(rng, 100) for _ in range(6)]
    rows = [(k, o + " " + passage[k:] + " " + o[::-1]) for k, o in enumerate(other)] + [(9, S.prose(rng, 100)), (10, None), (11, ""), (None, other[0])]
    got = {r["doc_id"]: r for r in K.chunk_dedup(S.documents(spark, rows), keep_text=True).collect()}
    assert got[0]["n_removed"] == got[9]["n_removed"] == 0
    for k in range(1, 6):
        assert 0.6 * len(passage) < got[k]["n_removed"] <= len(passage) + 2 * K.MAX_CHUNK and other[k][: len(other[k]) // 2] in got[k]["kept_text"]
    assert all(r["n_bytes"] == len((dict(rows)[i] or "").encode()) for i, r in got.items())


def test_chunks_of_short_copies_and_repeats_within_a_text(spark):
    rng = random.Random(9)
    short, passage = "a short text of few words", S.prose(rng, 200)
    twice = passage + " -- " + passage
    rows = [(1, short), (2, short), (3, short), (4, S.prose(rng, 30) + " " + short + " " + S.prose(rng, 30)), (5, "x"), (6, "x"), (7, twice), (7, twice), (8, None), (None, short)]
    got = {}
    for r in K.chunk_dedup(S.documents(spark, rows), keep_text=True).collect():
        got.setdefault(r["doc_id"], set()).add((r["kept_text"], r["n_removed"]))
    assert got[1] == {(short, 0)} and got[2] == got[3] == got[None] == {("", len(short))} and got[4] == {(rows[3][1], 0)}
    assert got[5] == {("x", 0)} and got[6] == {("", 1)} and got[8] == {("", 0)}
    ((kept, gone),) = got[7]
    assert len(kept) + gone == len(twice) and kept.startswith(passage) and gone > 0.6 * len(passage)


@pytest.mark.parametrize("least", [1, K.LEAST])
def test_chunks_against_brute_force(spark, least):
    rng = random.Random(12)
    pool = [S.prose(rng, 40) for _ in range(10)]
    rows = [(k // 2, " ".join(rng.choice(pool)[rng.randrange(60) :] for _ in range(rng.randrange(1, 6)))) for k in range(40)]
    rows += [(None, rows[0][1]), (None, rows[0][1] + "!"), (None, pool[1]), (90, None), (91, ""), rows[3], (92, pool[2] * 3), (93, "x"), (94, "x"), (95, S.prose(rng, 30_000))]
    order = lambda i: K.NO_ID if i is None else i
    cut, holder, first = {}, {}, {}
    for key, text in {(order(i), t or "") for i, t in rows}:
        raw = text.encode()
        starts, ends = K.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        cut[key, text] = [(a, b, hashlib.blake2b(raw[a:b]).digest()) for a, b in zip(starts.tolist(), ends.tolist())]
        for a, _, d in cut[key, text]:
            holder[d] = min(key, holder.get(d, key))
            first[key, text, d] = min(a, first.get((key, text, d), a))
    want = []
    for i, t in rows:
        key, text = order(i), t or ""
        raw, runs = text.encode(), []
        for a, b, d in cut[key, text]:
            if key > holder[d] or a > first[key, text, d]:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        runs = [r for r in runs if r[1] - r[0] >= min(least, len(raw))]
        gone = [False] * len(raw)
        for a, b in runs:
            gone[a:b] = [True] * (b - a)
        want.append((i, len(raw), sum(gone), len(runs), hashlib.sha256(bytes(x for x, g in zip(raw, gone) if not g)).hexdigest()))
    got = S.rows_of(K.chunk_dedup(S.documents(spark, rows), least=least), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(want, key=repr)


def _tokens(text):
    return [*S.words(S.lower(text or "")), None]


def test_lm_base_score_and_counts(spark):
    rows = S.texts()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(t for i, x in rows if not held(i) for t in _tokens(x))
    n, v = sum(counts.values()), len(counts)
    one, two = (lm_scores(S.documents(spark), max_filter_bytes=size).collect() for size in (1 << 26, 0))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in one), key=repr)
    want = [(i, held(i), len(_tokens(x)), sum(counts[t] > 0 for t in _tokens(x)), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in _tokens(x)), 6)) for i, x in rows]
    assert got == sorted(want, key=repr)
    assert sorted((r["score"] for r in one)) == sorted((r["score"] for r in two))


def test_lm_score_against_a_plain_filter(spark):
    rows = S.texts()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    coded = []
    for _, text in rows:
        raw = (text or "").encode()
        tokens, first = L._tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        coded.append((tokens.tolist(), L.pair_hashes(tokens, first[:-1]).tolist()))
    words, pairs = Counter(), Counter()
    for (i, _), (tokens, own) in zip(rows, coded):
        if not held(i):
            words.update(tokens)
            pairs.update(own)
    n, v, n_texts = sum(words.values()), len(words), sum(not held(i) for i, _ in rows)
    n_bits = int(sum(c.bit_length() for c in pairs.values()) * L.BITS_PER_ENTRY) // 8 * 8 + 8
    places = lambda key, level: [int(p[0]) for p in Filter.places(np.array([key], np.uint64), level, n_bits)]
    flags = {p for key, c in pairs.items() for level in range(1, c.bit_length() + 1) for p in places(key, level)}

    def count(key):
        level = 0
        while flags.issuperset(places(key, level + 1)):
            level += 1
        return (3 * 2 ** (level - 1) - 1) / 2 if level else 0

    want = []
    for (i, _), (tokens, own) in zip(rows, coded):
        total, before = 0, n_texts
        for token, pair in zip(tokens, own):
            c = words[token]
            p = (c + 0.1) / (n + 0.1 * (v + 1))
            total += math.log10((min(count(pair), before) + L.MU * p) / (before + L.MU))
            before = c
        want.append((i, round(total, 5)))
    got = [(r["doc_id"], round(r["score"], 5)) for r in lm_scores(S.documents(spark)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lm_learns_word_order(spark):
    rng = random.Random(1)
    chain = {w: rng.sample(S.WORDS, 3) for w in S.WORDS}

    def text():
        w, out = rng.choice(S.WORDS), []
        for _ in range(60):
            w = rng.choice(chain[w])
            out.append(w)
        return " ".join(out)

    got = [r for r in lm_scores(S.documents(spark, [(k, text()) for k in range(300)])).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.75 * sum(r["base_score"] for r in got)


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = rng.zipf(1.5, len(keys)).clip(max=1 << 20)
    own = Filter.of(keys, counts)
    assert (own.counts(keys) >= (3 * 2.0 ** np.floor(np.log2(counts)) - 1) / 2 - 0.01).all()
    assert (own.counts(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.06


def test_ids_are_those_of_the_tokenizer_file():
    from tokenizers import Tokenizer

    vocabulary = P.default_vocabulary()
    slow = Tokenizer.from_file(vocabulary[0])
    rng = random.Random(3)
    texts = [t or "" for _, t in S.texts()] + ["<|endoftext|> x<|endoftext|>", "a  b\n\n c\t\xa0d e it's I'LL 12,345"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x10000, 0x20000), 0x85, 0x200B, 0x0A])) for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert P.token_ids(t, vocabulary).tolist() == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_plan_uses_each_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2049, 3000), np.minimum(2048, rng.lognormal(5.5, 1, 9000).astype(int) + 1), np.full(50, 2048)][seed]
    counts = np.bincount(lengths, minlength=2049)
    used = np.zeros(2049, int)
    sequences = 0
    for pattern in P.plan(counts):
        assert sum(pattern.lengths) <= 2048
        np.add.at(used, list(pattern.lengths), pattern.times)
        sequences += pattern.times
    assert (used == counts).all() and sequences <= 1.06 * math.ceil(lengths.sum() / 2048)


def test_packed_pieces_round_trip(spark, monkeypatch):
    monkeypatch.setattr(P, "RANK_GROUP", 20)
    rows, vocabulary = S.texts(), P.default_vocabulary()
    got = P.packed(S.documents(spark)).collect()
    want = []
    for i, t in rows:
        ids = [*P.token_ids(t or "", vocabulary).tolist(), 0]
        cut = list(range(len(ids), 0, -2048))[::-1]
        for piece, end in enumerate(cut):
            start = cut[piece - 1] if piece else 0
            want.append((i, piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1


def test_empty_tables(spark):
    docs = S.documents(spark, [])
    for df in (W.substring_dedup(docs), near_duplicates(docs), one_of_each(docs), K.chunk_dedup(docs), lm_scores(docs), P.packed(docs)):
        assert df.collect() == []


def test_pipeline_stages_hold_their_promises(spark, tmp_path):
    rng = random.Random(11)
    clean = [S.prose(rng, 120) for _ in range(12)]
    item = S.prose(rng, 20)
    rows = [(k, t) for k, t in enumerate(clean)] + [(20, clean[0]), (21, clean[1] + " word"), (22, "buy now " * 80), (23, clean[2][:300] + " " + item + " " + clean[3][300:]), (24, clean[4] + " password=hunter2hunter2"), (25, None)]
    S.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        steps[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {22, 25}.isdisjoint(steps["quality_rules"]) and len(steps["quality_rules"]) == len(rows) - 2
    assert 0 in steps["near_dedup"] and 20 not in steps["near_dedup"] and set(range(2, 4)) <= set(steps["near_dedup"])
    assert item.split()[5] + " " + item.split()[6] not in steps["decontamination"][23] and 23 in steps["decontamination"]
    assert all("hunter2" not in t for t in steps["secret_scan"].values()) and steps["secret_scan"][5] == clean[5]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(steps["secret_scan"])


def test_pipeline_of_empty_tables_and_awkward_rows(spark, tmp_path):
    bench = spark.createDataFrame([], "item_id long, text string")
    S.documents(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    bench.write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    S.documents(spark).write.parquet(f"{tmp_path}/odd/documents.parquet")
    bench.write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/odd")
        assert docs.columns == S.documents(spark).columns and docs.count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() >= docs.count()


def test_one_of_each_of_rows_that_share_an_id(spark):
    rng = random.Random(3)
    a, b = S.prose(rng, 80), S.prose(rng, 80)
    rows = [(1, a), (1, b), (2, a), (3, b), (4, None), (5, ""), (None, a), (None, "other words of their own here"), (6, b + ""), (1, a)]
    got = sorted(((r["doc_id"], r["text"]) for r in one_of_each(S.documents(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (4, None), (None, "other words of their own here")], key=repr)


def _five_words(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_shingle_links_against_all_pairs(spark, monkeypatch):
    """One text has 80 near copies, all different, compared in parts of 7; links are right and join all that are similar."""
    monkeypatch.setattr(N, "PART", 7)
    rng = random.Random(23)
    texts = [S.prose(rng, n) for n in (3, 5, 40, 200, 200, 900)]
    for base in [*texts[2:], *[texts[3]] * 80]:
        words = base.split()
        for k in rng.sample(range(len(words)), max(1, len(words) // rng.choice((30, 40, 60, 200)))):
            words[k] = S.prose(rng, 1) + "x"
        texts.append(" ".join(words))
    rows = [*enumerate(texts), (500, None), (501, ""), (502, texts[4].upper()), (503, texts[0] + "\n")]
    docs = S.documents(spark, rows).withColumn("_q_key", F.col("doc_id")).withColumn("_q_tag", F.xxhash64("text"))
    marked = H.with_prints(docs.select("_q_key", "_q_tag", "text")).collect()
    links = {frozenset(r) for r in N.shingle_links(docs, spark.createDataFrame(marked, "_q_key long, _q_tag long, fp long, sig binary"), "text").collect()}
    fp = {r["_q_key"]: r["fp"] for r in marked}
    sets = {i: _five_words(t) for i, t in rows}
    similar = {(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and a and b and len(a & b) >= 0.8 * len(a | b)}
    assert links <= {frozenset((fp[i], fp[j])) for i, j in similar} and len(similar) > 400
    root = {f: f for f in fp.values()}
    for _ in root:
        for a, b in map(tuple, links):
            root[a] = root[b] = min(root[a], root[b])
    together = sum(root[fp[i]] == root[fp[j]] for i, j in similar)
    assert together >= 0.99 * len(similar)
    kept = {r["doc_id"] for r in one_of_each(docs.drop("_q_key", "_q_tag")).collect()}
    assert {0, 1, 2, 3, 4, 5, 500} <= kept and {501, 502, 503}.isdisjoint(kept)


def test_one_of_each_loses_no_pair_among_unlike_texts(spark, monkeypatch):
    """All texts share most of their words, only two of each family 0.8 of their shingles, and neither is an end of a posting as a rule."""
    monkeypatch.setattr(N, "PART", 40)
    rng = random.Random(31)
    head, texts = S.prose(rng, 160), []
    for _ in range(120):
        tail = [S.prose(rng, 1) + str(rng.randrange(1000)) for _ in range(40)]
        near = [w + "x" if k % 9 == 4 and k < 36 else w for k, w in enumerate(tail)]
        texts += [f"{head} {' '.join(tail)}", f"{head} {' '.join(near)}"]
    rng.shuffle(texts)
    sets, fps = [_five_words(t) for t in texts], [S.simhash(t) for t in texts]
    root = list(range(len(texts)))
    similar = 0
    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 3:
                similar += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 100 <= similar < 1000
    kept = {r["doc_id"] for r in one_of_each(S.documents(spark, list(enumerate(texts)))).collect()}
    assert kept == set(root)


def test_prefixes_and_parity_bits_lose_no_pair():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 4, 5, 9, 10, 37, 400, 6000):
        a = rng.integers(1, 1 << 63, n).astype(np.uint64)
        for cut in range(n // 9 + 1):
            b = np.concatenate([a[cut:], rng.integers(1, 1 << 63, cut).astype(np.uint64)])
            if n > 40 and cut not in (0, 7, n // 9 - 1, n // 9):
                continue
            frequent = np.sort(a[: n // 2]), np.arange(n // 2) + 3
            _, size, bits, prefix = N.set_prints(np.concatenate([a, a[:1], b]), np.array([0, n + 1, 2 * n + 1]), frequent, 0.8)
            assert size.to_pylist() == [n, n]
            x, y = (set(p) for p in prefix.to_pylist())
            if (n - cut) >= 0.8 * (n + cut):
                assert x & y
                one, other = (np.frombuffer(v, np.uint8) for v in bits.to_pylist())
                assert np.bitwise_count(one ^ other).sum() <= 2 * n * 0.2 / 1.8 + 1e-9


@pytest.mark.parametrize("held", [1, 3, 1 << 20])
@pytest.mark.parametrize("rows", [1, 2, 5, 100])
def test_postings_of_several_roots_pass_whole(monkeypatch, held, rows):
    monkeypatch.setattr(N, "_HELD", held)
    rng = random.Random(held + rows)
    index = sorted((rng.randrange(12), rng.choice((1, 1, 1, 2)), k) for k in range(60))
    column = lambda k, part: pa.array([r[k] for r in part], pa.int64())
    batches = [pa.RecordBatch.from_arrays([column(0, p), column(2, p), column(1, p)], names=["key", "node", "root"]) for p in (index[a : a + rows] for a in range(0, 60, rows))]
    got = {(r["key"], r["node"]) for b in N._several(iter(batches)) for r in b.to_pylist()}
    several = {k for k, _, _ in index if len({r for q, r, _ in index if q == k}) > 1}
    assert got >= {(k, n) for k, _, n in index if k in several}
    assert held < 1 << 20 or got == {(k, n) for k, _, n in index if k in several}


def test_signature_bytes_agree_about_as_often_as_shingles_are_shared():
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.8, 0.95):
        both, own = int(1000 * share), 1000 - int(1000 * share)
        h = rng.integers(0, 1 << 64, both + own, np.uint64)
        a, b = h[: both + own // 2], np.concatenate([h[:both], h[both + own // 2 :]])
        sig = N.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert abs((sig[0] == sig[1]).mean() - share) < 0.17
    assert not N.signatures(np.zeros(0, np.uint64), np.array([0, 0])).any() and N.tally_minimum(0.8) == 65


@pytest.mark.parametrize("stage, times", [("prints", 16), ("cleaned", 16), ("squeezed", 0.7), ("spread", 0.7)])
def test_a_worker_holds_little_beside_the_batch_that_came(spark, monkeypatch, stage, times):
    rng = random.Random(7)
    docs = spark.createDataFrame([(k, " ".join(f"{rng.getrandbits(32):x}" for _ in range(230))) for k in range(2000)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("a", docs.first()["text"])], "item_id string, text string")
    tasks = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema, *a, real=type(docs).mapInArrow, **b: tasks.append((df, f)) or real(df, f, schema, *a, **b))
    made = {"prints": lambda: H.with_prints(docs, (np.zeros(0, np.uint64),) * 2), "cleaned": lambda: cleaned(docs, items), "squeezed": lambda: squeezed(docs, "text"), "spread": lambda: spread(squeezed(docs, "text"), "text")}[stage]()
    came, task = tasks[-1]
    batch = came.toArrow().combine_chunks().to_batches()[0]
    size = sum(len(t.encode()) for (t,) in docs.select("text").collect())
    assert batch.num_rows == 2000 and size > 4_000_000
    list(task(iter([batch.slice(0, 10)])))  # what is loaded once
    tracemalloc.start()
    rows = sum(b.num_rows for b in task(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and made.count() == 2000 - (stage == "cleaned")
    assert peak < times * size, peak


def _shuffle_blocks(spark):
    return sum("shuffle_" in str(b) for b in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split(" "))


def test_one_of_each_leaves_no_shuffles_and_tables(spark, tmp_path, monkeypatch):
    """Shuffle files and tables of the steps go before the result is read; nothing else would bound the disk of a large run."""
    rng = random.Random(3)
    texts = [S.prose(rng, 60) for _ in range(40)]
    docs = S.documents(spark, list(enumerate([*texts, *(f"{t} end" for t in texts)])))
    monkeypatch.setattr("quern.sources.tables.shared_dir", lambda spark: f"file://{tmp_path}")
    before = _shuffle_blocks(spark)
    kept = one_of_each(docs)
    for _ in range(50):  # files go a little later than the query ends
        if _shuffle_blocks(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_blocks(spark) <= before
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} <= {"kept", "links", "long-postings", "shingle-links"}
    assert kept.count() == 40
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_comparisons_go_in_rounds(spark, monkeypatch):
    """With rounds of few rows no round sends more than its share, and all pairs are found."""
    monkeypatch.setattr(N, "PART", 9)
    sets = [(node, node, 100, bytes(128)) for node in range(60)]
    nodes = spark.createDataFrame(sets, "node long, root long, size int, bits binary")
    met = spark.createDataFrame([(key, node) for key in range(8) for node in range(60) if key == 0 or node % 8 == key], "key long, node long")
    sent = []
    monkeypatch.setattr(N, "written", lambda df, name, real=N.written: (name == "unlike" and sent.append(name)) or real(df, name))
    tables = N._unlike_pairs(met, nodes, 0.8, 100)
    n_rows = 60 * math.ceil(60 / 9) + 7 * 8
    assert len(sent) == len(tables) and n_rows // 100 <= len(sent) <= n_rows // 100 + 1
    assert max(t.count() for t in tables) < 60 * 59 / 4
    assert {tuple(r) for t in tables for r in t.collect()} == {(a, b) for a in range(60) for b in range(a)}


def test_exact_comparisons_go_in_rounds(spark, monkeypatch):
    """A round compares its share of the pairs, and all that are similar are found."""
    rng = random.Random(41)
    base = S.prose(rng, 300).split()
    texts = [" ".join(f"{w}{k}" if at == 30 * k + 5 else w for at, w in enumerate(base)) for k in range(8)]
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate([*texts, S.prose(rng, 300)])], "_q_key long, _q_tag long, text string")
    nodes = docs.select(F.col("_q_key").alias("node"), F.col("_q_key").alias("fp"), "_q_key", "_q_tag", F.lit(296).alias("size"))
    pairs = spark.createDataFrame([(a, b) for a in range(9) for b in range(a)], "node long, centre long")
    compared = []
    monkeypatch.setattr(N, "_compared", lambda docs, nodes, pairs, *a, real=N._compared: compared.append(pairs.count()) or real(docs, nodes, pairs, *a))
    links = N._compared_in_rounds(docs, nodes, pairs, "text", 0.8, 18_000)
    assert len(compared) == 3 and sum(compared) == 36 and max(compared) < 24
    assert {tuple(r) for x in links for r in x.collect()} == {(a, b) for a in range(8) for b in range(a)}


def test_texts_that_share_common_words_do_not_meet(spark):
    """Shingles of common words are shared by chance; the prefixes hold those of rare words instead."""
    rng = random.Random(17)
    common = [S.prose(rng, 1) + "q" for _ in range(12)]
    texts = [" ".join(f"{rng.getrandbits(40):x}" if rng.random() < 0.1 else rng.choice(common) for _ in range(200)) for _ in range(300)]
    docs = S.documents(spark, list(enumerate(texts))).select(F.col("doc_id").alias("_q_key"), F.xxhash64("text").alias("_q_tag"), "text")
    frequent, levels = N.frequencies(docs)
    prefixes = [r["prefix"] for r in H.with_prints(docs, frequent, 0.8, levels).collect()]
    times = Counter(k for p in prefixes for k in p)
    assert sum(n for n in times.values() if n > 1) < 0.01 * sum(times.values())

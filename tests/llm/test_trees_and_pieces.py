"""Merkle manifest, SentencePiece by distinct chunks, and the trie of conversations, against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quern.llm import merkle as M
from quern.llm import pieces as P
from quern.llm import queries as Q
from quern.llm import turn_trie as V

from . import samples as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf the siblings before and after it on each level."""
    paths: list[list[tuple[str, str]]] = [[] for _ in leaves]
    level, under = list(leaves), [[k] for k in range(len(leaves))]
    while len(level) > 1:
        after, held = [], []
        for at in range(0, len(level), fanout):
            own = level[at : at + fanout]
            for k in range(len(own)):
                for leaf in under[at + k]:
                    paths[leaf].append(("".join(own[:k]), "".join(own[k + 1 :])))
            after.append(_hash(*own))
            held.append([leaf for u in under[at : at + fanout] for leaf in u])
        level, under = after, held
    return level[0], paths


def _manifest(rows: list[tuple], fanout: int = 2) -> list[tuple]:
    """rows: (doc_id, text, lang, source, n_chars)."""

    def leaf(doc_id, text, lang, source, n_chars) -> str:
        return _hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    by_lang = defaultdict(list)
    for r in rows:
        marked = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(*r[:4], r[4] + 1) if marked else leaf(*r), r[0]))
    groups = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    roots, below = [], []
    for g in groups:
        own = sorted(by_lang[g], key=lambda x: x[:4])
        root, paths = _tree([x[2] for x in own], fanout)
        roots.append(root)
        below.append((own, paths))
    root, tops = _tree(roots, fanout) if roots else (None, [])
    out = []
    for subroot, top, (own, paths) in zip(roots, tops, below, strict=True):
        for (_, _, clean, other, doc_id), path in zip(own, paths, strict=True):
            now = other
            for left, right in path + top:
                now = _hash(left, now, right)
            out.append((doc_id, clean, subroot, root, _hash(*(a + b for a, b in path + top)), now, now == root))
    return sorted(out, key=repr)


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, part string, digest string, ix long").repartition(3)


_COLUMNS = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _got(spark, rows, **more):
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return S.rows_of(M.manifest(_docs(spark, rows), tampered={"n_chars": F.when(marked, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, **more), *_COLUMNS)


ROWS = [
    *((k, f"text {k} é漢", ["en", "de", "fr", None, ""][k * k % 5], f"s{k % 3}", k) for k in range(40)),
    (None, None, None, None, None), (None, "a", "zz", None, 3), (7, "one", "en", "s", 3), (7, "two", "en", "s", 3), (7, "two", "en", "s", 3), (99, "", "alone", "", 0), (-4, "b" * 100_000, "en", "s", None),
]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_against_a_plain_tree(spark, fanout):
    got = _got(spark, ROWS, fanout=fanout)
    assert got == _manifest(ROWS, fanout) and {r[-1] for r in got} == {True, False}


def test_manifest_of_one_group_and_of_joined_counts(spark, monkeypatch):
    rows = [(k, f"t{k}", "en", None, k) for k in range(33)]
    assert _got(spark, rows) == _manifest(rows)
    monkeypatch.setattr(M, "BROADCAST_BYTES", -1)
    assert _got(spark, rows[:5]) == _manifest(rows[:5]) and _got(spark, rows[:1]) == _manifest(rows[:1])


def test_manifest_of_an_empty_table(spark):
    assert _got(spark, []) == []


def test_numbers_follow_the_order_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc") if k % 3 else "a", rng.randrange(300)) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    got = sorted((r["g"], r["ix"], r["v"], r["n"]) for r in M.numbered(df, "g", ["v"]).collect())
    want = []
    for g in "abc":
        own = sorted(v for h, v in rows if h == g)
        want += [(g, k, v, len(own)) for k, v in enumerate(own)]
    assert got == want


def _pieces(rows):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = []
    for doc_id, text in rows:
        ids = own.encode(text or "")
        out.append((doc_id, len(ids), _hash(",".join(map(str, ids))), _hash(own.decode(ids))))
    return sorted(out, key=repr)


_ODD = [" ", "  ", "▁", "a", "the", "é", "漢", "\n", "\t", "\0", "\U0001f600", " the", "ing", " ", "é", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ", "\r\n"]


def test_chunks_encode_as_the_whole_text_does():
    own, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(8)
    texts = ["".join(rng.choice(_ODD) for _ in range(rng.randrange(15))) for _ in range(3000)]
    words, before = P.chunks(pa.array(texts))
    for k, text in enumerate(texts):
        ids = [i for x in P.segmented(words.to_pylist()[before[k] : before[k + 1]], MODEL) for i in x]
        assert ids == own.encode(text)


@pytest.mark.parametrize(("block", "shard"), [(1 << 24, 200_000), (700, 20)])
def test_encoding_against_the_library(spark, block, shard):
    rng = random.Random(3)
    rows = S.texts() + [(200 + k, "".join(rng.choice(_ODD) for _ in range(rng.randrange(30)))) for k in range(60)] + [(300, " " * 5000), (301, "x" * 60_000), (300, " ")]
    df = P.encoded(S.documents(spark, rows), MODEL, block_bytes=block, shard_chunks=shard, keep_ids=True)
    assert S.rows_of(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == _pieces(rows)
    for r in df.collect():
        assert _hash(r["decoded"]) == r["decoded_sha256"] and len(r["ids"]) == r["n_tokens"]


def test_each_chunk_is_asked_once_a_block_and_segmented_once(spark, tmp_path):
    asked = list(P._asked(iter([next(P._blocks(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b a  b", "b a"])], names=["i", "t"])]), 1 << 20))]), 4))
    words = sorted(w for batch in asked for blob in batch.column(2).to_pylist() for w in P._unpacked(blob))
    assert words == [b" b", b"a", b"b"]


def test_encoding_of_empty_tables_and_texts(spark):
    assert P.encoded(S.documents(spark, []), MODEL).collect() == []
    assert S.rows_of(P.encoded(S.documents(spark, [(1, None), (1, ""), (None, None)]), MODEL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == _pieces([(1, None), (1, ""), (None, None)])


def _trie(rows: list[tuple]) -> list[tuple]:
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    said = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in said.items():
        base = c - (abs(c) % 5 * (1 if c >= 0 else -1))
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(said.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own_convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own_convs) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node], _hash(",".join(map(str, ends)))))
    return sorted(out, key=repr)


_TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, node string, depth long").repartition(3)


def _conversations(seed: int, n: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-30, 200), n):
        for t in range(rng.choice([1, 2, 3, 5, 12, 20])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hello", "hi", "é漢", "", None, f"t{rng.randrange(4)}"])))
    return rows


@pytest.mark.parametrize("held", [50_000, 3])
def test_trie_against_a_plain_one(spark, held):
    rows = _conversations(1, 120)
    rows += rows[:15] + [(None, 0, "user", "no conversation"), (7001, 0, "user", "x"), (1000, None, None, None)]
    rows += [(5000 + k, t, "user", f"same {t}") for k in range(40) for t in range(6)]
    got = S.rows_of(V.prefix_trie(_turns(spark, rows), held), *_TRIE)
    assert got == _trie(rows)


def test_trie_of_very_long_shared_conversations(spark):
    rows = [(c, t, "user", f"turn {t}" if t < 290 or c % 2 else f"own {c} {t}") for c in (0, 5, 10, 11) for t in range(300)]
    assert S.rows_of(V.prefix_trie(_turns(spark, rows)), *_TRIE) == _trie(rows)


def test_trie_with_turnless_conversations_and_of_nothing(spark):
    absent = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(absent, 0, "user", "replaced")]
    got = S.rows_of(V.prefix_trie(_turns(spark, rows)), *_TRIE)
    assert got == _trie(rows) == [(absent, 0, None, 1, 0, 1, 0, _hash(str(absent)))]
    assert V.prefix_trie(_turns(spark, [])).collect() == []


def test_ids_of_a_node_in_many_pieces(spark):
    rows = [(bytes([k % 3]) * 16, k - 50) for k in range(200)] + [(b"z" * 16, 4)]
    df = spark.createDataFrame(rows, "node binary, conv_id long").repartition(5)
    got = {bytes(r["node"]): r["ends_sha256"] for r in V.ends_digests(df, most=7).collect()}
    want = {n: _hash(",".join(str(c) for c in sorted(c for m, c in rows if m == n))) for n, _ in rows}
    assert got == want


def test_new_queries_are_registered():
    assert {"op11_merkle_manifest", "op12_sentencepiece", "op13_conversation_trie"} <= set(Q.QUERIES) and {"op11_merkle_manifest", "op13_conversation_trie"} <= set(Q.ORACLES)

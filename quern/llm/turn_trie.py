"""A trie of conversation prefixes, merged by families first.

Conversations of one base id are a family: each is rebuilt from the first turns of the base and its
own later ones, and the family's small trie is built where its rows meet. A node is named by a chain
of SHA-256 digests over roles and texts, so texts never travel. Only combined family nodes, one for
each node and family, are shuffled to be merged with those of all other families.

Rows are dealt by base id and sorted, the base before the others, and stream past: a task keeps the
first turns of the base, the chain of one conversation, and the nodes of one family up to
`HELD_NODES`, beyond which parts of them are sent on; merging adds parts up. So a conversation of
any length takes bounded memory, though one task. Sums over subtrees are made by doubling on nodes
with several members: in each round a node's sums go to its ancestor twice as far off, so a prefix
of d turns takes log2(d) rounds. Nodes with one member are a plain chain and need none. Lists of
ids are cut in pieces where they are sorted; the pieces of a node then stream through its digest.

Cases: a null role or text counts as empty; a null turn comes first; turns of equal number follow in
order of their digest, so that rows that repeat are turns of their own; rows without a conv_id belong
to no conversation; a conversation all of whose turns are replaced and whose base is absent has no
turn and ends at the root; an empty table has no node at all; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import dropped, written

FAMILY = 5
MOST_SHARED = 9
HELD_NODES = 50_000
PIECE_IDS = 20_000
ROOT = bytes(16)
_NODE = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("size", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends", pa.list_(pa.int64()))])


def shared_turns(conv_id: int) -> int:
    """How many of its first turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % MOST_SHARED


def _sent(nodes: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*nodes, strict=True)) or [()] * len(_NODE)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE, strict=True)], schema=_NODE)


def family_tries(batches: Iterator[pa.RecordBatch], held: int = HELD_NODES) -> Iterator[pa.RecordBatch]:
    """Rows (base, conv_id, digest, size) come sorted by base, the base's own first, then by conversation and turn; nodes of their families leave."""
    base = conv = node = None
    start: list[tuple[bytes, int]] = []
    at = depth = skipped = 0
    nodes: dict[bytes, list] = {}
    done: list[tuple] = []

    def visit(name: bytes, parent: bytes | None, deep: int, size: int) -> None:
        if own := nodes.get(name):
            own[3] = min(own[3], conv)
            own[4] += 1
        else:
            nodes[name] = [parent, deep, size, conv, 1, []]

    def step(digest: bytes, size: int) -> None:
        nonlocal node, depth
        parent, depth = node, depth + 1
        node = hashlib.sha256(parent + digest).digest()[:16]
        visit(node, parent, depth, size)

    def ended() -> None:
        """The conversation ends where it stands; its node is held still, as only whole conversations are sent on."""
        if conv is not None:
            if node not in nodes:
                nodes[node] = [None, depth, 0, conv, 0, []]
            nodes[node][5].append(conv)

    for batch in batches:
        for new_base, new_conv, digest, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if new_conv != conv or new_base != base:
                ended()
                if new_base != base:
                    done += ((n, *v) for n, v in nodes.items())
                    nodes, start, base = {}, [], new_base
                    if len(done) >= held:
                        yield _sent(done)
                        done = []
                conv, node, at, depth = new_conv, ROOT, 0, 0
                skipped = 0 if conv == base else shared_turns(conv)
                visit(ROOT, None, 0, 0)
                for turn in start[:skipped]:
                    step(*turn)
            at += 1
            if conv == base and at < MOST_SHARED:
                start.append((digest, size))
            if at > skipped:
                step(digest, size)
            if len(nodes) >= held:
                yield _sent([(n, *v) for n, v in nodes.items()])
                nodes = {}
    ended()
    yield _sent(done + [(n, *v) for n, v in nodes.items()])


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, conv_id) come sorted; the ids of a node leave in pieces of text."""
    names = ["node", "first", "ids"]

    def sent(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1][0] for o in out], pa.int64()), pa.array([",".join(map(str, o[1])) for o in out], pa.string())], names=names)

    out: list = []
    held = 0
    for batch in batches:
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if out and out[-1][0] == node and len(out[-1][1]) < most:
                out[-1][1].append(conv)
            else:
                if held >= most:
                    yield sent(out)
                    out, held = [], 0
                out.append((node, [conv]))
            held += 1
    yield sent(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (node, first, ids) come sorted; the digest of each node's ids leaves."""
    now, state = None, None
    for batch in batches:
        nodes, sums = [], []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if node == now:
                state.update(b",")
            else:
                if now is not None:
                    nodes.append(now)
                    sums.append(state.hexdigest())
                now, state = node, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sums, pa.string())], names=["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def ends_digests(ends: DataFrame, most: int = PIECE_IDS) -> DataFrame:
    """(node, ends_sha256): the digest of the ids of each node of `ends` (node, conv_id), ascending, joined by commas.

    Ids are dealt in ranges, so a node at which very many conversations end is spread; what meets in
    one task for it is a row for each `most` ids.
    """
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(lambda b: _pieces(b, most), "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """`nodes` (node, up, sums...) with each sum taken over the node's subtree; up names the parent, null above the top.

    In round k a node knows its ancestor 2^k above and the sums of its descendants nearer than that.
    """
    held = written(nodes.select("node", "up", *sums), "sums")
    while held.where("up IS NOT NULL").limit(1).count():
        gain = held.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(*(F.sum(s).alias(f"_{s}") for s in sums))
        grown = held.join(gain, "node", "left").select("node", "up", *((F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums))
        above = held.where("up IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("_next"))
        far = grown.where("up IS NOT NULL").join(above, "up", "left").select("node", F.col("_next").alias("up"), *sums)
        after = written(grown.where("up IS NULL").unionByName(far), "sums")
        dropped(held)
        held = after
    return held.drop("up")


def prefix_trie(conversations: DataFrame, held: int = HELD_NODES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node) for each node."""
    role, text, conv = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("conv_id").cast("long")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id IS NOT NULL").select((conv - conv % FAMILY).alias("base"), conv.alias("conv_id"), F.col("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = rows.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest")
    own = written(rows.select("base", "conv_id", "digest", "size").mapInArrow(lambda b: family_tries(b, held), "node binary, parent binary, depth long, size long, conv_id long, n_convs long, ends array<long>"), "families")
    ends = ends_digests(own.select("node", F.explode("ends").alias("conv_id")))
    merged = own.groupBy("node").agg(F.min("parent").alias("parent"), F.max("depth").alias("depth"), F.max("size").alias("size"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    merged = written(merged, "nodes")
    below = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    nodes = merged.join(below, "node", "left").select(merged["*"], F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.coalesce("alone", F.lit(0)) + F.isnull("n_children").cast("long")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    nodes = written(nodes, "nodes")
    # The root is above all nodes, so it takes part in neither joins nor rounds.
    root = nodes.where("depth = 0").first()
    several = nodes.where("n_convs > 1 AND depth > 0").select("node", F.when(F.col("depth") > 1, F.col("parent")).alias("up"), "n_leaves", "saved_tokens")
    sums = subtree_sums(several, ["n_leaves", "saved_tokens"])
    whole = nodes.where("depth = 0 OR n_convs > 1").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")).first()
    top = sums.sparkSession.createDataFrame([(ROOT, whole[0] or 0, whole[1] or 0)], sums.schema)
    sums = sums.unionByName(top).withColumnsRenamed({"n_leaves": "_leaves", "saved_tokens": "_saved"})
    nodes = nodes.join(sums, "node", "left").join(ends, "node", "left")
    nodes = nodes.select("node", "parent", "conv_id", "depth", "n_convs", "n_children", F.coalesce("_leaves", "n_leaves").alias("n_leaves"), F.coalesce("_saved", "saved_tokens").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    parents = merged.where("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(parents, "parent", "left")
    high = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root["conv_id"] if root else None).cast("long")))
    return high.unionByName(deep).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node")

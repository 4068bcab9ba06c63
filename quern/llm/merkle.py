"""A Merkle manifest of a table: a digest for each row, group and the whole, and a proof for each row.

Leaves are numbered within their group, and level by level the children of a node meet in one group
of at most `fanout` rows, whose sorted digests are hashed into the parent. The roots of the groups
are the leaves of one more tree. Proofs go the other way: on each level a node joins its parent and
puts its own siblings before the parent's, so all levels together move about twice the rows of the
last one, and no join has more than `fanout` rows of a key.

Rows are numbered without a window over a group: the table is dealt in ranges and sorted, each task
numbers its own rows, and the counts of (range, group) before a task are added. A group that holds
most rows is spread over many ranges, and only digests travel, never texts.

Cases: any field may be null and is then the text `-`; a null group is one, before all others; rows
that share an id follow in order of their leaf; rows that repeat are leaves of their own with the
same digest; a null id is never tampered with; an empty table gives no rows and has no root; columns
that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import dropped, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Counts of (range, group) are broadcast up to this size; beyond it they are joined by shuffle.
BROADCAST_BYTES = 16 << 20
_KEY_BYTES = 32
#: Levels of proofs in one plan.
CUT = 4


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_digest(*parts: Column) -> Column:
    """The SHA-256 of texts laid end to end, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def field(value: Column) -> Column:
    """A value with its length before it, so that different rows never give the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` as a written table, with ix, the place of each among those of its group from 0, and n, their number."""
    by = [group, *order, "_tie"]
    rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = written(rows.drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_at", at), "ranges")
    parts = dealt.groupBy("_part", group).agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    every, before = Window.partitionBy(group), Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).withColumn("n", F.sum("_rows").over(every)).drop("_low", "_rows"), "counts")
    size = parts.agg(F.sum(F.octet_length(group) + F.lit(_KEY_BYTES))).first()[0] or 0
    return dealt.join(F.broadcast(parts) if size <= BROADCAST_BYTES else parts, ["_part", group]).withColumn("ix", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def levels(leaves: DataFrame, group: str, fanout: int) -> list[DataFrame]:
    """Written tables (group, ix, n, digest, kids), one for each level: the leaves, their parents, and so on.

    n counts the nodes of the group on the level; a group ends on the level where n is 1. kids are
    the digests from which the node was made.
    """
    out = [written(leaves.withColumn("kids", F.lit(None).cast("array<binary>")), "level")]
    most = out[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = out[-1].where("n > 1")
        own = F.struct("ix", "digest")
        up = below.groupBy(group, F.expr(f"ix div {fanout}").alias("ix"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")).agg(F.sort_array(F.collect_list(own)).alias("kids"))
        up = up.withColumn("kids", F.transform("kids", lambda k: k["digest"]))
        up = up.withColumn("digest", joined_digest(F.array_join(F.transform("kids", hexed), "")))
        out.append(written(up.select(group, "ix", "n", "digest", "kids"), "level"))
        most = -(-most // fanout)
    return out


def _siblings(kids: Column, at: Column) -> Column:
    """The texts before and after a child's own in what its parent was made from."""
    before, after = F.slice(kids, 1, at), F.slice(kids, at + 2, F.size(kids))
    return F.struct(*(F.unhex(F.array_join(F.transform(side, hexed), "")).alias(name) for side, name in ((before, "left"), (after, "right"))))


def proofs(tree: list[DataFrame], tops: DataFrame, group: str, fanout: int) -> DataFrame:
    """The leaves of `tree` with the path of siblings up to the root; tops: (group, path, subroot) of each group's last node.

    A table is written every `CUT` levels and dropped once the next is there.
    """
    paths, held = None, None
    for height in range(len(tree) - 1, -1, -1):
        level = tree[height]
        ends = level.where("n = 1").join(tops, group)
        if paths is None:
            both = ends
        else:
            above = paths.select(group, F.col("ix").alias("_up"), F.col("kids").alias("_kids"), "path", "subroot")
            found = level.where("n > 1").withColumn("_up", F.expr(f"ix div {fanout}")).join(above, [group, "_up"])
            at = (F.col("ix") % fanout).cast("int")
            found = found.withColumn("path", F.concat(F.array(_siblings(F.col("_kids"), at)), F.col("path"))).drop("_up", "_kids")
            both = ends.unionByName(found)
        if height and height % CUT == 0:
            both = written(both, "paths")
            if held is not None:
                dropped(held)
            held = both
        paths = both
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings, as hex text."""
    return F.aggregate(path, hexed(leaf), lambda own, s: F.sha2(F.concat(hexed(s["left"]), own, hexed(s["right"])).cast("binary"), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", tampered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, subroot, root, path, proof_sha256, folded_root, verified) for each row of `docs`.

    tampered: other values of fields, to be told apart from the stored ones: folded_root then follows
    from the leaf of these and the stored siblings, and verified tells whether it is the root. The
    path holds left and right siblings of each level, from the leaf up.
    """
    leaf = joined_digest(*(field(F.col(f)) for f in fields))
    other = joined_digest(*(field((tampered or {}).get(f, F.col(f))) for f in fields)) if tampered else F.lit(None).cast("binary")
    # A group's text after a mark, so that null comes first and joins like any other.
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), group.alias("part"), leaf.alias("digest"), other.alias("other"))
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other")))
    leaves = numbered(rows, "part", ["id", "digest", "other"])
    tree = levels(leaves.drop("id", "other"), "part", fanout)
    kept = written(leaves.select("part", "ix", "id", "other"), "leaves")
    ends = tree[0].where("n = 1").select("part", "digest")
    for level in tree[1:]:
        ends = ends.union(level.where("n = 1").select("part", "digest"))
    tops = numbered(ends.withColumn("whole", F.lit("")), "whole", ["part", "digest"])
    crown = levels(tops.select("whole", "ix", "n", "digest"), "whole", fanout)
    named = tops.select("ix", "part")
    root = crown[-1].where("n = 1").select("digest").first()
    start = crown[0].sparkSession.createDataFrame([("",)], "whole string").select("whole", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    over = proofs(crown, start, "whole", fanout).join(named, "ix").select("part", "path", F.col("digest").alias("subroot"))
    found = proofs(tree, written(over, "subroots"), "part", fanout).select("part", "ix", "digest", "path", "subroot").join(kept, ["part", "ix"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), "")
    root = F.lit(root["digest"] if root else None).cast("binary")
    out = found.select("id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(root).alias("root"), "path", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded(F.coalesce("other", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

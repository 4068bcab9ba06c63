"""What changed between two versions of a set of units, by external declarations.

Units whose source is the same in both versions are never lexed. Of the others each declaration gets
a digest of its tokens, an aggregate without an order that holds no tokens; blanks, comments and
places don't count. Declarations with one digest in a unit are matched copy by copy. Those that are
then left and whose digest is unique on both sides moved to another unit; those that declare a name
in both versions changed; the rest were added or removed.

Which matched declarations moved within their unit is a heaviest rising sequence. Runs that lie side
by side in both versions are blocks, and blocks at the same rank before the first difference or
after the last one go first, so that a unit's blocks are about three for each move, whatever its size.

A source that is null or empty has no declarations. Digests have 128 bits, as much as two hashes
tell apart. Null unit_ids are one unit.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.program import Program
from ..sources.tables import dropped, written
from .declarations import in_declaration, symbols, tags

_SIDES = ("old", "new")


def changed_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """The unit_ids whose sources differ between `old` and `new` (unit_id, src), or that only one has; sources travel as digests only."""
    both = old.select("unit_id", "src", F.lit(0).alias("side")).union(new.select("unit_id", "src", F.lit(1).alias("side")))
    both = both.select("unit_id", "side", *(F.xxhash64("src", F.lit(k)).cast("decimal(20,0)").alias(f"h{k}") for k in (0, 1)))
    figures = both.groupBy("unit_id", "side").agg(F.struct(F.count("*"), F.sum("h0"), F.sum("h1")).alias("x"))
    pair = figures.groupBy("unit_id").agg(*(F.max(F.when(F.col("side") == k, F.col("x"))).alias(s) for k, s in enumerate(_SIDES)))
    return pair.where("NOT old <=> new").select("unit_id")


def declared(marked: DataFrame) -> DataFrame:
    """(unit_id, decl_ix, decl_kind, name, digest, n_tokens) of each declaration; name is the first that it declares: a symbol, else a tag, else a macro, else null."""
    place = F.row_number().over(in_declaration())
    rows = marked.where("tname <> 'PP_NEWLINE'").withColumn("_at", place)
    macro = F.when((F.col("_at") == 3) & (F.col("prev") == "define"), F.col("src"))
    rows = rows.groupBy("unit_id", "decl_ix").agg(
        F.first("decl_kind").alias("decl_kind"), F.bit_xor(F.xxhash64("src", "_at")).alias("_a"), F.bit_xor(F.xxhash64("_at", "src", F.lit(1))).alias("_b"), F.count("*").alias("n_tokens"), F.max(macro).alias("_macro"),
    )
    named = symbols(marked).select("unit_id", "decl_ix", F.struct(F.lit(0).alias("rank"), "tok_ix", "name").alias("x"))
    tagged = tags(marked).where("tag_name IS NOT NULL").select("unit_id", "decl_ix", F.struct(F.lit(1).alias("rank"), "tok_ix", F.col("tag_name").alias("name")).alias("x"))
    first = named.union(tagged).groupBy("unit_id", "decl_ix").agg(F.min("x").alias("x")).select(F.col("unit_id").alias("_unit"), F.col("decl_ix").alias("_decl"), F.col("x.name").alias("_name"))
    found = rows.join(first, F.col("unit_id").eqNullSafe(F.col("_unit")) & (F.col("decl_ix") == F.col("_decl")), "left")
    return found.select("unit_id", "decl_ix", "decl_kind", F.coalesce("_name", F.when(F.col("decl_kind") == "directive", F.col("_macro"))).alias("name"), F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"), "n_tokens").alias("digest"))


def _paired(rows: DataFrame, *by: str | Column) -> DataFrame:
    """(old, new) for the first with the first, the second with the second and so on of the rows of both sides with equal `by`, in order of decl_ix; null where one side has no more."""
    keyed = rows.withColumns({f"_k{n}": F.col(c) if isinstance(c, str) else c for n, c in enumerate(by)})
    keys = [f"_k{n}" for n in range(len(by))]
    keyed = keyed.repartition(*keys)
    nth = F.row_number().over(Window.partitionBy(*keys, "side").orderBy("decl_ix"))
    row = F.struct(*rows.columns)
    sides = [F.max(F.when(F.col("side") == k, row)).alias(s) for k, s in enumerate(_SIDES)]
    return keyed.withColumn("_nth", nth).groupBy(*keys, "_nth").agg(*sides).select(*_SIDES)


def _moved(new_ranks: list[int], weights: list[int]) -> list[bool]:
    """Which blocks, in order of their old ranks, are outside the heaviest sequence that rises in both versions.

    What ends a sequence best is kept as lists that rise in rank and in weight. Of equally heavy
    sequences the one found first stays.
    """
    ranks, sums, ends, before = [], [], [], []
    for k, (rank, weight) in enumerate(zip(new_ranks, weights, strict=True)):
        at = bisect_left(ranks, rank)
        before.append(ends[at - 1] if at else -1)
        total = weight + (sums[at - 1] if at else 0)
        stop = at
        while stop < len(sums) and sums[stop] <= total:
            stop += 1
        ranks[at:stop], sums[at:stop], ends[at:stop] = [rank], [total], [k]
    moved, k = [True] * len(new_ranks), ends[-1] if ends else -1
    while k >= 0:
        moved[k], k = False, before[k]
    return moved


def _moved_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit_id, block) of the blocks that moved; rows come sorted by unit and old rank, and one unit's blocks are held at a time."""
    unit, held, schema = None, [], None

    def found() -> pa.RecordBatch:
        moved = _moved([h[1] for h in held], [h[2] for h in held])
        out = [h[0] for h, m in zip(held, moved, strict=True) if m]
        return pa.RecordBatch.from_arrays([pa.array([unit] * len(out), schema.field(0).type), pa.array(out, pa.int64())], names=["_unit", "_moved"])

    for batch in batches:
        schema = batch.schema
        for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and own != unit:
                yield found()
                held = []
            unit = own
            held.append(row)
    if held:
        yield found()


def in_order(matched: DataFrame) -> DataFrame:
    """`matched` (unit_id, old_ix, new_ix, ...) with `moved`: whether a declaration stands at another place among those of its unit that are in both versions."""
    unit = Window.partitionBy("unit_id")
    ranked = matched.withColumn("_new", F.row_number().over(unit.orderBy("new_ix"))).withColumn("_old", F.row_number().over(unit.orderBy("old_ix")))
    apart = F.when(F.col("_old") != F.col("_new"), F.col("_old"))
    ranked = ranked.withColumns({"_first": F.min(apart).over(unit), "_last": F.max(apart).over(unit)})
    inner = F.coalesce(F.col("_old").between(F.col("_first"), F.col("_last")), F.lit(False))
    by_old = unit.orderBy("_old")
    begins = F.coalesce(F.lag("_new").over(by_old) + 1 != F.col("_new"), F.lit(True)) | (F.col("_old") == F.col("_first"))
    ranked = ranked.withColumn("_block", F.when(inner, F.sum(begins.cast("int")).over(by_old)))
    ranked = written(ranked.drop("_first", "_last"), "ranked")
    blocks = ranked.where("_block IS NOT NULL").groupBy("unit_id", "_block").agg(F.min("_old").alias("old_rank"), F.min("_new").alias("new_rank"), F.count("*").alias("weight"))
    dealt = blocks.repartition("unit_id").sortWithinPartitions("unit_id", "old_rank").select("unit_id", "_block", "new_rank", "weight")
    found = dealt.mapInArrow(_moved_blocks, f"_unit {matched.schema['unit_id'].dataType.simpleString()}, _moved long")
    joined = ranked.join(found, F.col("unit_id").eqNullSafe(F.col("_unit")) & (F.col("_block") == F.col("_moved")), "left")
    return joined.select(*matched.columns, F.col("_moved").isNotNull().alias("moved"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, old_unit, new_unit, name, decl_kind, old_ix, new_ix) for each declaration that is not as and where it was.

    old and new are the units (unit_id, src) of the two versions. change is moved (within its unit),
    moved_unit, changed, added or removed; the ordinals of the declaration and its unit are null on
    the side that lacks it.
    """
    ids = written(changed_units(old, new), "changed-units")
    # Both versions are lexed as one set of units.
    both = old.select(F.lit(0).alias("side"), "unit_id", "src").union(new.select(F.lit(1).alias("side"), "unit_id", "src"))
    both = both.join(ids.withColumnRenamed("unit_id", "_unit"), F.col("unit_id").eqNullSafe(F.col("_unit")), "left_semi")
    # A plain string as the key, since windows over structs sort slowly: the side, then : and the id where it isn't null.
    key = F.concat(F.col("side").cast("string"), F.coalesce(F.concat(F.lit(":"), F.col("unit_id").cast("string")), F.lit("")))
    program = Program(both.select(key.alias("unit_id"), "src"))
    unit = F.when(F.length("unit_id") > 1, F.expr("substring(unit_id, 3)")).cast(old.schema["unit_id"].dataType)
    rows = written(declared(program.kept).withColumns({"side": F.substring("unit_id", 1, 1).cast("int"), "unit_id": unit}), "declared")
    program.release()
    pairs = written(_paired(rows, "unit_id", "digest"), "paired")
    is_pair = F.col("old").isNotNull() & F.col("new").isNotNull()
    matched = pairs.where(is_pair).select("old.unit_id", F.col("old.decl_ix").alias("old_ix"), F.col("new.decl_ix").alias("new_ix"), "old.name", "old.decl_kind")
    moved = written(in_order(matched).where("moved"), "moved").select(F.lit("moved").alias("change"), F.col("unit_id").alias("old_unit"), F.col("unit_id").alias("new_unit"), "name", "decl_kind", "old_ix", "new_ix")
    left = pairs.where(~is_pair).select(F.coalesce("old", "new").alias("x")).select("x.*")
    sides_of = [F.max(F.when(F.col("side") == k, F.struct(*rows.columns))).alias(s) for k, s in enumerate(_SIDES)]
    unique = left.groupBy("digest").agg(*sides_of, F.count_if(F.col("side") == 0).alias("n_old"), F.count_if(F.col("side") == 1).alias("n_new")).where("n_old = 1 AND n_new = 1")
    unique = written(unique, "moved-units")
    left = left.join(unique.select("digest"), "digest", "left_anti").select(*rows.columns)
    # What declares no name is nobody's other version.
    own = F.when(F.col("name").isNull(), F.struct("side", "digest", "decl_ix"))
    rest = _paired(left, "unit_id", "decl_kind", "name", own)
    named = lambda df, change: df.select(
        change.alias("change"), F.col("old.unit_id").alias("old_unit"), F.col("new.unit_id").alias("new_unit"), F.coalesce("old.name", "new.name").alias("name"),
        F.coalesce("old.decl_kind", "new.decl_kind").alias("decl_kind"), F.col("old.decl_ix").alias("old_ix"), F.col("new.decl_ix").alias("new_ix"),
    )
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    found = written(moved.union(named(unique, F.lit("moved_unit"))).union(named(rest, kind)), "changes")
    for table in (ids, rows, pairs, unique):
        dropped(table)
    return found

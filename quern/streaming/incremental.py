"""Relations of a changing set of units: only units whose content changed are lexed again.

A store is a folder. Each batch writes one folder for each relation and one of a ledger with the
digest of each changed unit; the ledger is written last, so a batch that failed halfway counts for
nothing, and one that is run again replaces its own folders. What counts of a relation are the rows
that a unit's last batch wrote; older ones stay until the store is compacted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import declarations, inner
from ..plans.program import Program

Relation = Callable[[Program], DataFrame]
RELATIONS: dict[str, Relation] = {
    "tokens": lambda p: p.kept, "declarations": lambda p: declarations.declarations(p.kept), "symbols": lambda p: declarations.symbols(p.kept).drop("_parens", "_listed"), "calls": lambda p: inner.calls(p.full),
}


class Store:
    """The relations of all units that have been applied, in the folder `path`, which driver and executors share.

    A null source is a deleted unit. Of rows with one unit_id in a batch the last by `order` counts,
    and of those with the same the largest source. Batches have rising numbers; to apply one again
    gives the same store.
    """

    def __init__(self, spark: SparkSession, path: str, relations: dict[str, Relation] | None = None, order: str | None = None):
        self.spark, self.path, self.order = spark, path, order
        self.relations = RELATIONS if relations is None else relations

    def _folder(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def ledger(self, before: int | None = None) -> DataFrame | None:
        """(unit_id, digest, batch): the last entry of each unit, of batches before `before`; digest is null for a deleted one."""
        if not self._exists(f"{self.path}/ledger"):
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/ledger").parquet(f"{self.path}/ledger")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        last = rows.groupBy("unit_id").agg(F.max(F.struct(F.col("batch").cast("long").alias("batch"), "digest")).alias("x"))
        return last.select("unit_id", "x.digest", "x.batch")

    def apply(self, units: DataFrame, batch: int) -> None:
        """Brings the store up to `units` (unit_id, src); units that are not in it stay as they are."""
        ranks = [F.desc(self.order)] if self.order else []
        nth = F.row_number().over(Window.partitionBy("unit_id").orderBy(*ranks, F.desc_nulls_last("src")))
        units = units.withColumn("_nth", nth).where("_nth = 1").select("unit_id", "src", F.sha2(F.col("src").cast("binary"), 256).alias("digest"))
        known = self.ledger(before=batch)
        if known is not None:
            units = units.join(known.select("unit_id", F.col("digest").alias("_digest"), F.lit(True).alias("_known")), "unit_id", "left")
            units = units.where("_known IS NULL OR NOT digest <=> _digest").drop("_digest", "_known")
        staged = self._folder("changed", batch)
        units.write.mode("overwrite").parquet(staged)
        changed = self.spark.read.parquet(staged)
        program = Program(changed.where("src IS NOT NULL").select("unit_id", "src"))
        for name, relation in self.relations.items():
            relation(program).write.mode("overwrite").parquet(self._folder(name, batch))
        program.release()
        changed.select("unit_id", "digest").write.mode("overwrite").parquet(self._folder("ledger", batch))

    def relation(self, name: str) -> DataFrame:
        """The rows of a relation that count now."""
        rows = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        last = self.ledger().select("unit_id", "batch")
        return rows.withColumn("batch", F.col("batch").cast("long")).join(last, ["unit_id", "batch"], "left_semi").drop("batch")

    def compacted(self, path: str) -> Store:
        """A store in another folder with what counts of this one, as batch 0."""
        out = Store(self.spark, path, self.relations, self.order)
        for name in self.relations:
            self.relation(name).write.mode("overwrite").parquet(out._folder(name, 0))
        self.ledger().where("digest IS NOT NULL").select("unit_id", "digest").write.mode("overwrite").parquet(out._folder("ledger", 0))
        return out

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Applies what is there of a stream of units, then stops; batches go on from the checkpoint."""
        return stream.writeStream.foreachBatch(lambda units, batch: self.apply(units, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

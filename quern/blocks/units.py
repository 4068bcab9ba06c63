"""Relations of many units by blocks: whole units of about BLOCK characters at a time, in Python, each with the operators of quern.operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from . import tokens as T
from .facade import evaluated_here
from .frame import Frame

#: Characters of a block; and of a unit beyond which it is left to Spark's windows, whose sorts spill.
BLOCK, LARGE = 1 << 18, 1 << 21


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[str | None]]]]:
    """Units and their sources, from rows sorted by unit."""
    units: list = []
    sources: list[list[str | None]] = []
    size = 0
    for batch in batches:
        for unit, src in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if units and unit == units[-1]:
                sources[-1].append(src)
            else:
                if size > BLOCK:
                    yield units, sources
                    units, sources, size = [], [], 0
                units.append(unit)
                sources.append([src])
            size += len(src or "")
    if units:
        yield units, sources


def _arrow(found: Frame, units: list, schema: pa.Schema) -> pa.RecordBatch:
    words, arrays = pa.array(found.pool.words, pa.string()), []
    for field in schema:
        of = found.cols[field.name]
        null = ~of.valid()
        if of.kind == "null":
            arrays.append(pa.nulls(found.n, field.type))
        elif field.name == "unit_id":
            arrays.append(pa.array(units, field.type).take(pa.array(of.data)))
        elif of.kind == "word":
            arrays.append(words.take(pa.array(of.data, mask=null)).cast(field.type))
        else:
            arrays.append(pa.array(np.ascontiguousarray(of.data), mask=null).cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def of_blocks(units: DataFrame, relation: Callable[[Frame], Frame], schema: StructType) -> DataFrame:
    """`relation` of the tokens of units (unit_id, src), none of which is large, in the columns of `schema`."""
    spark = units.sparkSession
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with evaluated_here():
            for names, sources in _blocks(batches):
                found = relation(T.tokens(sources))
                if found.n:
                    yield _arrow(found, names, arrow)

    # By number, as tokens are many times as large as the sources that Spark would put together.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return units.select("unit_id", "src").repartition(n, "unit_id").sortWithinPartitions("unit_id", "src").mapInArrow(run, schema)


def with_unit(units: DataFrame, columns: str) -> StructType:
    """unit_id as the units have it, then the columns of a DDL string."""
    return StructType([StructField("unit_id", units.schema["unit_id"].dataType), *StructType.fromDDL(columns)])

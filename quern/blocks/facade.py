"""F and Window of the operators: Spark's functions over tables, or those of quern.blocks over a block within evaluated_here().

An operator is written once; which of the two it builds follows from where it is called.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import local

from pyspark.sql import Window as SparkWindow, functions as spark_functions

from . import expressions

_here = local()


@contextmanager
def evaluated_here() -> Iterator[None]:
    """Within it, operators that this thread calls take and give Frames."""
    before, _here.on = getattr(_here, "on", False), True
    try:
        yield
    finally:
        _here.on = before


class _Chosen:
    def __init__(self, by_spark: object, by_block: object):
        self._both = by_spark, by_block

    def __getattr__(self, name: str):
        return getattr(self._both[getattr(_here, "on", False)], name)


F = _Chosen(spark_functions, expressions)
Window = _Chosen(SparkWindow, expressions.Window)

"""Table functions for SQL: what a Python source holds, called laterally for each row.

``register`` makes them known to a session::

    SELECT f.path, c.name, c.first FROM files f, LATERAL source_parts(f.code, 'chunks') c

The second argument is a constant and decides the columns that come back.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import code

_TYPES = {"int": IntegerType(), "string": StringType()}
KINDS = {"chunks": code.chunks, "symbols": code.symbols, "imports": code.imports}


class SourceParts:
    """source_parts(source, what): a row for each of the chunks, symbols or imports of a source. A
    null source is an empty one; a broken one has a single symbol of kind syntax_error."""

    @staticmethod
    def analyze(source: AnalyzeArgument, what: AnalyzeArgument) -> AnalyzeResult:
        if not what.isConstantExpression or what.value not in KINDS:
            raise ValueError(f"the second argument must be one of {', '.join(KINDS)}")
        columns = (c.split() for c in code.SHAPES[KINDS[what.value]].split(", "))
        return AnalyzeResult(StructType([StructField(name, _TYPES[kind]) for name, kind in columns]))

    def eval(self, source: str | None, what: str) -> Iterator[tuple]:
        yield from KINDS[what](source or "")


def register(spark: SparkSession) -> None:
    """Make source_parts known to this session's SQL."""
    spark.udtf.register("source_parts", F.udtf(SourceParts))

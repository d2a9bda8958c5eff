"""Values drawn from JSON of unknown shape."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def values_of(key: str):
    """A function column -> array of the texts under ``key`` at any depth, in order; null for text
    that is no JSON."""

    def walk(x, out):
        if isinstance(x, dict):
            for k, v in x.items():
                if k == key and isinstance(v, str | int) and not isinstance(v, bool):
                    out.append(str(v))
                walk(v, out)
        elif isinstance(x, list):
            for v in x:
                walk(v, out)
        return out

    def one(text):
        try:
            return None if text is None else walk(json.loads(text), [])
        except ValueError:
            return None

    @F.arrow_udf(ArrayType(StringType()))
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([one(x) for x in texts.to_pylist()], pa.list_(pa.string()))

    return found

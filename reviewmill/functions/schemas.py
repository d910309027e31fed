"""Schemas without a session: the parser of DDL strings needs one."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType())}


def schema(text: str) -> T.StructType:
    """A schema from `name kind, ...`, kinds being those of _KINDS."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])

"""Types of flat rows, made without a session, so that modules can be imported before there is one."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType, "int": T.IntegerType, "double": T.DoubleType}


def row(fields: str) -> T.StructType:
    """A struct type from 'name kind, name kind'."""
    return T.StructType([T.StructField(n, _KINDS[k]()) for n, k in (f.split() for f in fields.split(","))])


def rows(fields: str) -> T.ArrayType:
    return T.ArrayType(row(fields))

"""Field type names, as a dataset inspector reports them."""

from __future__ import annotations

from pyspark.sql import types as T

# Reported type name for each Spark type.
SCALAR_NAMES = [
    (T.BooleanType, "Integer"),
    (T.ByteType, "Integer"),
    (T.ShortType, "Integer"),
    (T.IntegerType, "Integer"),
    (T.LongType, "Integer64"),
    (T.FloatType, "Real"),
    (T.DoubleType, "Real"),
    (T.DecimalType, "Real"),
    (T.StringType, "String"),
    (T.DateType, "Date"),
    (T.TimestampType, "DateTime"),
    (T.TimestampNTZType, "DateTime"),
    (T.BinaryType, "Binary"),
]


def field_type_name(dtype: T.DataType) -> str:
    """``Integer``, ``Integer64``, ``Real``, ``String`` …, with ``List`` for arrays of them."""
    if isinstance(dtype, T.ArrayType):
        inner = field_type_name(dtype.elementType)
        return f"{inner}List" if inner in ("Integer", "Integer64", "Real", "String") else "String"
    for kind, name in SCALAR_NAMES:
        if isinstance(dtype, kind):
            return name
    return "String"

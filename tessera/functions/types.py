"""Type names of the SQL dialect and of ``cast``, and the Spark types they mean."""

from __future__ import annotations

from pyspark.sql import types as T

#: Spark has no unsigned integers; each widens to the next type that holds it.
TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int": T.IntegerType(), "int64": T.LongType(), "long": T.LongType(), "bigint": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(), "float32": T.FloatType(), "double": T.DoubleType(), "float64": T.DoubleType(),
    "string": T.StringType(), "varchar": T.StringType(), "utf8": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(), "timestamp": T.TimestampType(),
}


def spark_type(kind: object) -> T.DataType:
    """A Spark type from a Spark type, an Arrow type or a name in any case."""
    if isinstance(kind, T.DataType):
        return kind
    found = TYPES.get(str(kind).lower())
    return found if found is not None else T.DataType.fromDDL(str(kind))

"""Field paths: dotted names whose parts may contain spaces, dashes or dots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quote_part(part: str) -> str:
    return "`" + part.replace("`", "``") + "`"


def split_path(path: str, df: DataFrame | None = None) -> list[str]:
    """Split ``a.b.c`` into parts; a top-level column whose own name contains a dot wins."""
    if df is not None and path in df.columns:
        return [path]
    return path.split(".")


def col_path(path: str, df: DataFrame | None = None) -> Column:
    """Column for a dotted path, quoting each part (``Dt Test``, ``subObj1.ex-state``)."""
    return F.col(".".join(quote_part(p) for p in split_path(path, df)))


def has_path(df: DataFrame, path: str) -> bool:
    from pyspark.sql.types import StructType

    parts = split_path(path, df)
    st = df.schema
    for p in parts:
        if not isinstance(st, StructType) or p not in st.fieldNames():
            return False
        st = st[p].dataType
    return True


def path_type(df: DataFrame, path: str):
    st = df.schema
    for p in split_path(path, df):
        st = st[p].dataType
    return st


def comparable(c: Column, dt) -> Column:
    """A form of the value that can be ordered and hashed: maps, at any depth, as their sorted entries."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def has_map(t):
        return isinstance(t, MapType) or isinstance(t, ArrayType) and has_map(t.elementType) \
            or isinstance(t, StructType) and any(has_map(f.dataType) for f in t.fields)

    if not has_map(dt):
        return c
    if isinstance(dt, MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(
            comparable(e["key"], dt.keyType).alias("key"), comparable(e["value"], dt.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(dt, ArrayType):
        return F.transform(c, lambda x: comparable(x, dt.elementType))
    return F.when(c.isNotNull(), F.struct(*[comparable(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields]))


def descending(c: Column, dt) -> Column:
    """A value that sorts ascending as ``c`` sorts descending."""
    from pyspark.sql import types as T

    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.bitwise_not(c)  # unlike the negative it exists for the smallest value too
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return -c
    if isinstance(dt, T.BooleanType):
        return ~c
    if isinstance(dt, T.DateType):
        return -F.unix_date(c)
    if isinstance(dt, T.TimestampType):
        return -F.unix_micros(c)
    if isinstance(dt, T.TimestampNTZType):
        return F.expr("timestamp_ntz'1970-01-01 00:00:00'") - c
    # text: complement of its bytes, closed by a sign above all of them so that prefixes sort last
    return F.concat(F.translate(F.hex(F.encode(c.cast("string"), "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))

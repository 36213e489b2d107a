"""Encodings ("engrams"): declared field lists <-> Spark ``StructType``, and applying one to data.

An engram is ``{"name", "smt", "fields"}`` where ``fields`` may be spelled as a list of field
objects, an object keyed by name, or name -> type string (mixable). Field properties: name,
type, size, nullable, default, key (legacy ``isKey``), label, description; ``map`` fields nest
``fields``, ``list`` fields give their element under ``_list``.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce
from ..functions.paths import quote_part
from ..operators.geometry import GEOMETRY

# Engram type names and their Spark types.
_SCALAR = {
    "keyword": T.StringType(),
    "text": T.StringType(),
    "string": T.StringType(),
    "unknown": T.StringType(),
    "variable": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.TimestampType(),
}
_FIELD_PROPS = ["name", "type", "size", "nullable", "default", "key", "label", "description"]


def load_engram(src) -> dict:
    """Accept a dict, a JSON string or a path to a ``.engram.json`` file."""
    if isinstance(src, dict):
        return copy.deepcopy(src)
    if isinstance(src, str) and src.lstrip().startswith("{"):
        return json.loads(src)
    with open(src, encoding="utf-8") as fh:
        return json.load(fh)


def normalize_fields(fields) -> list[dict]:
    """Any of the three ``fields`` spellings -> list of field dicts with lower-case types."""
    out = []
    items = fields.items() if isinstance(fields, dict) else [(None, f) for f in (fields or [])]
    for name, f in items:
        if isinstance(f, str):
            f = {"type": f}
        f = dict(f)
        if name is not None:
            f.setdefault("name", name)
        f.setdefault("name", f"_c{len(out)}")  # a list of bare types names its fields by position
        f["type"] = str(f.get("type", "unknown")).lower()
        if "isKey" in f and "key" not in f:
            f["key"] = 1 if f.pop("isKey") else 0
        if isinstance(f.get("size"), str):
            f["size"] = int(f["size"]) if f["size"].strip().isdigit() else 0
        if f["type"] == "map" and f.get("fields"):
            f["fields"] = normalize_fields(f["fields"])
        if f["type"] == "list" and isinstance(f.get("_list"), (dict, str)):
            f["_list"] = normalize_fields([f["_list"] if isinstance(f["_list"], dict) else {"type": f["_list"]}])[0]
        out.append(f)
    return out


def field_type(f: dict) -> T.DataType:
    t = f["type"]
    if t in _SCALAR:
        return _SCALAR[t]
    if t == "geometry":
        return GEOMETRY
    if t == "map":
        if f.get("fields"):
            return to_struct(f["fields"])
        return T.MapType(T.StringType(), T.StringType())
    if t == "list":
        return T.ArrayType(field_type(f["_list"]) if f.get("_list") else T.StringType())
    raise ValueError(f"unknown field type {t!r}")


def to_struct(engram_or_fields) -> T.StructType:
    """Engram (or its fields) -> StructType; engram properties are kept as column metadata."""
    fields = engram_or_fields.get("fields") if isinstance(engram_or_fields, dict) and "fields" in engram_or_fields \
        else engram_or_fields
    st = T.StructType()
    for f in normalize_fields(fields):
        meta = {k: f[k] for k in ("type", "size", "default", "key", "label", "description") if f.get(k) is not None}
        st.add(T.StructField(f["name"], field_type(f), bool(f.get("nullable", True)), metadata=meta))
    return st


def type_name(dt: T.DataType, meta: dict | None = None) -> str:
    if meta and meta.get("type") in _SCALAR:
        return meta["type"]
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "number"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(dt, (T.StructType, T.MapType)):
        return "map"
    if isinstance(dt, T.ArrayType):
        return "list"
    return "unknown"


def from_struct(st: T.StructType, name: str | None = None) -> dict:
    """StructType -> engram (the ``schema encoding`` operator)."""

    def fld(sf_name, dt, nullable, meta):
        f = {"name": sf_name, "type": type_name(dt, meta)}
        for k in ("size", "default", "key", "label", "description"):
            if meta and meta.get(k) is not None:
                f[k] = meta[k]
        if not nullable:
            f["nullable"] = False
        if isinstance(dt, T.StructType):
            f["fields"] = [fld(s.name, s.dataType, s.nullable, s.metadata) for s in dt.fields]
        if isinstance(dt, T.ArrayType):
            f["_list"] = fld("_list", dt.elementType, True, {})
        return f

    out = {"type": "engram", "fields": [fld(s.name, s.dataType, s.nullable, s.metadata) for s in st.fields]}
    if name:
        out["name"] = name
    return out


# --- applying an encoding ------------------------------------------------------------------

def text_shape(dt: T.DataType) -> T.DataType:
    """The same shape with every scalar as text."""
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, text_shape(f.dataType), True) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(text_shape(dt.elementType))
    if isinstance(dt, T.MapType):
        return T.MapType(T.StringType(), text_shape(dt.valueType))
    return T.StringType()


def coerce_to(c: Column, src: T.DataType, f: dict) -> Column:
    """Convert a column of type ``src`` to field ``f``'s type with tolerant parsing."""
    t = f["type"]
    if t in ("keyword", "text", "string", "unknown", "variable"):
        if isinstance(src, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c)
        if isinstance(src, (T.TimestampType, T.TimestampNTZType)):
            return coerce.iso_utc(c)
        return coerce.number_text(c) if isinstance(src, (T.DoubleType, T.FloatType)) else c.cast("string")
    if t == "integer":
        if isinstance(src, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.when(c == F.floor(c), c.try_cast("bigint"))  # whole values only, at any size
        return c.cast("bigint") if isinstance(src, (T.NumericType, T.BooleanType)) else coerce.to_integer(c)
    if t == "number":
        return c.cast("double") if isinstance(src, T.NumericType) else coerce.to_number(c)
    if t == "boolean":
        return c if isinstance(src, T.BooleanType) else coerce.to_boolean(c)
    if t == "date":
        if isinstance(src, (T.TimestampType, T.DateType)):
            return c.cast("timestamp")
        if isinstance(src, T.TimestampNTZType):
            # a zone-less timestamp is read as UTC wall clock
            return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")
        return coerce.to_timestamp(c)
    if t == "map" and f.get("fields"):
        if isinstance(src, T.StringType):
            # read as text first, so that tolerant parsing applies inside as it does outside
            shape = text_shape(to_struct(f["fields"]))
            return coerce_to(F.from_json(c, shape), shape, f)
        if isinstance(src, T.StructType):
            names = src.fieldNames()
            parts = []
            for sub in normalize_fields(f["fields"]):
                if sub["name"] in names:
                    parts.append(coerce_to(c.getField(sub["name"]), src[sub["name"]].dataType, sub).alias(sub["name"]))
                else:
                    parts.append(F.lit(sub.get("default")).cast(field_type(sub)).alias(sub["name"]))
            return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*parts))
    if t == "list" and f.get("_list"):
        if isinstance(src, T.ArrayType):
            return F.transform(c, lambda x: coerce_to(x, src.elementType, f["_list"]))
        if isinstance(src, T.StringType):
            shape = text_shape(field_type(f))
            return coerce_to(F.from_json(c, shape), shape, f)
    if t == "geometry":
        return c
    return c.cast(field_type(f))


def apply_engram(df: DataFrame, engram, missing_value: str | None = None, keep: tuple = ()) -> DataFrame:
    """Cast every declared field, fill ``default``s, order columns as declared and keep only
    declared fields (and ``keep``). Absent fields become their default (or null). One projection, no UDF."""
    eng = load_engram(engram) if not isinstance(engram, list) else {"fields": engram}
    fields = normalize_fields(eng["fields"])
    src = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in fields:
        target = field_type(f)
        if f["name"] in src:
            c = F.col(quote_part(f["name"]))
            if missing_value is not None and isinstance(src[f["name"]], T.StringType):
                c = coerce.missing_to_null(c, missing_value)
            c = coerce_to(c, src[f["name"]], f)
        else:
            c = F.lit(None).cast(target)
        if f.get("default") is not None:
            c = F.coalesce(c, F.lit(f["default"]).cast(target))
        cols.append(c.cast(target).alias(f["name"]) if not isinstance(target, (T.StructType, T.ArrayType, T.MapType))
                    else c.alias(f["name"]))
    return df.select(*cols, *[F.col(quote_part(c)) for c in keep if c in df.columns])


def key_fields(engram) -> list[str]:
    """Names of fields marked ``key`` (in key order)."""
    fields = normalize_fields(load_engram(engram)["fields"])
    keyed = [(f.get("key"), f["name"]) for f in fields if f.get("key")]
    return [n for _, n in sorted(keyed, key=lambda x: int(x[0]))]

"""The pattern language: ``match`` / ``drop`` predicates, ``order`` and ``count``.

A pattern is a dict ``{field: condition}``; conditions on several fields are AND-ed, and several
operators on one field form a range (also AND). Comparison with null is false everywhere, so a
row whose field is null is neither matched nor dropped (``{"f": None}`` asks for nulls explicitly). Every predicate is a plain
Column expression: it stays in codegen and Catalyst pushes comparisons into the parquet scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType

from ..functions.paths import col_path, has_path, path_type

# The comparison operators of the pattern language.
_COMPARE = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}

# Token boundaries for full-text search: anything that is not a letter or a digit.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def search_tokens(text: str) -> list[str]:
    """Lower-cased tokens of a query string, split on non letters/digits (order kept, unique)."""
    import unicodedata

    letters = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower())
    return list(dict.fromkeys(letters.split()))


def search_predicate(c: Column, text: str) -> Column:
    """True when any query token equals a token of the field, case-insensitively.

    Implemented as one anchored regex on the lower-cased text instead of splitting it into an
    array: the same answer as ``arrays_overlap(split(lower(c)), tokens)`` without allocating a
    token array per row, which matters for documents of 20k words.
    """
    toks = search_tokens(text)
    if not toks:
        return F.lit(False)
    low = F.lower(c.cast("string"))
    # plain substring tests first: most rows fail them and never reach the regex engine
    maybe = low.contains(toks[0])
    for t in toks[1:]:
        maybe = maybe | low.contains(t)
    alt = "|".join(re.escape(t) for t in toks)
    return maybe & low.rlike(r"(?<![\p{L}\p{N}])(?:" + alt + r")(?![\p{L}\p{N}])")


def wildcard_like(pattern: str) -> str:
    """``foo_schema*`` -> SQL LIKE ``foo\\_schema%``; ``?`` is one character."""
    out = []
    for ch in pattern:
        if ch in ("\\", "%", "_"):
            out.append("\\" + ch)
        elif ch == "*":
            out.append("%")
        elif ch == "?":
            out.append("_")
        else:
            out.append(ch)
    return "".join(out)


def glob_regex(glob: str) -> str:
    """File-name glob (``*``, ``?``; everything else literal) as an anchored regex."""
    out = []
    for ch in glob:
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        else:
            out.append(re.escape(ch))
    return "^" + "".join(out) + "$"


def glob_match(c: Column, glob: str) -> Column:
    return c.rlike(glob_regex(glob))


def _field_condition(df: DataFrame, field: str, cond) -> Column:
    if field == "_":
        # multi-field search: {"_": {"search": "...", "fields": [...]}}
        fields = cond.get("fields") or [f for f, t in ((f.name, f.dataType) for f in df.schema.fields)
                                        if t.simpleString() == "string"]
        ors = [search_predicate(col_path(f, df), cond["search"]) for f in fields]
        out = ors[0]
        for o in ors[1:]:
            out = out | o
        return out
    c = col_path(field, df)
    is_array = has_path(df, field) and isinstance(path_type(df, field), ArrayType)
    if isinstance(cond, dict):
        parts = []
        for op, v in cond.items():
            if op in _COMPARE and is_array and op in ("eq", "neq"):
                # on a list field equality means membership
                parts.append(F.array_contains(c, v) if op == "eq" else ~F.array_contains(c, v))
            elif op in _COMPARE:
                parts.append(_COMPARE[op](*_alike(df, field, c, v)))
            elif op == "wc":
                parts.append(c.cast("string").like(wildcard_like(v)))
            elif op == "search":
                parts.append(search_predicate(c, v))
            elif op == "contains":
                from .geometry import contains_point

                parts.append(contains_point(c, v[0], v[1]))
            elif op == "fields":
                continue
            else:
                raise ValueError(f"unknown pattern operator {op!r} on field {field!r}")
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out
    if isinstance(cond, (list, tuple)):
        return F.arrays_overlap(c, F.array(*[F.lit(v) for v in cond])) if is_array else c.isin(list(cond))
    if cond is None:
        return c.isNull()
    if is_array:
        return F.array_contains(c, cond)
    a, b = _alike(df, field, c, cond)
    return a == b


def _alike(df: DataFrame, field: str, c: Column, v):
    """Both sides of a comparison in one type. A number field compared with text takes the text as a
    number; text that is none makes the comparison null instead of failing the job."""
    if isinstance(v, str) and has_path(df, field) and isinstance(path_type(df, field), NumericType):
        return c, F.lit(v).try_cast("double") if not re.fullmatch(r"\s*[+-]?\d{1,18}\s*", v) else F.lit(int(v))
    if isinstance(v, (int, float)) and not isinstance(v, bool) and has_path(df, field) and isinstance(path_type(df, field), StringType):
        return c.try_cast("double"), F.lit(float(v))
    return c, F.lit(v)


def predicate(df: DataFrame, spec) -> Column:
    """Compile a pattern to one boolean Column (AND over fields); ``"*"`` matches everything."""
    if spec is None or spec == "*" or spec == {}:
        return F.lit(True)
    if isinstance(spec, Column):
        return spec
    parts = [_field_condition(df, f, c) for f, c in spec.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def match(df: DataFrame, spec) -> DataFrame:
    """Keep rows satisfying the pattern (null comparisons are false).

    A WHERE clause already drops rows whose predicate is null, so the predicate is used as is:
    wrapping it (e.g. in ``coalesce``) would stop Catalyst from pushing it into the scan.
    """
    if spec is None or spec == "*" or spec == {}:
        return df
    return df.where(predicate(df, spec))


def drop(df: DataFrame, spec) -> DataFrame:
    """Discard rows satisfying the pattern; a row whose comparison is null is kept."""
    if spec is None or spec == {}:
        return df
    return df.where(~F.coalesce(predicate(df, spec), F.lit(False)))


def filter_rows(df: DataFrame, match_spec=None, drop_spec=None) -> DataFrame:
    """The ``filter`` transform: ``match`` then ``drop``."""
    return drop(match(df, match_spec), drop_spec)


def order_by(df: DataFrame, order) -> DataFrame:
    """``{"Foo": "asc", "Baz": "desc"}`` (or a list of names); missing values sort last."""
    return df.orderBy(*order_columns(df, order))


def order_columns(df: DataFrame, order) -> list[Column]:
    if isinstance(order, str):
        order = [order]
    if isinstance(order, (list, tuple)):
        order = {o: "asc" for o in order}
    cols = []
    for f, d in order.items():
        c = col_path(f, df)
        cols.append(c.desc_nulls_last() if str(d).lower().startswith("desc") else c.asc_nulls_last())
    return cols


def top(df: DataFrame, order, n: int) -> DataFrame:
    """Top-k: ``orderBy().limit()`` plans as TakeOrderedAndProject (a per-partition heap, then
    one merge of k rows per partition), never a global sort."""
    return order_by(df, order).limit(int(n))


def retrieve(df: DataFrame, pattern: dict | None = None) -> DataFrame:
    """Read by pattern: ``{match, drop, fields, order, count}`` applied in that order."""
    pattern = pattern or {}
    out = filter_rows(df, pattern.get("match"), pattern.get("drop"))
    if pattern.get("fields"):
        out = out.select(*[col_path(f, out).alias(f) for f in pattern["fields"]])
    if pattern.get("order") and pattern.get("count"):
        return top(out, pattern["order"], pattern["count"])
    if pattern.get("order"):
        out = order_by(out, pattern["order"])
    if pattern.get("count"):
        out = out.limit(int(pattern["count"]))
    return out

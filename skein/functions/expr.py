"""Value expressions of pipeline specs, compiled to Spark ``Column``s.

Grammar (as used in ``map``, ``default``, ``assign`` and lookups):

* non-string values and plain strings are literals (``"unknown"``, ``19``);
* ``=path`` is a field reference that keeps the field's type (``=Foo``, ``=subObj1.state``);
* ``=a+'-'+b`` / ``!realm+':'+name`` concatenate fields and quoted literals, skipping nulls;
* ``${field}`` inside a string is a per-row template substitution;
* ``[field, pattern, replacement]`` replaces the first regex match (``$1`` group references).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from . import coerce
from .paths import col_path, has_path, path_type

_TEMPLATE = re.compile(r"\$\{([^}]+)\}")


def _split_terms(body: str) -> list[str]:
    """Split on ``+`` outside single or double quotes."""
    terms, cur, quote = [], [], None
    for ch in body:
        if quote:
            cur.append(ch)
            if ch == quote:
                quote = None
        elif ch in ("'", '"'):
            quote = ch
            cur.append(ch)
        elif ch == "+":
            terms.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    terms.append("".join(cur))
    return [t.strip() for t in terms if t.strip() != ""]


def _term(term: str, df: DataFrame | None, text: bool = False) -> Column:
    if len(term) >= 2 and term[0] == term[-1] and term[0] in ("'", '"'):
        return F.lit(term[1:-1])
    if term.startswith("${") and term.endswith("}"):
        term = term[2:-1]
    return text_path(term, df) if text else col_path(term, df)


def concat_skip_nulls(parts: list[Column]) -> Column:
    """Concatenate as strings; a null part contributes nothing."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def text_path(path: str, df: DataFrame | None) -> Column:
    """A field as text: doubles print as numbers do in JSON (``3``, ``12345678``), not ``3.0`` or ``1.2345678E7``."""
    c = col_path(path, df)
    if df is not None and has_path(df, path) and isinstance(path_type(df, path), (DoubleType, FloatType)):
        return coerce.number_text(c)
    return c.cast("string")


def field_expr(body: str, df: DataFrame | None = None) -> Column:
    """Compile the body of an ``=`` or ``!`` expression."""
    terms = _split_terms(body)
    if len(terms) == 1:
        return _term(terms[0], df)
    return concat_skip_nulls([_term(t, df, text=True) for t in terms])


def template_expr(text: str, df: DataFrame | None = None) -> Column:
    """``.../${cwa}/${gridX},${gridY}/`` -> per-row string."""
    parts: list[Column] = []
    pos = 0
    for m in _TEMPLATE.finditer(text):
        if m.start() > pos:
            parts.append(F.lit(text[pos:m.start()]))
        parts.append(text_path(m.group(1), df))
        pos = m.end()
    if pos < len(text):
        parts.append(F.lit(text[pos:]))
    # A template behaves like string concatenation in the source language: a missing value
    # makes the whole result null rather than silently shortening the string.
    return F.concat(*parts) if parts else F.lit("")


def regex_replace_first(c: Column, pattern: str, replacement: str) -> Column:
    """Replace only the first match of ``pattern`` (Java ``$n`` group references)."""
    # one pass from the text's start: the prefix is matched lazily and put back, so the pattern sees
    # its real context (look-around, word boundaries) and nothing after the first match is touched;
    # group 1 is the prefix, group 2 the whole match, the pattern's own groups follow
    shifted = re.sub(r"\\.|\$(\d+)", lambda m: m.group(0) if m.group(1) is None else f"${int(m.group(1)) + 2}", replacement)
    return F.regexp_replace(c.cast("string"), F.lit(r"\A((?s:.*?))((?:" + _shift_references(pattern) + "))"), F.lit("$1" + shifted))


def _shift_references(pattern: str) -> str:
    """``\\1`` in a pattern whose groups move by two becomes ``\\3``."""
    return re.sub(r"\\(.)", lambda m: "\\" + (str(int(m.group(1)) + 2) if m.group(1) in "123456789" else m.group(1)), pattern, flags=re.S)


def compile_value(value, df: DataFrame | None = None) -> Column:
    """Compile any spec value to a Column (see module docstring)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (list, tuple)) and len(value) == 3 and all(isinstance(v, str) for v in value):
        return regex_replace_first(col_path(value[0], df), value[1], value[2])
    if isinstance(value, str):
        if value.startswith("=") or value.startswith("!"):
            return field_expr(value[1:], df)
        if _TEMPLATE.search(value):
            return template_expr(value, df)
        return F.lit(value)
    return F.lit(value)


# --- urns (``realm:name``) -------------------------------------------------------------

def urn(realm: Column, name: Column) -> Column:
    """``realm:name``; a missing realm yields ``:name``."""
    return F.concat(F.coalesce(realm.cast("string"), F.lit("")), F.lit(":"), name.cast("string"))


def urn_realm(u: Column) -> Column:
    return F.when(F.instr(u, ":") > 0, F.substring_index(u, ":", 1)).otherwise(F.lit(""))


def urn_name(u: Column) -> Column:
    return F.when(F.instr(u, ":") > 0, u.substr(F.instr(u, ":") + 1, F.length(u))).otherwise(u)

"""Record transforms: ``mutate`` (default / map / select / remove / assign), rename, flatten, compose.

Each is a single ``select`` over Column expressions, so consecutive transforms collapse into one
projection and column pruning still reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expr import compile_value
from ..functions.paths import col_path, has_path, quote_part, split_path


def _nest(named: list[tuple[str, Column]]) -> list[Column]:
    """Turn ``[("a.b", c1), ("a.c", c2), ("d", c3)]`` into ``[struct(c1 as b, c2 as c) as a, c3 as d]``."""
    order: list[str] = []
    groups: dict[str, list] = {}
    for name, c in named:
        head, _, rest = name.partition(".")
        if head not in groups:
            order.append(head)
            groups[head] = []
        groups[head].append((rest, c))
    out = []
    for head in order:
        items = groups[head]
        if len(items) == 1 and items[0][0] == "":
            out.append(items[0][1].alias(head))
        elif any(not rest for rest, _ in items):
            raise ValueError(f"field {head!r} is given both as a value and as a group of fields, or twice")
        else:
            out.append(F.struct(*_nest(items)).alias(head))
    return out


def _set_field(df: DataFrame, target: str, value: Column) -> DataFrame:
    """Assign ``value`` to a possibly nested target, replacing in place or appending."""
    parts = split_path(target, df)
    if len(parts) == 1:
        return df.withColumn(parts[0], value)
    head = parts[0]
    if head in df.columns:
        return df.withColumn(head, F.col(quote_part(head)).withField(".".join(quote_part(p) for p in parts[1:]), value))
    return df.withColumn(head, _nest([(".".join(parts[1:]), value)])[0])


def _remove(df: DataFrame, names) -> DataFrame:
    for n in names:
        parts = split_path(n, df)
        if len(parts) == 1:
            df = df.drop(parts[0])
        elif has_path(df, n):
            df = df.withColumn(parts[0], F.col(quote_part(parts[0])).dropFields(".".join(quote_part(p) for p in parts[1:])))
    return df


def mutate(df: DataFrame, default: dict | None = None, map: dict | None = None, select: list | None = None,
           remove: list | None = None, assign: dict | None = None, keep: tuple = ()) -> DataFrame:
    """Apply ``default`` -> ``map``/``select`` -> ``remove`` -> ``assign``.

    * ``default``: value or expression used where the field is missing or null; default fields
      come first in the output.
    * ``map``: output holds only the defaults and the mapped fields (``{"foo": "=Foo"}``).
    * ``select``: output holds only the defaults and the listed fields, in list order.
    * with neither, all input fields pass through.
    * ``remove`` drops fields; ``assign`` sets fields unconditionally (nested targets allowed).
    * ``keep``: columns that pass through whatever ``map`` or ``select`` say.
    """
    if map and select:
        raise ValueError("mutate: give either map or select, not both")
    default = default or {}
    if map is not None or select is not None:
        if map is not None:
            body = [(name, compile_value(v, df)) for name, v in map.items()]
        else:
            body = [(name, col_path(name, df)) for name in select]
        names = {n for n, _ in body}
        head = [(n, compile_value(v, df)) for n, v in default.items() if n not in names]
        body = [(n, F.coalesce(c, compile_value(default[n], df)) if n in default else c) for n, c in body]
        out = df.select(*_nest(head + body), *_kept(df, keep))
    else:
        new = [(n, compile_value(v, df)) for n, v in default.items() if not has_path(df, n)]
        existing = {n: F.coalesce(col_path(n, df), compile_value(v, df)) for n, v in default.items() if has_path(df, n)}
        cols = [c for c in _nest(new)]
        for f in df.columns:
            cols.append(existing.pop(f).alias(f) if f in existing else F.col(quote_part(f)))
        out = df.select(*cols)
        for n, c in existing.items():  # nested defaults
            out = _set_field(out, n, c)
    if remove:
        out = _remove(out, remove)
    for n, v in (assign or {}).items():
        out = _set_field(out, n, compile_value(v, out))
    return out


def _kept(df: DataFrame, keep) -> list[Column]:
    return [F.col(quote_part(c)) for c in keep if c in df.columns]


def select_fields(df: DataFrame, fields: list[str], keep: tuple = ()) -> DataFrame:
    """Keep the listed (possibly dotted) fields in order; prunes the scan."""
    return df.select(*[col_path(f, df).alias(f) for f in fields], *_kept(df, keep))


def rename(df: DataFrame, fields: dict, keep: tuple = ()) -> DataFrame:
    """Legacy ``select.fields`` map ``{source: target}``; dotted sources read nested values and
    dotted targets build nested structs. Only the mapped fields (and ``keep``) stay."""
    return df.select(*_nest([(t, col_path(s, df)) for s, t in fields.items()]), *_kept(df, keep))


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Decompose nested structs into top-level leaf columns named ``a{sep}b``; arrays are kept."""

    def leaves(st: StructType, prefix: list[str]):
        for f in st.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, path)
            else:
                yield path

    return df.select(*[F.col(".".join(quote_part(p) for p in path)).alias(sep.join(path))
                       for path in leaves(df.schema, [])])


def compose(df: DataFrame, sep: str = "_", keep: tuple = ()) -> DataFrame:
    """Inverse of :func:`flatten`: columns named ``a{sep}b`` become nested struct ``a.b``.

    Separators at a name's ends don't split it (``_id`` stays). A column that is both a value and a
    group (``a`` beside ``a{sep}b``) raises, as one of them would be lost.
    """
    def path(name: str) -> str:
        body = name.strip(sep)
        if not body:
            return name
        at = name.index(body)
        return name[:at] + body.replace(sep, ".") + name[at + len(body):]

    return df.select(*_nest([(path(f), F.col(quote_part(f))) for f in df.columns if f not in keep]), *_kept(df, keep))

"""Grouped summaries, high-water marks and run statistics.

``groupBy().agg()`` plans as partial aggregate -> shuffle -> final aggregate, so each map task
pre-combines its rows and a key holding a third of the data costs one row per task in the
shuffle, not a third of the data in one reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.expr import compile_value
from ..functions.paths import col_path

# The summary functions of the aggregate transform.
_FUNCS = {
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
    "count_distinct": F.count_distinct,
}


def _arg(df: DataFrame, a) -> Column:
    if isinstance(a, Column):
        return a
    if a == "*" or a is None:
        return F.lit(1)
    if isinstance(a, str) and not a.startswith("="):
        return col_path(a, df)
    return compile_value(a, df)


def aggregate(df: DataFrame, by: list | None = None, aggs: dict | None = None) -> DataFrame:
    """``aggs = {"n": ("count", "*"), "q": ("sum", "l_quantity"), ...}``; ``by`` optional.

    A distinct count next to other summaries is planned as two partial aggregates -- first by
    the groups plus the distinct field, then by the groups -- instead of Spark's ``Expand``
    rewrite, which copies every input row once per distinct/non-distinct branch before the
    shuffle. Result names and types are those of the one-level aggregate.
    """
    aggs = aggs or {"count": ("count", "*")}
    keys = [col_path(b, df).alias(b) for b in (by or [])]
    exprs = [_FUNCS[fn](_arg(df, arg)).alias(out) for out, (fn, arg) in aggs.items()]
    plain = df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)
    distinct = {out for out, (fn, _) in aggs.items() if fn == "count_distinct"}
    if len(distinct) != 1 or len(aggs) == 1:
        return plain
    return _two_level(df, keys, aggs, distinct.pop(), plain.schema)


def _two_level(df: DataFrame, keys, aggs: dict, dout: str, schema) -> DataFrame:
    names = [f.name for f in schema.fields][: len(keys)]
    dcol = "__d"
    inner, outer = [], []
    for out, (fn, arg) in aggs.items():
        a = _arg(df, arg)
        if out == dout:
            outer.append(F.count(F.col(dcol)).alias(out))
        elif fn == "avg":
            inner += [F.sum(a).alias(f"{out}__s"), F.count(a).alias(f"{out}__n")]
            outer.append((F.sum(f"{out}__s") / F.sum(f"{out}__n")).alias(out))
        else:
            inner.append(_FUNCS[fn](a).alias(out))
            comb = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[fn]
            total = comb(F.col(out))
            # a global count over no rows is 0, as in the one-level form
            outer.append((F.coalesce(total, F.lit(0)) if fn == "count" else total).alias(out))
    level1 = df.groupBy(*keys, _arg(df, aggs[dout][1]).alias(dcol)).agg(*inner)
    level2 = level1.groupBy(*names).agg(*outer) if names else level1.agg(*outer)
    return level2.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def high_water(df: DataFrame, field: str) -> Column:
    """The largest value of a sequence field, as a scalar subquery Column (no driver round trip)."""
    return df.select(F.max(col_path(field, df))).scalar()


def with_metrics(df: DataFrame, name: str | None = None) -> tuple[DataFrame, Observation]:
    """Attach a row-count observation; it is filled by whatever action consumes ``df``, so the
    count costs no extra pass over the data. Each call gets its own observation name."""
    import uuid

    obs = Observation(name or f"metrics_{uuid.uuid4().hex[:12]}")
    return df.observe(obs, F.count(F.lit(1)).alias("count")), obs

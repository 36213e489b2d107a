"""Enrichment joins: ``adjoin`` (1:1 lookup), ``conjoin`` (1:N), ``foreach_join``.

No side is broadcast by hint. A lookup is deduplicated with a partial (map-side combined) aggregate
and, unless it is known to be unique, written to the shared folder: the join then reads a file scan,
whose size is known, so Spark broadcasts a small lookup (``spark.sql.autoBroadcastJoinThreshold``)
without shuffling the driving side, and a large one is joined through shuffles of its own, where AQE
splits the driving rows of a hot key. (Joined directly, the aggregate's output would reuse its
partitioning, and AQE neither converts nor splits such a join.) Driving rows whose key is null can't
match; they are set aside and added back, so they never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.expr import compile_value
from ..functions.paths import col_path, comparable, descending, path_type, quote_part
from ..session import staged
from .param_joins import param_join


def _equi(left_names: list[str], right_names: list[str]) -> Column:
    """AND of ``left = right`` over uniquely named key columns (null never matches)."""
    cond = None
    for lk, rk in zip(left_names, right_names):
        e = F.col(lk) == F.col(rk)
        cond = e if cond is None else cond & e
    return cond


def _same_types(left: DataFrame, lkeys: list[str], right: DataFrame, rkeys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A text key that meets a number key is read as a number; text that is none matches nothing
    (comparing them directly would end the job at the first such row)."""
    for lk, rk in zip(lkeys, rkeys):
        a, b = left.schema[lk].dataType, right.schema[rk].dataType
        if isinstance(a, StringType) and isinstance(b, NumericType):
            left = left.withColumn(lk, F.col(lk).try_cast(b))
        elif isinstance(b, StringType) and isinstance(a, NumericType):
            right = right.withColumn(rk, F.col(rk).try_cast(a))
    return left, right


def _check_collisions(left: DataFrame, names: list[str], prefix: str | None):
    clash = [n for n in names if (prefix or "") + n in left.columns]
    if clash:
        raise ValueError(f"join would overwrite fields {clash}; pass prefix=")


def dedupe_lookup(right: DataFrame, keys: list[str], payload: list[str], order=None) -> DataFrame:
    """One row per key: the row that sorts first by ``order`` (default: by the payload itself).

    ``min_by`` is a partial aggregate, so a key holding a third of all lookup rows is reduced to one
    row per map task before the shuffle. Missing order values come last, whatever the direction.
    """
    ordered = [F.col(quote_part(k)) for k in keys]
    place = []
    for name, down in _order_items(order):
        c, dt = col_path(name, right), path_type(right, name)
        c = comparable(c, dt)
        place += [c.isNull(), descending(c, dt) if down else c]  # missing values come last
    place += [comparable(col_path(p, right), path_type(right, p)) for p in payload]
    row = F.struct(*[col_path(p, right).alias(f"__p{i}") for i, p in enumerate(payload)])
    best = F.min_by(row, F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(place)])).alias("__best")
    # null keys never match a lookup, so they are dropped before the shuffle
    agg = right.where(_all_not_null(ordered)).groupBy(*ordered).agg(best)
    return agg.select(*ordered, *[F.col("__best").getField(f"__p{i}").alias(p) for i, p in enumerate(payload)])


def _all_not_null(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull()
    return out


def adjoin(df: DataFrame, other: DataFrame, lookup: dict, inject: list[str] | None = None,
           order=None, prefix: str | None = None, unique: bool = False, stage: bool = True) -> DataFrame:
    """Inject fields of the matching ``other`` row into each row of ``df`` (left join, 1:1).

    ``lookup`` maps a field of ``other`` to an expression over the driving row
    (``{"Baz": "=Baz", "Foo": "=Foo"}``). Unmatched rows keep their fields and get nulls; when
    several lookup rows match, the first by ``order`` (names, or ``{name: "desc"}``) wins, so the
    output has exactly the input's row count. ``unique=True`` says that the lookup's keys are unique
    (e.g. declared as ``key`` by its encoding), which saves the deduplication. ``stage=False`` joins
    the deduplicated lookup directly; it is implied for streams.
    """
    keys = list(lookup.keys())
    inject = inject or [c for c in other.columns if c not in keys]
    _check_collisions(df, inject, prefix)
    right_keys = [f"__k{i}" for i in range(len(keys))]
    r = other.select(*[col_path(k, other).alias(rk) for k, rk in zip(keys, right_keys)],
                     *[col_path(c, other).alias(c) for c in inject],
                     *[col_path(o, other).alias(o) for o, _ in _order_items(order) if o not in inject])
    if unique:
        r = r.select(*right_keys, *[F.col(quote_part(c)) for c in inject]).where(_all_not_null([F.col(k) for k in right_keys]))
    else:
        r = dedupe_lookup(r, right_keys, inject, order)
    if stage and not unique and not other.isStreaming and not df.isStreaming:
        r = staged(r, "lookup")
    r = r.select(*right_keys, *[F.col(quote_part(c)).alias((prefix or "") + c) for c in inject])
    left_keys = [f"__lk{i}" for i in range(len(keys))]
    left = df.withColumns({lk: compile_value(v, df) for lk, v in zip(left_keys, lookup.values())})
    out = [*[F.col(quote_part(c)) for c in df.columns], *[F.col(quote_part((prefix or "") + c)) for c in inject]]
    if df.isStreaming:
        return left.join(r, _equi(left_keys, right_keys), "left").select(*out)
    keyed = _all_not_null([F.col(k) for k in left_keys])
    left, r = _same_types(left, left_keys, r, right_keys)
    matched = left.where(keyed).join(r, _equi(left_keys, right_keys), "left").select(*out)
    if all(not left.schema[k].nullable for k in left_keys):
        return matched
    added = {(prefix or "") + c: F.lit(None).cast(matched.schema[(prefix or "") + c].dataType) for c in inject}
    return matched.unionByName(left.where(~keyed).withColumns(added).select(*out))


def _order_items(order) -> list[tuple[str, bool]]:
    """(field, descending) of a lookup's order: a list, one name, or ``{name: "asc" | "desc"}``."""
    if not order:
        return []
    if isinstance(order, str):
        return [(order, False)]
    if isinstance(order, dict):
        return [(k, str(d).lower().startswith("desc")) for k, d in order.items()]
    return [(o, False) for o in order]


def conjoin(df: DataFrame, other: DataFrame, on: dict, fields: list[str] | None = None,
            prefix: str | None = None) -> DataFrame:
    """1:N enrichment: each driving row is followed by every matching ``other`` row; parent
    columns come first. Rows without a match are not emitted (inner join).

    ``on`` maps a field of ``other`` to an expression over the driving row, the row-level form of
    a parameterised nested query (``{"cwa": "=cwa"}``), or to conditions other than equality
    (``{"price": {"gte": "=low", "lt": "=high"}}``, see :func:`skein.operators.param_joins.param_join`).
    """
    fields = fields or [c for c in other.columns if c not in on]
    _check_collisions(df, fields, prefix)
    if any(isinstance(v, dict) for v in on.values()):
        return param_join(df, other, on, fields=fields, prefix=prefix)
    lkeys = [f"__lk{i}" for i in range(len(on))]
    rkeys = [f"__rk{i}" for i in range(len(on))]
    left = df.withColumns({lk: compile_value(v, df) for lk, v in zip(lkeys, on.values())})
    right = other.select(*[col_path(rf, other).alias(rk) for rf, rk in zip(on.keys(), rkeys)],
                         *[col_path(c, other).alias((prefix or "") + c) for c in fields])
    left, right = _same_types(left, lkeys, right, rkeys)
    return left.join(right, _equi(lkeys, rkeys), "inner").select(*[F.col(quote_part(c)) for c in df.columns],
                                                  *[F.col(quote_part((prefix or "") + c)) for c in fields])


def foreach_join(driver: DataFrame, facts: DataFrame, on: dict) -> DataFrame:
    """Each driving row parameterises a sub-query over ``facts``; all results go to one output.

    Instead of one job per driving row this is one join: a driving row emits every fact row its
    parameters select, so duplicate driving rows repeat their results as separate runs would.
    Conditions other than equality (ranges, wildcards, areas) are dicts, as in a pattern.
    """
    if any(isinstance(v, dict) for v in on.values()):
        return param_join(driver, facts, on, keep=[])
    params = driver.select(*[compile_value(v, driver).alias(f"__p{i}") for i, v in enumerate(on.values())])
    keyed = facts.select(*[col_path(rf, facts).alias(f"__f{i}") for i, rf in enumerate(on.keys())],
                         *[F.col(quote_part(c)) for c in facts.columns])
    pk, fk = [f"__p{i}" for i in range(len(on))], [f"__f{i}" for i in range(len(on))]
    return params.join(keyed, _equi(pk, fk), "inner").select(*[F.col(quote_part(c)) for c in facts.columns])

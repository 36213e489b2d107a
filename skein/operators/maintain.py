"""Data maintenance: pattern deletes, incremental synchronisation and keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import col_path, comparable, quote_part
from .pattern import drop, match


def dull(df: DataFrame, pattern) -> DataFrame:
    """Rows that survive deleting ``pattern`` (a row whose comparison is null survives)."""
    return drop(df, pattern)


def dull_count(df: DataFrame, pattern) -> DataFrame:
    """``{deleted: n}`` -- how many rows ``pattern`` deletes."""
    return match(df, pattern).agg(F.count(F.lit(1)).alias("deleted"))


def sync_increment(src: DataFrame, dst: DataFrame, field: str) -> DataFrame:
    """Rows of ``src`` newer than the high-water mark already in ``dst``.

    The mark is a scalar subquery, so Spark computes it once, and the bare comparison is pushed into
    the scan of ``src``, which skips row groups below the mark. For an empty ``dst`` the subquery
    itself yields a mark below every value, so everything is taken.
    """
    c = col_path(field, src)
    low = _below_all(src.select(c.alias("c")).schema["c"].dataType)
    if low is None:  # no smallest value to name
        mark = dst.select(F.max(col_path(field, dst))).scalar()
        return src.where(F.coalesce(c > mark, c.isNotNull()))
    return src.where(c > dst.select(F.coalesce(F.max(col_path(field, dst)), low)).scalar())


def _below_all(dt):
    """A literal below every practical value of a sequence field's type."""
    from pyspark.sql import types as T

    if isinstance(dt, T.LongType):
        return F.lit(-(1 << 63)).cast(dt)
    if isinstance(dt, T.IntegerType):
        return F.lit(-(1 << 31)).cast(dt)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.lit(float("-inf")).cast(dt)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit("0001-01-01").cast(dt)
    return None


def _with_columns(df: DataFrame, names: list[str], other: DataFrame) -> DataFrame:
    """``df`` with all of ``names``; those it lacks are null, in the other side's type."""
    if list(df.columns) == names:
        return df
    return df.select(*[F.col(quote_part(c)) if c in df.columns else F.lit(None).cast(other.schema[c].dataType).alias(c) for c in names])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Keyed store: one row per key, the ``source`` row replacing the ``target`` row.

    Without ``order``: the source is deduplicated on its own (a partial aggregate over the
    change set only) and the target keeps the rows whose key is not in it -- a left anti join,
    which AQE turns into a broadcast when the change set is measured small, so the large target
    is never shuffled. With ``order`` (version columns) only target rows whose key is among the
    changes take part: of them and the changes the row with the largest version wins, ``source``
    breaking ties (a partial aggregate, so a hot key is combined map-side); all other target rows
    pass through unshuffled. Rows with a null key cannot be addressed and are kept as they are.
    The result has the columns of both sides, the target's first; a side that lacks one has nulls there.
    """
    cols = [*target.columns, *[c for c in source.columns if c not in target.columns]]
    qcols = [quote_part(c) for c in cols]
    target, source = _with_columns(target, cols, source), _with_columns(source, cols, target)
    key_ok = F.lit(True)
    for k in keys:
        key_ok = key_ok & F.col(quote_part(k)).isNotNull()
    rest = [c for c in cols if c not in keys]
    qkeys = [quote_part(k) for k in keys]

    def latest(df: DataFrame, extra: list) -> DataFrame:
        place = [*extra, *[comparable(F.col(quote_part(c)), df.schema[c].dataType).alias(f"__c{i}") for i, c in enumerate(rest)], F.lit(0).alias("__z")]
        row = F.struct(*[F.col(quote_part(c)) for c in rest]) if rest else F.struct(F.lit(0).alias("__z"))
        best = F.max_by(row, F.struct(*place)).alias("__best")
        return (df.where(key_ok).groupBy(*qkeys).agg(best)
                .select(*qkeys, *[F.col("__best").getField(c).alias(c) for c in rest]).select(*qcols))

    if not order:
        changes = latest(source, [])
        kept = target.join(changes.select(*qkeys), on=keys, how="left_anti")
        return kept.unionByName(changes).unionByName(source.where(~key_ok))
    changed = source.where(key_ok).select(*qkeys).distinct()
    touched = target.where(key_ok).join(changed, on=keys, how="left_semi").select(*qcols)
    untouched = target.join(changed, on=keys, how="left_anti").select(*qcols)
    tagged = touched.withColumn("__prio", F.lit(0)).unionByName(source.where(key_ok).withColumn("__prio", F.lit(1)))
    extra = [F.col(quote_part(o)).alias(f"__o{i}") for i, o in enumerate(order)] + [F.col("__prio")]
    return untouched.unionByName(latest(tagged, extra)).unionByName(source.where(~key_ok))

"""Comparing two datasets by key.

Rows are put into buckets by a hash of their key. A bucket's digest is a sum over the hashes of its
rows, so it doesn't depend on their order, and comes from one partial aggregate: what is shuffled is a
row per bucket and task. Buckets whose digests are equal on both sides drop out; only rows of the
others are shuffled by key, where one more aggregate says which keys were added, removed or changed,
and in which fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import comparable, quote_part
from ..session import staged

BUCKETS = 16_384


def bucket_of(df: DataFrame, keys: list[str], buckets: int) -> Column:
    """The bucket of a row's key; null is a key value like others."""
    parts = []
    for k in keys:
        c = comparable(F.col(quote_part(k)), df.schema[k].dataType)
        parts += [c, c.isNull()]
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def _halves(h: Column, name: str, sign: Column | None = None) -> list[Column]:
    """Two sums that don't overflow and together depend on all bits of the hashes."""
    low, high = h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftright(h, 32)
    if sign is not None:
        low, high = low * sign, high * sign
    return [F.sum(low).alias(f"{name}_low"), F.sum(high).alias(f"{name}_high")]


def _cell(df: DataFrame, name: str, *more: Column) -> Column:
    c = comparable(F.col(quote_part(name)), df.schema[name].dataType)
    return F.xxhash64(c, c.isNull(), *more)


def digests(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """bucket, rows and digest of every bucket that has rows."""
    cells = []
    for c in df.columns:
        v = comparable(F.col(quote_part(c)), df.schema[c].dataType)
        cells += [v, v.isNull()]
    row = df.select(bucket_of(df, keys, buckets).alias("bucket"), F.xxhash64(*cells).alias("h"), F.xxhash64(F.lit(1), *cells).alias("g"))
    return row.groupBy("bucket").agg(F.count("*").alias("rows"), *_halves(F.col("h"), "h"), *_halves(F.col("g"), "g"))


def unequal_buckets(expected: DataFrame, actual: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The buckets whose rows differ; ``buckets`` rows at most."""
    names = ["rows", "h_low", "h_high", "g_low", "g_high"]
    both = digests(expected, keys, buckets).select("bucket", *names) \
        .unionByName(digests(actual, keys, buckets).select("bucket", *[(-F.col(n)).alias(n) for n in names]))
    sums = both.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    differs = F.lit(False)
    for n in names:
        differs = differs | (F.col(n) != 0)
    return sums.where(differs).select("bucket")


def compare_keyed(expected: DataFrame, actual: DataFrame, on: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Per key that differs: the key, ``status`` (added, removed or changed) and ``fields``, the names of
    the fields whose values differ, in the order of ``expected``.

    A field that one side lacks counts as null there. Null is a key value like others. A key may
    repeat on a side: then its rows count together, and a field differs if its values differ as
    a bag; if only the pairing of values differs, ``fields`` is empty.
    """
    on = [on] if isinstance(on, str) else list(on)
    names = [*expected.columns, *[c for c in actual.columns if c not in expected.columns]]

    def whole(df: DataFrame, other: DataFrame) -> DataFrame:
        kinds = {c: (df if c in df.columns else other).schema[c].dataType for c in names}
        return df.select(*[F.col(quote_part(c)) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names])

    expected, actual = whole(expected, actual), whole(actual, expected)
    for f in expected.schema.fields:  # values are compared in the type of the expected side
        if actual.schema[f.name].dataType != f.dataType:
            actual = actual.withColumn(f.name, F.col(quote_part(f.name)).cast(f.dataType))
    touched = staged(unequal_buckets(expected, actual, on, buckets), "unequal")
    rest = [c for c in names if c not in on]

    def cells(df: DataFrame, sign: int) -> DataFrame:
        some = df.withColumn("__bucket", bucket_of(df, on, buckets)).join(touched.withColumnRenamed("bucket", "__bucket"), "__bucket", "left_semi")
        keys = [comparable(F.col(quote_part(k)), df.schema[k].dataType) for k in on]
        return some.select(*[F.col(quote_part(k)) for k in on], F.struct(*keys).alias("__key"), F.lit(sign).alias("__sign"),
                           _row(df, rest).alias("__row"), *[_cell(df, c).alias(f"__c{i}") for i, c in enumerate(rest)])

    tagged = cells(expected, 1).unionByName(cells(actual, -1))
    sign = F.col("__sign")
    sums = [F.sum(F.when(sign > 0, 1).otherwise(0)).alias("__expected"), F.sum(F.when(sign < 0, 1).otherwise(0)).alias("__actual"), *_halves(F.col("__row"), "__row", sign)]
    for i in range(len(rest)):
        sums += _halves(F.col(f"__c{i}"), f"__c{i}", sign)
    first = [F.first(F.col(quote_part(k))).alias(f"__k{i}") for i, k in enumerate(on)]
    keyed = tagged.groupBy("__key").agg(*first, *sums)
    status = F.when(F.col("__expected") == 0, "added").when(F.col("__actual") == 0, "removed").otherwise("changed")
    changed = F.filter(F.array(*[F.when((F.col(f"__c{i}_low") != 0) | (F.col(f"__c{i}_high") != 0), F.lit(c)) for i, c in enumerate(rest)] or [F.lit(None).cast("string")]), lambda c: c.isNotNull())
    differs = (F.col("__expected") != F.col("__actual")) | (F.col("__row_low") != 0) | (F.col("__row_high") != 0)
    fields = F.when(status == "changed", changed).otherwise(F.array().cast("array<string>"))
    return keyed.where(differs).select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(on)], status.alias("status"), fields.alias("fields"))


def _row(df: DataFrame, names: list[str]) -> Column:
    cells = [F.lit(0)]
    for c in names:
        v = comparable(F.col(quote_part(c)), df.schema[c].dataType)
        cells += [v, v.isNull()]
    return F.xxhash64(*cells)

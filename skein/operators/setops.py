"""Union of sub-results and dataset comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import quote_part


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Shared output of several sub-results; fields missing from one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: copies that one chunk row stands for
CHUNK = 100_000


def replicate(df: DataFrame, count: str) -> DataFrame:
    """Emit each row ``count`` times (``count`` >= 0).

    Every row becomes chunk rows of at most CHUNK copies each, chunks are dealt out over all tasks by
    (row, chunk number) and then exploded there: the copies of one row, however many, come from many
    tasks, and no task holds more than a chunk of them at a time. Chunk numbers are ranges of ranges,
    so the rows that name the chunks are few wherever the copies are few.
    """
    from ..functions.paths import comparable

    names = [c for c in df.columns if c != count]
    cols = [quote_part(c) for c in names]
    n = F.col(quote_part(count)).cast("bigint")
    spread = F.xxhash64(*[comparable(F.col(quote_part(f.name)), f.dataType) for f in df.schema.fields if f.name != count], F.col("__chunk"))
    chunks = df.where(n > 0).select(*cols, n.alias("__n")) \
        .withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / F.lit(CHUNK)))))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(parts, spread)
    own = F.least(F.lit(CHUNK).cast("bigint"), F.col("__n") - F.col("__chunk") * F.lit(CHUNK))
    return dealt.select(*cols, F.explode(F.array_repeat(F.lit(True), own.cast("int"))).alias("__copy")).select(*cols)


#: how much of a value is compared (our own definition of the levels)
NAMES, TYPES, VALUES = 0, 1, 2


def at_level(df: DataFrame, level: int) -> DataFrame:
    """Rows as far as a comparison looks at them: which fields are present (NAMES), with the type of
    present ones (TYPES), or the values themselves (VALUES)."""
    if level >= VALUES:
        return df
    cells = []
    for f in df.schema.fields:
        c = F.col(quote_part(f.name))
        seen = F.lit("present") if level == NAMES else F.lit(f.dataType.simpleString())
        cells.append(F.when(c.isNotNull(), seen).otherwise(F.lit("missing")).alias(f.name))
    return df.select(*cells)


def compare(expected: DataFrame, actual: DataFrame, side_col: str = "side", level: int = VALUES) -> DataFrame:
    """Rows of ``expected`` missing from ``actual`` and rows of ``actual`` not expected, with
    multiplicity (bag difference both ways, like ``EXCEPT ALL`` in each direction).

    One partial aggregate over the tagged union -- a single shuffle for both directions, where
    two ``exceptAll`` calls would shuffle everything twice -- then the surplus copies of each
    differing row are regenerated on the side that has them.
    """
    expected, actual = at_level(expected, level), at_level(actual, level)
    cols = [quote_part(c) for c in expected.columns]
    tagged = (expected.select(*cols, F.lit(1).alias("__d"))
              .unionByName(actual.select(*cols, F.lit(-1).alias("__d"))))
    diff = tagged.groupBy(*cols).agg(F.sum("__d").alias("__n")).where(F.col("__n") != 0)
    sided = diff.select(*cols, F.when(F.col("__n") > 0, F.lit("expected_only")).otherwise(F.lit("actual_only"))
                        .alias(side_col), F.abs("__n").alias("__n"))
    return replicate(sided, "__n")


def compare_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per distinct row: how often it occurs on each side, only where the counts differ.

    One partial aggregate over the tagged union -- a single shuffle -- for a summary of where two
    large datasets disagree without replicating rows.
    """
    cols = [quote_part(c) for c in expected.columns]
    tagged = (expected.select(*cols, F.lit(1).alias("__e"), F.lit(0).alias("__a"))
              .unionByName(actual.select(*cols, F.lit(0).alias("__e"), F.lit(1).alias("__a"))))
    return (tagged.groupBy(*cols).agg(F.sum("__e").alias("n_expected"), F.sum("__a").alias("n_actual"))
            .where(F.col("n_expected") != F.col("n_actual")))


def compare_files(spark, expected_path: str, actual_path: str, fmt: str = "json", pick: str | None = None,
                  options: dict | None = None, level: int = VALUES) -> DataFrame:
    """Compare two stored datasets (optionally the array at a ``pick`` path inside each); fields
    are aligned by name on the expected side's columns, ``level`` says how closely."""
    from ..sources.files import pick as pick_path

    def load(p):
        df = spark.read.format(fmt).options(**(options or {})).load(p)
        return pick_path(df, pick) if pick else df

    exp, act = load(expected_path), load(actual_path)
    cols = [quote_part(c) for c in exp.columns]
    missing = [c for c in exp.columns if c not in act.columns]
    for c in missing:
        act = act.withColumn(c, F.lit(None).cast(exp.schema[c].dataType))
    return compare(exp.select(*cols), act.select(*cols), level=level)

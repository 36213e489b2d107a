"""File and table sinks: JSON, CSV, create-then-append loads, keyed upserts, split outputs,
multi-sink fan-out and run statistics."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce
from ..functions.paths import comparable, quote_part
from ..operators.maintain import upsert
from ..storage import dataset_exists, replace


def _json_ready(c: Column, dt: T.DataType) -> Column:
    """Timestamps as ISO-8601 UTC with milliseconds (``...Z``), recursively inside structs/arrays."""
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return coerce.iso_utc(c)
    if isinstance(dt, T.StructType):
        return F.when(c.isNull(), F.lit(None)).otherwise(
            F.struct(*[_json_ready(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields]))
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.StructType, T.TimestampType, T.TimestampNTZType)):
        return F.transform(c, lambda x: _json_ready(x, dt.elementType))
    return c


def json_ready(df: DataFrame) -> DataFrame:
    return df.select(*[_json_ready(F.col(quote_part(f.name)), f.dataType).alias(f.name) for f in df.schema.fields])


def write_json(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None,
               array: bool = False):
    """JSON Lines with explicit nulls and ISO UTC timestamps, one part file per task.

    ``array=True`` writes one JSON array document instead: its part files, concatenated in name
    order, are ``[row, row, ...]`` (built by the template-document sink, never in one task).
    """
    if array:
        from .documents import to_documents, write_documents

        ready = json_ready(df)
        body = F.to_json(F.struct(*[F.col(quote_part(c)) for c in ready.columns]), {"ignoreNullFields": "false"})
        return write_documents(to_documents(ready, None, None, row_json=body), path)
    w = json_ready(df).write.mode(mode).option("ignoreNullFields", False)
    if compression:
        w = w.option("compression", compression)
    w.json(path)


def _csv_text(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.StringType):
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return coerce.iso_utc_short(c)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return coerce.number_text(c)
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
        return F.concat(F.lit('"'), F.replace(F.to_json(c), F.lit('"'), F.lit('""')), F.lit('"'))
    return c.cast("string")


def csv_ready(df: DataFrame) -> DataFrame:
    """Pre-rendered CSV cells: strings quoted, numbers/dates/booleans bare, null empty; a UTC
    midnight timestamp prints as the date alone. Header names are quoted the same way."""
    return df.select(*[_csv_text(F.col(quote_part(f.name)), f.dataType).alias('"' + f.name.replace('"', '""') + '"')
                       for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, header: bool = False, sep: str = ",", mode: str = "overwrite"):
    """CSV with per-type quoting: text is always quoted (quotes doubled), numbers, dates and
    booleans are bare, null is an empty cell.

    Cells are rendered by :func:`csv_ready` and joined to whole lines, which the text writer stores
    as they are. With ``header`` every part file begins with the header line, as Spark's own CSV
    writer does; a result without rows is a file with the header alone.
    """
    cells = csv_ready(df)
    names = cells.columns
    line = F.concat_ws(sep, *[F.coalesce(F.col(quote_part(c)), F.lit("")) for c in names])
    lines = cells.select(line.alias("value"))
    if not header:
        return lines.write.mode(mode).text(path)
    # the first row of a partition carries the header line before its own
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    head = sep.join(names)
    lines = lines.select(F.when(first, F.concat(F.lit(head + "\n"), F.col("value"))).otherwise(F.col("value")).alias("value"))
    lines.write.mode(mode).text(path)
    if df.sparkSession.read.schema("value string").text(path).isEmpty():  # no rows: a file with the header alone
        df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("append").text(path)


def load_table(df: DataFrame, table: str, append: bool = True, fmt: str = "parquet"):
    """Create the table unless it exists, then append. Never overwrites existing rows.

    A failure to create (e.g. a concurrent creator won the race) is logged and the load goes on
    with the append, which fails loudly if the table really is unusable.
    """
    import logging

    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        try:
            df.limit(0).write.format(fmt).saveAsTable(table)
        except Exception as err:  # noqa: BLE001 - logged, the append decides
            logging.getLogger("skein").warning("create %s failed: %s", table, err)
    df.write.format(fmt).mode("append" if append else "overwrite").saveAsTable(table)


def upsert_path(df: DataFrame, path: str, keys: list[str], order: list[str] | None = None, fmt: str = "parquet"):
    """Keyed store on a file dataset: merge ``df`` into what is at ``path``.

    The merged result is written completely beside the target and then takes its place
    (:mod:`skein.storage`), so a failed job leaves the target as it was. A target that exists but
    can't be read raises; only a target that doesn't exist counts as empty.
    """
    spark = df.sparkSession
    if not dataset_exists(spark, path):
        replace(upsert(df.limit(0), df, keys, order), path, fmt)
        return
    current = spark.read.format(fmt).load(path)
    replace(upsert(current, df, keys, order), path, fmt)


def upsert_table(df: DataFrame, table: str, keys: list[str], order: list[str] | None = None, fmt: str = "parquet"):
    """Keyed store on a catalog table: the merged rows become a new table that takes the old one's name.

    Between the two renames the table has no name; a job that dies there leaves the old table under the
    name ``<table>__old_…``, and the next call puts it back.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        database, _, name = table.rpartition(".")
        aside = [t.name for t in spark.catalog.listTables(database or None, f"{name}__old_*")]
        if len(aside) > 1:
            raise OSError(f"{table} is missing and several former versions exist: {aside}")
        if aside:
            spark.sql(f"ALTER TABLE {database + '.' if database else ''}{aside[0]} RENAME TO {table}")
    if not spark.catalog.tableExists(table):
        upsert(df.limit(0), df, keys, order).write.format(fmt).saveAsTable(table)
        return
    fresh = f"{table}_{uuid.uuid4().hex[:8]}"
    upsert(spark.table(table), df, keys, order).write.format(fmt).saveAsTable(fresh)
    old = f"{table}__old_{uuid.uuid4().hex[:8]}"
    spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
    spark.sql(f"DROP TABLE {old}")


def write_split(df: DataFrame, path: str, split_on: str | list[str], fmt: str = "json", mode: str = "overwrite",
                rows_per_file: int = 1_000_000):
    """One output per value of ``split_on`` (directory ``split_on=value``).

    Rows are clustered by ranges of (value, row hash). Range bounds are cut where the rows are, so
    a rare value shares a task with its neighbours and a value that holds a third of all rows spans
    a third of the tasks; nothing limits how many. The hash is of the row (not a random number), so
    a retried task sends every row to the same place again. Files hold ``rows_per_file`` rows at most.
    """
    cols = [split_on] if isinstance(split_on, str) else list(split_on)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, *[F.col(quote_part(c)) for c in cols], row_hash(df))
    if fmt == "json":
        out = json_ready(out)
    (out.write.mode(mode).partitionBy(*cols).format(fmt).option("ignoreNullFields", False)
     .option("maxRecordsPerFile", rows_per_file).save(path))


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row; maps, which have no order, are hashed by their sorted entries."""
    return F.xxhash64(*[comparable(F.col(quote_part(f.name)), f.dataType) for f in df.schema.fields])


def tee_write(df: DataFrame, sinks: list, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Write one computed dataset to several sinks (``callable(df)`` each) reading the source
    once: the data is persisted for the fan-out and released after the last sink."""
    cached = df.persist(level)
    try:
        for sink in sinks:
            sink(cached)
    finally:
        cached.unpersist()


def tee(df: DataFrame, side_steps, side_sink) -> DataFrame:
    """Mid-pipeline side output: ``side_sink(side_steps(df))`` runs now, ``df`` passes on
    unchanged. Call ``.unpersist()`` on the result after its last use."""
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    side_sink(side_steps(cached) if side_steps else cached)
    return cached


def dull_path(spark, path: str, pattern, fmt: str = "parquet", read=None, write=None) -> int:
    """Delete the rows matching ``pattern`` from a file dataset; returns how many were deleted.

    Survivors are written beside the target and then take its place (:mod:`skein.storage`); the count
    is an observation on the same pass, not a second job. ``read()`` and ``write(df, folder)`` say how
    the format is read and written where Spark's defaults won't do (headers, arrays, explicit nulls).
    """
    from ..operators.pattern import predicate
    from ..storage import swap_folder

    current = read() if read else spark.read.format(fmt).load(path)
    whole = pattern is None or pattern in ("*", {})  # everything goes: no plan is left that could count
    deleted = current.count() if whole else None
    hit = F.coalesce(predicate(current, pattern), F.lit(False))
    obs = Observation(f"dull_{uuid.uuid4().hex[:12]}")
    kept = current.limit(0) if whole else current.observe(obs, F.sum(F.when(hit, 1).otherwise(0)).alias("deleted")).where(~hit)
    if write is None:
        replace(kept, path, fmt)
    else:
        swap_folder(spark, path, lambda folder: write(kept, folder))
    return deleted if whole else int(obs.get.get("deleted") or 0)

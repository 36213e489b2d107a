"""Relational sources and sinks over Spark's JDBC data source.

Thin option mappings: reads are split into parallel range queries on ``partition_column`` and
Spark pushes filters and projections into the generated SQL. (Not exercised here: there is no
database server or JDBC driver in the build environment.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _base(opts: dict) -> dict:
    out = {"url": opts["url"]}
    for k in ("user", "password", "driver", "fetchsize", "sessionInitStatement"):
        if opts.get(k) is not None:
            out[k] = str(opts[k])
    return out


def scan_jdbc(spark: SparkSession, opts: dict, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    r = spark.read.format("jdbc").options(**_base(opts)).option("dbtable", table)
    pc = partition_column or opts.get("partitionColumn")
    if pc:
        r = (r.option("partitionColumn", pc).option("lowerBound", str(lower if lower is not None else opts["lowerBound"]))
             .option("upperBound", str(upper if upper is not None else opts["upperBound"]))
             .option("numPartitions", str(num_partitions or opts.get("numPartitions", 8))))
    return r.load()


def list_tables(spark: SparkSession, opts: dict, like: str = "%") -> DataFrame:
    """Table names matching a LIKE pattern (``foo%``), read from the server's information schema."""
    q = "(select table_name as name from information_schema.tables) t"
    return scan_jdbc(spark, opts, q).where(F.col("name").like(like))


def write_jdbc(df: DataFrame, opts: dict, table: str, append: bool = True, batchsize: int = 1000,
               column_types: str | None = None):
    """Bulk load with batched inserts, one connection per partition; ``column_types`` maps
    string sizes to column definitions for a created table (``"Foo VARCHAR(64)"``)."""
    w = (df.write.format("jdbc").options(**_base(opts)).option("dbtable", table)
         .option("batchsize", str(batchsize)).mode("append" if append else "overwrite"))
    if column_types:
        w = w.option("createTableColumnTypes", column_types)
    w.save()


def varchar_columns(engram) -> str:
    """``createTableColumnTypes`` from the ``size`` of keyword/text fields of an encoding."""
    from ..plans.engram import load_engram, normalize_fields

    parts = []
    for f in normalize_fields(load_engram(engram)["fields"]):
        if f["type"] in ("keyword", "text", "string") and f.get("size"):
            parts.append(f"`{f['name']}` VARCHAR({int(f['size'])})")
    return ", ".join(parts)

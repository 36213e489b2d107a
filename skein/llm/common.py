"""Shared helpers of the training-data operators: tables, shared scratch, flat text buffers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds the memory of a Python worker.
SLICE_BYTES = 2 << 20
#: Bytes of text whose words, n-grams or tokens, many times their size, are made at once.
PART_BYTES = 256 << 10


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application (its functions run in Python workers)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="skein-ship-"), "skein.zip")
        with zipfile.ZipFile(name, "w") as z:
            for folder, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("skein", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(name)
        _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may go without the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="skein-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/skein-llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/skein-llm/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column as one array, and the n + 1 offsets; null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes (one row at least: a longer text is a slice by itself)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def map_texts(df: DataFrame, text_col: str, out_fields: str, fn: Callable, keep: list[str]) -> DataFrame:
    """Add columns computed from a text column, in Arrow batches.

    ``fn(raw, offsets) -> dict of arrays`` gets the flat bytes of some rows and returns one value
    per row for each name in ``out_fields`` (a DDL string). ``keep`` columns are carried along.
    """
    at = keep.index(text_col) if text_col in keep and dict(df.dtypes)[text_col] == "string" else len(keep)
    extra = [F.col(f"`{text_col}`").cast("string").alias("__text")] if at == len(keep) else []
    part = df.select(*[F.col(f"`{c}`") for c in keep], *extra)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema.fields[:len(keep)]), out_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(at))
            for i, j in slices(offsets):
                out = fn(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                cols = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()]
                yield pa.RecordBatch.from_arrays([*cols, *arrays], names=[*batch.schema.names[:len(keep)], *out])

    return part.mapInArrow(run, schema)


def held_out_bucket(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``; an id of null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


#: bits of the tables that pick rows while reading, whatever the size of the data
TABLE_BITS = 24


def bit_table(hashes: DataFrame, col: str) -> np.ndarray:
    """Marks of the top TABLE_BITS of 64-bit hashes. What is collected is bounded by the table's size."""
    got = hashes.select(F.shiftrightunsigned(F.col(col), 64 - TABLE_BITS).alias("slot")) \
        .select(F.expr("int(shiftright(slot, 5))").alias("k"), F.expr("shiftleft(1L, int(slot % 32))").alias("v")) \
        .groupBy("k").agg(F.bit_or("v").alias("v")).toArrow()
    bits = np.zeros(1 << TABLE_BITS - 5, np.uint32)
    bits[got["k"].to_numpy()] = got["v"].to_numpy().astype(np.uint32)
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until none of the frames has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_by_table(df: DataFrame, key, rows: DataFrame, row_key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose 64-bit ``key`` may be among ``rows[row_key]``, and rows for which
    it surely isn't. Only the first part then needs a join on the key, so the rest isn't shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(bit_table(rows, row_key)))

    @F.pandas_udf("boolean")
    def may_be(h: pd.Series) -> pd.Series:
        slot = h.to_numpy().view(np.uint64) >> np.uint64(64 - TABLE_BITS)
        return pd.Series(np.unpackbits(shared.value[(slot >> np.uint64(3)).astype(np.int64)][:, None], axis=1)[np.arange(len(h)), (slot & np.uint64(7)).astype(np.int64)].astype(bool))

    may_be = may_be.asNondeterministic()  # else a join on the key also runs it on the other side, whose rows all pass
    return df.where(may_be(key)), df.where(~may_be(key))


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first bytes of all characters, and their code points (valid UTF-8)."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    first = raw[lead]
    cp = first.astype(np.int32)
    if len(raw) and first.max() >= 0xC0:
        padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
        for low, mask, size in ((0xC0, 0x1F, 2), (0xE0, 0x0F, 3), (0xF0, 0x07, 4)):
            at = np.flatnonzero((first >= low) & (first < {0xC0: 0xE0, 0xE0: 0xF0, 0xF0: 0x100}[low]))
            if len(at):
                v = first[at].astype(np.int32) & mask
                for k in range(1, size):
                    v = v << 6 | padded[lead[at] + k]
                cp[at] = v
    return lead, cp

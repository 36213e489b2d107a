"""A keyed store that is changed in place, bucket by bucket.

Rows lie in folders by a hash of their key (``__bucket=n``). An upsert reads and rewrites only the
buckets that hold a key of the changes; all other files stay as they are, so its cost follows the
changes, not the store. ``_store.json`` names the keys, the number of buckets and the columns. New
columns are added to it: rows written before have nulls there.

A change is made in two steps: the new contents of its buckets are written completely to a folder
beside the store (``<store>__change-…``), then a note in the store names that folder and the buckets, and
only then are the buckets exchanged, by Spark's dynamic partition overwrite. If a job dies in
between, the next access finds the note and exchanges the buckets again from the folder, which
comes to the same. Without a note nothing was changed.

Every access reads the columns from the note of the store and casts nothing: a column that comes back
with another type raises.

The note also holds what must advance together with the data: the mark up to which a source was
synchronised, and per stream the last batch that was merged. As both are part of the change, they are
never ahead of the data nor behind it: a batch that is replayed is known, and does nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import quote_part
from ..operators.keyed import bucket_of
from ..operators.maintain import upsert
from ..storage import _fs, dataset_exists

BUCKETS = 64
_BUCKET = "__bucket"
_META, _CHANGE = "_store.json", "_change.json"


def _read_note(spark: SparkSession, path: str, name: str) -> dict | None:
    fs, folder = _fs(spark, path)
    p = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def _write_note(spark: SparkSession, path: str, name: str, value: dict) -> None:
    """Written beside and renamed, so that a note is there whole or not at all."""
    fs, folder = _fs(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fresh, target = hadoop(folder, f"{name}.{uuid.uuid4().hex[:8]}"), hadoop(folder, name)
    stream = fs.create(fresh, True)
    stream.write(bytearray(json.dumps(value, ensure_ascii=False).encode("utf-8")))
    stream.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(fresh, target):
        raise OSError(f"cannot write {name} of {path}")


def _drop(spark: SparkSession, path: str, *names: str) -> None:
    fs, folder = _fs(spark, path)
    for n in names:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, n), True)


def _exchange(spark: SparkSession, path: str, change: dict) -> None:
    """Put the buckets of a written change in place and forget the change."""
    schema = T.StructType.fromJson(change["meta"]["schema"])
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])).parquet(change["folder"])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs, folder = _fs(spark, path)
    for b in change["emptied"]:  # buckets that have no rows any more aren't overwritten
        fs.delete(hadoop(folder, f"{_BUCKET}={b}"), True)
    _write_note(spark, path, _META, change["meta"])
    _drop(spark, path, _CHANGE)
    other, p = _fs(spark, change["folder"])
    other.delete(p, True)
    spark.catalog.refreshByPath(path)


def _meta(spark: SparkSession, path: str) -> dict | None:
    """The note of the store, after finishing a change that a job has left behind; null if there is no store."""
    change = _read_note(spark, path, _CHANGE)
    if change is not None:
        _exchange(spark, path, change)
    return _read_note(spark, path, _META)


def store_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and _meta(spark, path) is not None


def _rows(spark: SparkSession, path: str, meta: dict) -> DataFrame:
    schema = T.StructType.fromJson(meta["schema"])
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store. Conditions on its columns reach the scan."""
    meta = _meta(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no keyed store at {path}")
    return _rows(spark, path, meta).drop(_BUCKET)


def read_keys(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among ``wanted`` (its columns are the store's keys): only their buckets are read."""
    meta = _meta(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no keyed store at {path}")
    keys = meta["keys"]
    wanted = wanted.select(*[F.col(quote_part(k)).cast(T.StructType.fromJson(meta["schema"])[k].dataType).alias(k) for k in keys]).distinct()
    buckets = _touched(wanted, keys, meta["buckets"])
    return _rows(spark, path, meta).where(F.col(_BUCKET).isin(buckets)).drop(_BUCKET).join(wanted, keys, "left_semi")


def _touched(rows: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """The buckets of the rows' keys: as many as the store has at most."""
    return sorted(r["b"] for r in rows.select(bucket_of(rows, keys, buckets).alias("b")).distinct().collect())


def _union_schema(old: T.StructType, new: T.StructType, path: str) -> T.StructType:
    fields = list(old.fields)
    for f in new.fields:
        if f.name not in old.fieldNames():
            fields.append(T.StructField(f.name, f.dataType, True))
        elif old[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name!r} of {path} is {old[f.name].dataType.simpleString()}, the change has {f.dataType.simpleString()}")
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def _write_change(rows: DataFrame, path: str, meta: dict, touched: list[int]) -> None:
    """``rows`` become the contents of the ``touched`` buckets."""
    spark, keys = rows.sparkSession, meta["keys"]
    folder = f"{path.rstrip('/')}__change-{uuid.uuid4().hex[:8]}"
    # a bucket is written by as many tasks as its share of the rows
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(_BUCKET, bucket_of(rows, keys, meta["buckets"])).repartitionByRange(parts, _BUCKET, F.xxhash64(*[F.col(quote_part(k)) for k in keys]))
    dealt.write.partitionBy(_BUCKET).parquet(folder)
    schema = T.StructType.fromJson(meta["schema"])
    left = spark.read.schema(T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])).parquet(folder)
    full = {r[_BUCKET] for r in left.select(_BUCKET).distinct().collect()}
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    change = {"folder": folder, "meta": meta, "emptied": [b for b in touched if b not in full]}
    _write_note(spark, path, _CHANGE, change)
    _exchange(spark, path, change)


def upsert_store(df: DataFrame, path: str, keys: list[str], order: list[str] | None = None, buckets: int = BUCKETS,
                 batch: tuple[str, int] | None = None, marks: dict | None = None) -> int:
    """Merge ``df`` into the store at ``path`` (made with ``buckets`` buckets if there is none); returns how
    many buckets were rewritten.

    Rules as :func:`skein.operators.maintain.upsert`. Columns that only the store or only ``df`` has are
    kept, null where the other has none. ``batch``, a stream's name and the number of its batch, makes
    the merge happen once: a batch not above the stream's last one changes nothing. ``marks`` are noted.
    """
    spark = df.sparkSession
    keys = [keys] if isinstance(keys, str) else list(keys)
    meta = _meta(spark, path) if _fs(spark, path)[0].exists(_fs(spark, path)[1]) else None
    if meta is None:
        if dataset_exists(spark, path):
            raise ValueError(f"{path} holds something that is no keyed store")
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        meta = {"keys": list(keys), "buckets": int(buckets), "schema": schema.jsonValue()}
        meta = _advanced(meta, batch, marks)
        fresh = upsert(df.limit(0), df, keys, order)
        _write_change(fresh, path, meta, [])
        return len(_touched(read_store(spark, path), keys, meta["buckets"]))
    if meta["keys"] != list(keys):
        raise ValueError(f"the store at {path} is keyed by {meta['keys']}, not {list(keys)}")
    if batch is not None and meta.get("batches", {}).get(batch[0], -1) >= batch[1]:
        return 0
    schema = _union_schema(T.StructType.fromJson(meta["schema"]), df.schema, path)
    whole = df.select(*[F.col(quote_part(f.name)) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    after = _advanced(meta | {"schema": schema.jsonValue()}, batch, marks)
    touched = _touched(whole, keys, meta["buckets"])
    if not touched:  # nothing but the note changes, if that
        if after != meta:
            _write_note(spark, path, _META, after)
        return 0
    current = _rows(spark, path, after).where(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
    _write_change(upsert(current, whole, keys, order), path, after, touched)
    return len(touched)


def _advanced(meta: dict, batch: tuple[str, int] | None, marks: dict | None) -> dict:
    if batch is not None:
        meta = meta | {"batches": meta.get("batches", {}) | {batch[0]: int(batch[1])}}
    if marks:
        meta = meta | {"marks": meta.get("marks", {}) | marks}
    return meta


def _mark_text(c, dt: T.DataType):
    """A value of the sequence field as text that reads back to the same value."""
    return F.unix_micros(c).cast("string") if isinstance(dt, T.TimestampType) else c.cast("string")


def _mark_value(text: str, dt: T.DataType):
    return F.timestamp_micros(F.lit(int(text))) if isinstance(dt, T.TimestampType) else F.lit(text).cast(dt)


def sync_store(src: DataFrame, path: str, field: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Bring a store up to date with ``src`` by a sequence field; returns how many rows were merged.

    The mark, the largest value merged so far, is part of the store's note and advances with the data.
    Rows above the mark are new. Rows at the mark are too unless the store has a row of that
    key and mark: a row that arrives late with a value equal to the mark isn't lost. The comparison
    reaches the source's scan. Rows without a value in ``field`` have no place in the sequence
    and aren't taken.
    """
    from ..session import staged

    spark, keys = src.sparkSession, [keys] if isinstance(keys, str) else list(keys)
    meta = _meta(spark, path) if _fs(spark, path)[0].exists(_fs(spark, path)[1]) else None
    c, dt = F.col(quote_part(field)), src.schema[field].dataType
    mark = (meta or {}).get("marks", {}).get(field)
    if mark is None:
        new = src.where(c.isNotNull())
    else:
        low = _mark_value(mark, dt)
        had = _rows(spark, path, meta).where(c == low).select(*[quote_part(k) for k in keys]).distinct()
        new = src.where(c > low).unionByName(src.where(c == low).join(had, keys, "left_anti").select(*[F.col(quote_part(n)) for n in src.columns]))
    new = staged(new, "increment")  # what is merged and what the mark is taken of are the same rows
    seen = new.agg(F.count("*").alias("n"), _mark_text(F.max(c), dt).alias("mark")).first()
    if seen["n"] or meta is None:
        upsert_store(new, path, keys, [field], buckets, marks={field: seen["mark"]} if seen["mark"] is not None else None)
    return int(seen["n"])


def delete_from_store(spark: SparkSession, path: str, gone: DataFrame) -> int:
    """Remove the rows whose key is among ``gone``; returns how many buckets were rewritten."""
    meta = _meta(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no keyed store at {path}")
    keys = meta["keys"]
    gone = gone.select(*[F.col(quote_part(k)).cast(T.StructType.fromJson(meta["schema"])[k].dataType).alias(k) for k in keys]).distinct()
    touched = _touched(gone, keys, meta["buckets"])
    if not touched:
        return 0
    current = _rows(spark, path, meta).where(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
    _write_change(current.join(gone, keys, "left_anti"), path, meta, touched)
    return len(touched)

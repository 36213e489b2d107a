"""Replacing a stored dataset in place without losing it.

A dataset that is rewritten (keyed upsert, pattern delete, registry save) is first written completely
to a new folder beside it. Then two renames publish it: the old folder steps aside, the new one takes
its name; only then is the old one deleted. Data is written once and the layout stays that of a plain
dataset. A failed write leaves the old version in place. Between the two renames the dataset has no
name: a reader that looks just then doesn't find it, and if the job dies there the next access through
this module puts the old version back. Where renaming a folder isn't one step (object stores copy),
that gap is as long as the copy; :mod:`skein.sinks.store` changes data bucket by bucket instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_NEW, _OLD = "__new-", "__old-"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _recover(spark: SparkSession, path: str) -> None:
    """Put a version back that a job set aside and died before replacing."""
    fs, p = _fs(spark, path.rstrip("/"))
    parent = p.getParent()
    if fs.exists(p) or parent is None or not fs.exists(parent):
        return
    aside = [s.getPath() for s in fs.listStatus(parent) if s.getPath().getName().startswith(p.getName() + _OLD)]
    if len(aside) == 1:
        fs.rename(aside[0], p)
    elif aside:
        raise OSError(f"{path} is missing and several former versions lie beside it")


def dataset_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a dataset: a file, or a folder with something in it. Errors are raised."""
    _recover(spark, path)
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return False
    return not fs.getFileStatus(p).isDirectory() or len(fs.listStatus(p)) > 0


def swap_folder(spark: SparkSession, path: str, write) -> None:
    """``write(folder)`` to a new folder beside ``path``, then give it the name ``path``."""
    base = path.rstrip("/")
    fresh, old = f"{base}{_NEW}{uuid.uuid4().hex[:8]}", f"{base}{_OLD}{uuid.uuid4().hex[:8]}"
    write(fresh)
    fs, target = _fs(spark, base)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    had = fs.exists(target)
    if had and not fs.rename(target, hadoop(old)):
        raise OSError(f"cannot set aside {base}")
    if not fs.rename(hadoop(fresh), target):
        if had:
            fs.rename(hadoop(old), target)
        raise OSError(f"cannot publish {fresh}")
    if had:
        fs.delete(hadoop(old), True)
    spark.catalog.refreshByPath(base)


def replace(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write ``df``, which may read what is at ``path``, in its place."""
    swap_folder(df.sparkSession, path, lambda folder: df.write.format(fmt).options(**options).save(folder))

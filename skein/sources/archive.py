"""Archive members as records: each zip file is expanded by the task that reads it.

``binaryFile`` lists and reads the archives in parallel (one archive per task); a
``mapInPandas`` step opens each with the standard ``zipfile`` module and emits one row per
member. Nothing passes through the driver; the largest unit of work is one archive.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_SCHEMA = "archive string, name string, size long, date timestamp, content binary"


def _expand(member_glob: str, with_content: bool):
    def run(batches):
        import datetime

        import pandas as pd

        for pdf in batches:
            out = []
            for path, blob in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(blob)) as zf:
                    for info in zf.infolist():
                        if info.is_dir() or not fnmatch.fnmatch(info.filename.rsplit("/", 1)[-1], member_glob):
                            continue
                        out.append({"archive": path, "name": info.filename, "size": info.file_size,
                                    "date": datetime.datetime(*info.date_time),
                                    "content": zf.read(info) if with_content else None})
            yield pd.DataFrame(out, columns=["archive", "name", "size", "date", "content"])
    return run


def scan_archive(spark: SparkSession, path: str, member_glob: str = "*", with_content: bool = True,
                 archive_glob: str = "*.zip") -> DataFrame:
    """One row per archive member: ``archive, name, size, date, content``."""
    arch = spark.read.format("binaryFile").option("pathGlobFilter", archive_glob).load(path).select("path", "content")
    return arch.mapInPandas(_expand(member_glob, with_content), MEMBER_SCHEMA)


def archive_lines(members: DataFrame) -> DataFrame:
    """Member contents as text lines (``archive, name, line_no, line``) for CSV/JSON-lines parsing
    with ``from_csv`` / ``from_json``."""
    text = F.decode(F.col("content"), "UTF-8")
    return members.select("archive", "name", F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")) \
        .where(F.length("line") > 0)

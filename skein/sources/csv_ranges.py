"""Large delimited files read by ranges, quoted line breaks included.

A reader that begins in the middle of a file can't tell a line break that ends a record from one inside
a quoted value. So files are read as lines, in Spark's own byte ranges, and every range is first run
through an automaton twice: as if it began outside of quotes, and as if it began inside. That gives a
map from the state at its start to the state at its end, one row per range. Composed along a file
these maps tell how each range really begins; then all ranges are cut into records independently. A
record that spans several ranges is put together from its pieces, which are the only rows that are
shuffled. Records are parsed by Spark's CSV parser, in the JVM.

The automaton follows the parser: a field is quoted if it begins with the quote; inside, two quotes
stand for one; after the closing quote everything up to the separator belongs to the field; quotes
elsewhere are ordinary characters. Lines end with LF or CR LF. Empty records are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged

WHOLE, OPENS, CONTINUES = 0, 1, 2  # kinds of pieces


class Quotes:
    """Whether the text after a line is inside of a quoted value."""

    def __init__(self, sep: str, quote: str = '"'):
        self.sep, self.quote, self.next_quoted = sep, quote, sep + quote
        q = re.escape(quote)
        # possessive: a pair of quotes is never taken apart to find an end
        self.rest = re.compile(f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}")

    def after(self, line: str, inside: bool) -> bool:
        at = 0
        while True:
            if inside:
                closing = self.rest.match(line, at)
                if closing is None:
                    return True
                at = line.find(self.sep, closing.end())
                if at < 0:
                    return False
                at += len(self.sep)
                inside = False
            if line.startswith(self.quote, at):
                at, inside = at + len(self.quote), True
                continue
            found = line.find(self.next_quoted, at)
            if found < 0:
                return False
            at, inside = found + len(self.next_quoted), True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and the byte range that they are read in."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("value", F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[str], bool]]:
    """(file, block, lines, whether the block begins with them) in reading order."""
    at = None
    for batch in batches:
        values, files, blocks = (c.to_pylist() for c in batch.columns)
        i = 0
        while i < len(values):
            key, j = (files[i], blocks[i]), i
            while j < len(values) and (files[j], blocks[j]) == key:
                j += 1
            yield *key, values[i:j], key != at
            at, i = key, j


def state_maps(lines: DataFrame, quotes: Quotes) -> DataFrame:
    """Per range: the state at its end if it begins outside and if it begins inside of quotes, and of a
    file's first range the first record (the header)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(key, out, into, head):
            cols = [pa.array([v], t) for v, t in ((key[0], pa.int64()), (key[1], pa.int64()), (out, pa.bool_()), (into, pa.bool_()), (None if head is None else "\n".join(head), pa.string()))]
            return pa.RecordBatch.from_arrays(cols, names=["file", "block", "from_outside", "from_inside", "head"])

        now, head, heading = None, None, False
        for file, block, values, begins in _runs(batches):
            if begins:
                if now is not None:
                    yield emit(*now, head)
                now, heading = [(file, block), False, True], block == 0
                head = [] if heading else None
            _, out, into = now
            for v in values:
                if heading and (out or not head) and (v.strip("\r") or head):
                    head.append(v)
                if quotes.quote in v:
                    same = out == into
                    out = quotes.after(v, out)
                    into = out if same else quotes.after(v, into)
                if heading and head and not out:
                    heading = False
            now[1], now[2] = out, into
        if now is not None:
            yield emit(*now, head)

    return lines.mapInArrow(run, "file bigint, block bigint, from_outside boolean, from_inside boolean, head string")


def inside_starts(maps: DataFrame) -> DataFrame:
    """The ranges that begin inside of quotes, by composing the maps along each file.

    A map is constant (its range ends in one state however it begins), the identity, or the swap. So a
    range begins in the value of the last constant before it, swapped once for each swap since.
    """
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("from_outside") == F.col("from_inside")
    swap = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    swaps = maps.withColumn("swaps", F.sum(swap).over(order))
    value = F.when(constant, (F.col("from_outside").cast("int") + F.col("swaps")) % 2)
    last = swaps.withColumn("value", value).withColumn("last", F.last("value", ignorenulls=True).over(before)) \
        .withColumn("past", F.coalesce(F.sum(swap).over(before), F.lit(0)))
    return last.where((F.coalesce("last", F.lit(0)) + F.col("past")) % 2 == 1).select("file", "block")


def records(lines: DataFrame, quotes: Quotes, inside: set[tuple[int, int]]) -> DataFrame:
    """file, block, number, kind and text of all pieces: whole records, and the pieces of those that span ranges."""
    shared = lines.sparkSession.sparkContext.broadcast(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            cols = list(zip(*rows)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                                              names=["file", "block", "number", "kind", "record"])

        key, state, held, number, began, rows = None, False, [], 0, True, []
        for file, block, values, begins in _runs(batches):
            if begins:
                if key is not None and held:  # the range ends inside of a value
                    rows.append((*key, number, OPENS if began else CONTINUES, "\n".join(held)))
                key, number, held = (file, block), 0, []
                state = (file, block) in shared.value
                began = not state
            for v in values:
                if quotes.quote in v:
                    state = quotes.after(v, state)
                held.append(v)
                if not state:
                    text = "\n".join(held) if len(held) > 1 else v
                    if text not in ("", "\r") or not began:  # empty records don't count
                        rows.append((file, block, number, WHOLE if began else CONTINUES, text))
                        number += 1
                    held, began = [], True
            if len(rows) >= 5000:
                yield batch_of(rows)
                rows = []
        if key is not None and held:
            rows.append((*key, number, OPENS if began else CONTINUES, "\n".join(held)))
        yield batch_of(rows)

    return lines.mapInArrow(run, "file bigint, block bigint, number bigint, kind int, record string")


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """Records put together from the pieces that several ranges hold."""
    order = Window.partitionBy("file").orderBy("block", "number")
    first = F.last(F.when(F.col("kind") == OPENS, F.col("block")), ignorenulls=True).over(order)
    return pieces.withColumn("first", first).groupBy("file", "first") \
        .agg(F.array_sort(F.collect_list(F.struct("block", "number", "record"))).alias("p")) \
        .select("file", F.col("first").alias("block"), F.col("p")[0]["number"].alias("number"), F.array_join(F.col("p.record"), "\n").alias("record"))


def _names(spark: SparkSession, head: str, sep: str) -> list[str]:
    """The names in a header record."""
    options = {"sep": sep, "quote": '"', "escape": '"', "maxColumns": "100000"}
    n = head.count(sep) + 1
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(n)])
    row = spark.range(1).select(F.from_csv(F.lit(head.rstrip("\r")), schema.simpleString()[7:-1].replace(":", " "), options).alias("r")).first()["r"]
    got = list(row)
    while got and got[-1] is None and len(got) > 1:
        got.pop()
    return [g if g is not None else f"_c{i}" for i, g in enumerate(got)]


def scan_csv_ranges(spark: SparkSession, path: str, header: bool = True, sep: str = ",", names: list[str] | None = None) -> DataFrame:
    """All values as text, as :func:`skein.sources.files.scan_csv` reads them, from ranges of the files.

    Files are read by their own header; a file that lacks a column has nulls there. Runs one job that
    reads the data once (the state maps); what reaches the driver are the distinct headers and the
    ranges that begin inside of a quoted value.
    """
    quotes = Quotes(sep)
    lines = _lines(spark, path)
    maps = staged(state_maps(lines, quotes), "csv-ranges")
    starts = {(r["file"], r["block"]) for r in inside_starts(maps).collect()}  # one per byte range at most
    pieces = records(lines, quotes, starts)
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "number", "record")
    if starts:
        cut = staged(pieces.where(F.col("kind") != WHOLE), "csv-pieces")
        whole = whole.unionByName(joined_pieces(cut))
    whole = whole.withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "PERMISSIVE"}

    def parsed(rows: DataFrame, n: int) -> DataFrame:
        schema = ", ".join(f"`_c{i}` string" for i in range(n))
        return rows.withColumn("cells", F.from_csv("record", schema, options))

    if not header:
        if names is None:
            first = maps.where("head is not null and head <> ''").select("head").limit(1).collect()
            names = [f"_c{i}" for i in range(len(_names(spark, first[0]["head"], sep)))] if first else []
        rows = parsed(whole, max(1, len(names)))
        return rows.select(*[F.col("cells")[f"_c{i}"].alias(n) for i, n in enumerate(names)])
    heads = [r["head"] for r in maps.where("head is not null and head <> ''").select("head").distinct().collect()]
    by_head = {h: _names(spark, h, sep) for h in sorted(heads)}
    out = list(dict.fromkeys(n for own in by_head.values() for n in own))
    body = whole.where("not (block = 0 and number = 0)")  # without the headers
    rows = parsed(body, max([1, *map(len, by_head.values())]))
    if len(by_head) <= 1:
        return rows.select(*[F.col("cells")[f"_c{i}"].alias(n) for i, n in enumerate(out)])
    # several headers: each file's columns by its own
    places = F.create_map(*[x for h, own in by_head.items() for x in (F.lit(h), F.array(*[F.lit(own.index(n) if n in own else -1) for n in out]))])
    heads_of = staged(maps.where("head is not null").select("file", F.element_at(places, F.col("head")).alias("places")), "csv-places")
    width = max(map(len, by_head.values()))
    cells = F.array(*[F.col("cells")[f"_c{i}"] for i in range(width)])
    rows = rows.withColumn("cells", cells).join(heads_of, "file")
    return rows.select(*[F.get(F.col("cells"), F.when(F.col("places")[i] >= 0, F.col("places")[i])).alias(n) for i, n in enumerate(out)])


"""Benchmark decontamination with a distributed positional inverted index.

The index holds postings of corpus words: (word, document, position) with the hashes of the words
around that position. Test items are looked up from their rarest words: corpus counts of all test
words come first; each window of ``window`` consecutive item words is then looked up by the word of
it that is rarest in the corpus. A posting of that word fixes an alignment of document and item
(position minus offset); the lists of the other words are intersected at the posting, whose stored
neighbours say at once how far document and item agree to both sides. Only postings of looked-up
words are stored; they are picked while a text is read, by a bit table of fixed size, and the join on
the word drops what the table lets through by chance.

Words are compared by 64-bit hashes (neighbours: 32 bits each, all that lie in the window).

Null and empty texts have no words. An item without words has no window. Words inside a window of an item
without an id are hit as others are; only the list of items can't name it. Repeated
documents each get a row; repeated items count once by id. Documents of the same id but other text
are kept apart. Other columns, of any name, are not read. Without items every document is clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PART_BYTES, TABLE_BITS, bit_table, fresh, slices, split_by_table, staged, text_buffers
from .words import alphanumeric, word_hashes

WINDOW = 10
_WORD = alphanumeric()


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, place and hash of every word: used for the items."""
    part = df.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                h, bounds, _, _ = word_hashes(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], _WORD)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["item", "words"])

    return part.mapInArrow(run, "item string, words array<bigint>").where(F.size("words") > 0).distinct()


def _picked(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.flatnonzero(table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])


def corpus_counts(docs: DataFrame, text_col: str, words: DataFrame) -> DataFrame:
    """How often each of the given words stands in all texts: word, n (0 where it has none)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bit_table(words, "word")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for i, j in slices(offsets):
                found = []
                for k, m in slices(offsets[i:j + 1], PART_BYTES):
                    h, *_ = word_hashes(raw[offsets[i + k]:offsets[i + m]], offsets[i + k:i + m + 1] - offsets[i + k], _WORD)
                    found.append(h[_picked(h, table)])
                w, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])

    got = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return words.select("word").distinct().join(got, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """word, item, q, size, around: the places of items that windows are looked up by, with the item's
    words from window - 1 before to window - 1 after (0 beyond its ends) and the words a match needs."""
    placed = items.select("item", F.xxhash64("words").alias("version"), F.posexplode("words").alias("q", "word")).join(counts, "word")
    lists = placed.groupBy("item", "version").agg(F.array_sort(F.collect_list(F.struct("q", "word", "n"))).alias("w"))
    reach = window - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for item, w in zip(frame["item"], frame["w"]):
                h, n = np.array([x["word"] for x in w], np.int64), np.array([x["n"] for x in w])
                span = min(window, len(h))
                view = np.lib.stride_tricks.sliding_window_view(n, span)
                q = np.unique(view.argmin(axis=1) + np.arange(len(view)))
                # a window whose rarest word stands nowhere cannot occur
                padded = np.concatenate([np.zeros(reach, np.int64), h, np.zeros(reach, np.int64)])
                out += [(h[k], item, k, span, (padded[k:k + 2 * reach + 1].view(np.uint64) >> np.uint64(32)).astype("<u4").tobytes()) for k in q if n[k]]
            yield pd.DataFrame(out, columns=["word", "item", "q", "size", "around"])

    return lists.select("item", "w").mapInPandas(run, "word bigint, item string, q int, size int, around binary")


def index(docs: DataFrame, looked_up: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row per document: id, text_id, n_words and the postings (word, position, neighbours) of looked-up words."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bit_table(looked_up, "word")))
    reach = window - 1
    width = 2 * reach + 1
    part = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_id"), F.col(text_col).cast("string").alias("__text"))
    kind = part.schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            for i, j in slices(offsets, PART_BYTES):
                h, bounds, _, _ = word_hashes(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], _WORD)
                at = _picked(h, table)
                owner = np.searchsorted(bounds, at, side="right") - 1
                low, high = bounds[owner], bounds[owner + 1]
                place = at[:, None] + np.arange(-reach, reach + 1)
                beyond = (place < low[:, None]) | (place >= high[:, None])
                near = (h >> np.uint64(32)).astype("<u4")[place.clip(0, max(0, len(h) - 1))] if len(h) else np.zeros((0, width), "<u4")
                near[beyond] = 1  # as no word of an item's other end
                near = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(at), [None, pa.py_buffer(np.ascontiguousarray(near))]).cast(pa.binary())
                posting = pa.StructArray.from_arrays([pa.array(h[at].view(np.int64)), pa.array((at - low).astype(np.int32)), near], names=["word", "p", "near"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), posting)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(bounds)), lists],
                                                 names=["id", "text_id", "n_words", "postings"])

    return part.mapInArrow(run, f"id {kind}, text_id bigint, n_words bigint, postings array<struct<word: bigint, p: int, near: binary>>")


def phrase_matches(indexed: DataFrame, looked_up: DataFrame, window: int) -> DataFrame:
    """id, text_id, item, first, last: stretches of documents that agree with an item in a window's words or more."""
    reach = window - 1
    lists = indexed.where(F.size("postings") > 0).select("id", "text_id", F.explode("postings").alias("x")).select("id", "text_id", "x.*")
    aligned = lists.join(looked_up, "word").select("id", "text_id", "item", "p", "size", "near", "around")
    kind = dict(indexed.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            near = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u4").reshape(n, -1)
            around = np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u4").reshape(n, -1)
            same = near == around
            left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, reach + 1:], axis=1).sum(axis=1)
            p, size = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            ok = pa.array(np.flatnonzero(same[:, reach] & (left + right + 1 >= size)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok), batch.column(2).take(ok),
                                              pa.array(p - left).take(ok), pa.array(p + right).take(ok)], names=["id", "text_id", "item", "first", "last"])

    return aligned.mapInArrow(run, f"id {kind}, text_id bigint, item string, first bigint, last bigint").distinct()


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text",
                      item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Items need an id here: it names what was found. id, text_id, item, first, last: the shortest stretches of at most ``slop`` words that hold all words of an item, in any order.

    Lists of all of an item's words are merged per document and item, beginning with documents that
    have its rarest word; the stretch that ends at a position begins at the earliest of the latest
    places of all words up to there.
    """
    words = tokens(items, item_id, item_text).where("item is not null").select("item", F.explode(F.array_distinct("words")).alias("word"))
    words = staged(words.distinct(), "proximity-words")
    counts = staged(corpus_counts(docs, text_col, words), "proximity-counts")
    ranked = words.join(counts, "word").withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy("n", "word"))) \
        .withColumn("need", F.count("*").over(Window.partitionBy("item")))
    indexed = staged(index(docs, words, id_col, text_col, 1), "proximity-index")
    lists = indexed.select("id", "text_id", F.explode("postings").alias("x")).select("id", "text_id", "x.word", "x.p")
    rare = lists.join(ranked.where("k = 1").select("word", "item"), "word").select("id", "text_id", "item").distinct()
    hits = lists.join(ranked.select("word", "item", "need"), "word")
    hits = hits.join(rare.withColumnsRenamed({"id": "rid", "text_id": "rtext", "item": "ritem"}),
                     F.col("id").eqNullSafe(F.col("rid")) & F.col("text_id").eqNullSafe(F.col("rtext")) & (F.col("item") == F.col("ritem")), "left_semi")
    fields = "first bigint, last bigint"
    kind = dict(indexed.dtypes)["id"]

    def sweep(key, frame: pd.DataFrame) -> pd.DataFrame:
        latest, out, need = {}, [], int(frame["need"].iloc[0])
        for p, w in sorted(set(zip(frame["p"], frame["word"]))):
            latest[w] = p
            if len(latest) == need and p - min(latest.values()) < slop:
                out.append((key[0], key[1], key[2], min(latest.values()), p))
        return pd.DataFrame(out, columns=["id", "text_id", "item", "first", "last"])

    return hits.groupBy("id", "text_id", "item").applyInPandas(sweep, f"id {kind}, text_id bigint, item string, {fields}")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: id, text_id, n_words, n_hit, items (sorted ids as strings) and spans (word ranges)."""
    tests = staged(tokens(items, item_id, item_text), "items")
    vocabulary = tests.select(F.explode("words").alias("word")).distinct()
    looked_up = staged(anchors(tests, corpus_counts(docs, text_col, vocabulary), window), "anchors")
    indexed = staged(index(docs, looked_up, id_col, text_col, window), "index")
    found = phrase_matches(indexed, looked_up, window)
    by_place = Window.partitionBy("id", "text_id").orderBy("first", "last", "item")
    earlier = F.coalesce(F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    hits = found.withColumn("new", F.greatest(F.lit(0), F.col("last") - F.greatest(earlier, F.col("first") - 1))) \
        .groupBy("id", "text_id").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"),
                                      F.array_sort(F.collect_set(F.struct("first", "last", "item"))).alias("spans"))
    one = indexed.select("id", "text_id", "n_words").alias("d")
    return one.join(hits.alias("h"), F.col("d.id").eqNullSafe(F.col("h.id")) & F.col("d.text_id").eqNullSafe(F.col("h.text_id")), "left") \
        .select("d.id", "d.text_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                F.coalesce("spans", F.array().cast("array<struct<first: bigint, last: bigint, item: string>>")).alias("spans"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    found = decontaminate(docs, items, window, id_col, text_col, item_id, item_text).where("n_hit > 0")
    own, own_text = fresh("bad_id", docs), fresh("bad_text", docs)
    bad = found.select(F.col("id").alias(own), F.col("text_id").alias(own_text)).distinct().withColumn("h", F.xxhash64(own, own_text))
    bad = staged(bad, "contaminated")
    text_id = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    hit, clear = split_by_table(docs, F.xxhash64(F.col(f"`{id_col}`"), text_id), bad, "h")
    clean = hit.join(bad.drop("h"), F.col(id_col).eqNullSafe(F.col(own)) & (text_id == F.col(own_text)), "left_anti")
    return clear.unionByName(clean)

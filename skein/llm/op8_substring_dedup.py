"""Repeated passages across documents by paragraph MinHash banding.

The units of comparison are paragraphs (lines) and, within them, pieces that the text itself delimits:
a piece begins where the hash of two neighbouring words is the smallest of REACH places to both sides,
so a passage is cut alike wherever it stands, also in the middle of a longer line. Units are sets of
five-word shingles; units of the same set are one class.

Classes of paragraphs with PARAGRAPH words or more are banded: BANDS bands of ROWS minwise values, tuned
for a chance of 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.998 that two paragraphs of similarity 0.8 collide.
In a bucket every class is paired with the smallest and the largest class of it; pairs are verified by
exact Jaccard similarity, or, for paragraphs of few shingles, by edit distance of the words. That is
all pairs of a bucket of three. The classes of larger buckets that are still in several components
(paragraphs made from a template) are finished exactly: a prefix filter pairs each with all others of
them that share one of its rarest shingles, which similar sets must (``finished``). So every similar
pair that shares a bucket ends in one component. Verified links are clustered by connected
components. Paragraphs of up to SHORT words also have a bucket by each of their ends, so that one edited
word is always found. Shorter units count as repeated when their sets are equal.

Neighbouring repeated units are joined; stretches of MIN_WORDS words or more are returned with the
component of their longest unit. The first place of a component (smallest id, then position) is kept,
the others are marked as removals.

Null and empty texts have no units. Rows without an id take no part. Repeats within one document only
don't count. Repeated rows are one document. Other columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, drop_staged, slices, staged, text_buffers
from .components import connected_components
from .words import mixed, non_blank, rolled, shingles, word_hashes

WORDS = 5
PERCENT = 80
REACH = 4
PARAGRAPH = 16     # words from which a paragraph is banded
MIN_WORDS = 16     # words of a stretch that is returned
ROWS, BANDS = 2, 6
HALF = 8           # words of an end; of PARAGRAPH words and one edit, one end is whole
SHORT = 40         # words up to which edit distance counts
SLOTS = 20         # bits of the table of shingle counts that orders shingles
GROUP = 1024       # members of a shingle that are compared at once; larger groups are pairs of such parts
_WORD = non_blank()
_RNG = np.random.default_rng(8)
_A = _RNG.integers(1, 1 << 62, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


class Units:
    """Units of some texts: text index, first word, end word, whether a paragraph, and their class."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, words: int = WORDS):
        h, bounds, begin, stop = word_hashes(raw, offsets, _WORD)
        n = len(h)
        self.begin, self.stop, self.offsets = begin, stop, offsets
        lines = np.cumsum(raw == 10)
        line = lines[begin] if n else np.zeros(0, np.int64)
        fresh = np.ones(n, bool)                      # words that begin a paragraph
        fresh[1:] = line[1:] != line[:-1]
        fresh[bounds[:-1][bounds[:-1] < n]] = True
        pair = np.concatenate([np.full(1, np.iinfo(np.uint64).max, np.uint64), rolled(h, 2)]) if n else h
        far = np.full(REACH, np.iinfo(np.uint64).max, np.uint64)
        wide = np.concatenate([far, pair, far])
        least = wide[:n].copy()
        for k in range(1, 2 * REACH + 1):
            np.minimum(least, wide[k:k + n], out=least)
        cut = fresh | (pair == least)
        para = np.flatnonzero(fresh)
        para_end = np.append(para[1:], n)
        piece = np.flatnonzero(cut)
        piece_end = np.append(piece[1:], n)
        whole = fresh[piece] & np.isin(piece_end, para_end)
        banded = para_end - para >= PARAGRAPH
        # a piece that is its whole paragraph is listed once
        keep = ~(whole & (piece_end - piece >= PARAGRAPH)) & (piece_end - piece >= words)
        first = np.concatenate([para[banded], piece[keep]])
        last = np.concatenate([para_end[banded], piece_end[keep]])
        order = np.argsort(first, kind="stable")
        self.first, self.last = first[order], last[order]
        self.banded = np.concatenate([np.ones(banded.sum(), bool), np.zeros(keep.sum(), bool)])[order]
        self.owner = np.searchsorted(bounds, self.first, side="right") - 1 if n else np.zeros(0, np.int64)
        # all units' shingles at once: the shingles that begin in a unit and end in it
        all_of = rolled(h, words)
        count = np.maximum(self.last - self.first - words + 1, 0)
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.first - ends[:-1], count) + np.arange(ends[-1])
        self.shingles, self.ends = all_of[at] if n >= words else np.zeros(0, np.uint64), ends
        with np.errstate(over="ignore"):
            m = mixed(self.shingles)
            # a repeated shingle would count twice: rare, and alike in equal units
            self.cls = mixed(np.add.reduceat(m, ends[:-1]) + count.astype(np.uint64)) if len(count) else np.zeros(0, np.uint64)
        self.bounds, self.words = bounds, h

    def low(self) -> np.ndarray:
        """Minwise values of the banded units."""
        out = np.zeros((len(self.first), ROWS * BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(ROWS * BANDS):
                if len(self.shingles):
                    out[:, k] = np.minimum.reduceat(self.shingles * _A[k] + _B[k], self.ends[:-1])
        return out[self.banded]


def bands(units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and class of each banded unit in each band, and for short ones by the first and the last HALF words.

    A short paragraph with one edited word shares few shingles with the other, but one of its ends.
    """
    low = units.low()
    with np.errstate(over="ignore"):
        out = np.zeros((len(low), BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(low), b + 1, np.uint64)
            for r in range(ROWS):
                key = mixed(key * _A[0] + low[:, b * ROWS + r])
            out[:, b] = key
        cls, first, last = units.cls[units.banded], units.first[units.banded], units.last[units.banded]
        short = np.flatnonzero(last - first <= SHORT)
        ends = rolled(units.words, HALF)
        tips = [mixed(ends[at[short]] + np.uint64(k + 1)) for k, at in enumerate((first, last - HALF))] if len(short) else []
    return np.concatenate([out.ravel(), *tips]), np.concatenate([np.repeat(cls, BANDS), *(cls[short] for _ in tips)])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).where(F.col("id").isNotNull() & (F.col("t") != ""))


def _mapped(rows: DataFrame, schema: str, fn) -> DataFrame:
    """``fn(units, ids) -> dict of arrays`` over the units of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            ids = np.asarray(batch.column(0))
            for i, j in slices(offsets):
                out = fn(Units(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]), ids[i:j])
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], names=list(out))

    return rows.mapInArrow(run, schema)


def _marked(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return table[(h >> np.uint64(40)).astype(np.int64)]


def edit_distance(x: list[int], y: list[int], most: int) -> int:
    """Levenshtein distance of word lists, or ``most`` + 1 if it is larger."""
    if abs(len(x) - len(y)) > most:
        return most + 1
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


def edits(words: int, percent: int) -> int:
    """Edits that a paragraph of up to SHORT words may have."""
    return np.maximum(1, words * (100 - percent) // 400)


def prefix_length(n_words: int, n_shingles: int, percent: int) -> int:
    """How many of its first shingles, in any order that is common to all, meet those of every similar paragraph.

    Jaccard similarity needs percent of the shingles in common; an edit touches at most WORDS of them.
    """
    far = n_shingles + (-percent * n_shingles // 100)
    if n_words <= SHORT:
        far = max(far, WORDS * edits(min(SHORT, n_words + edits(SHORT, percent)), percent))
    return min(n_shingles, far + 1)


def merging_links(cls: np.ndarray, label: np.ndarray, texts: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Similar pairs of a group that join two components; members of one component aren't compared."""
    n = len(cls)
    sets = [np.unique(rolled(x, WORDS)) for x in texts]
    size, length = np.array([len(s) for s in sets]), np.array([len(x) for x in texts])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    ends = np.concatenate([[0], np.cumsum(size)])
    holders = owner[np.argsort(code, kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(code))])
    _, part = np.unique(label, return_inverse=True)
    out = []
    for i in range(n - 1):
        if not (part[i + 1:] != part[i]).any():
            continue
        both = np.bincount(np.concatenate([holders[at[c]:at[c + 1]] for c in code[ends[i]:ends[i + 1]]]), minlength=n)
        most = edits(np.maximum(length, length[i]), percent)
        near = 100 * both >= percent * (size + size[i] - both)
        may = near | ((np.maximum(length, length[i]) <= SHORT) & (both >= np.maximum(size, size[i]) - WORDS * most))
        for j in (i + 1 + np.flatnonzero(may[i + 1:] & (part[i + 1:] != part[i]))).tolist():
            if part[j] != part[i] and (near[j] or edit_distance(texts[i].tolist(), texts[j].tolist(), int(most[j])) <= most[j]):
                out.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
                part[part == part[j]] = part[i]
    return out


def finished(left: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join components, from an exact similarity join of ``left`` (cls, label, words).

    Shingles are ordered by how often they occur (counted in a table of fixed size), then by their hash.
    Similar classes share one of the first ``prefix_length`` shingles of both. Shingles with the same
    classes are one group; groups of one component are dropped; the others are compared in full.
    """
    spark = left.sparkSession
    slot = np.uint64(64 - SLOTS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(2):
                s, n = np.unique(np.unique(rolled(np.frombuffer(x.as_py(), "<u8").astype(np.uint64), WORDS)) >> slot, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(n)], names=["slot", "n"])

    got = left.mapInArrow(counted, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << SLOTS, np.int64)
    often[got["slot"].to_numpy()] = got["n"].to_numpy()
    shared = spark.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, label, x in zip(batch.column(0), batch.column(1), batch.column(2)):
                x = np.frombuffer(x.as_py(), "<u8").astype(np.uint64)
                s = np.unique(rolled(x, WORDS))
                s = s[np.lexsort((s, shared.value[(s >> slot).astype(np.int64)]))][:prefix_length(len(x), len(s), percent)]
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), cls.as_py())), pa.array(np.full(len(s), label.as_py()))],
                                                 names=["shingle", "cls", "label"])

    held = staged(left.mapInArrow(prefixes, "shingle bigint, cls bigint, label bigint"), "prefixes")
    groups = held.groupBy("shingle").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(cls))").alias("all"), F.min("label").alias("low"), F.max("label").alias("high")) \
        .where("low != high").groupBy("n", "all").agg(F.min("shingle").alias("shingle")).select("shingle", F.expr(f"int(ceil(n / {GROUP}))").alias("k"))
    groups = staged(groups, "shingle-groups")
    own = F.pmod(F.xxhash64("cls", "shingle"), F.col("k")).cast("int")
    parts = held.join(groups, "shingle").withColumn("own", own) \
        .withColumn("other", F.explode(F.expr("sequence(0, k - 1)"))).select("shingle", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "cls")
    parts = parts.join(left, "cls").select("shingle", "p", "q", "cls", "label", "words")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows):
            got = merging_links(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]),
                                [np.frombuffer(r[2], "<u8").astype(np.uint64) for r in rows], percent) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

        key, rows = None, []
        for batch in batches:
            for *now, cls, label, words in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    yield links(rows)
                    key, rows = now, []
                rows.append((cls, label, words))
        yield links(rows)

    links = parts.repartition("shingle", "p", "q").sortWithinPartitions("shingle", "p", "q").mapInArrow(compared, "a bigint, b bigint").distinct()
    links = staged(links, "finishing-links")
    drop_staged(held, groups)
    return links


def near_links(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: verified links between classes of paragraphs that aren't equal, enough for their components."""
    spark = rows.sparkSession
    buckets = _mapped(rows, "bucket bigint, cls bigint", lambda u, ids: {
        k: v.view(np.int64) for k, v in zip(("bucket", "cls"), bands(u))}) \
        .groupBy("bucket").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low != high")
    buckets = staged(buckets, "buckets")
    live = spark.sparkContext.broadcast(np.packbits(bit_table(buckets, "bucket")))

    def members(u, ids):
        b, cls = bands(u)
        at = _marked(np.unpackbits(live.value).astype(bool), b)
        return {"bucket": b[at].view(np.int64), "cls": cls[at].view(np.int64)}

    met = staged(_mapped(rows, "bucket bigint, cls bigint", members).distinct().join(buckets, "bucket"), "bucket-members")
    pairs = met.select(F.explode(F.array(F.struct(F.least("cls", "low").alias("a"), F.greatest("cls", "low").alias("b")),
                                         F.struct(F.least("cls", "high").alias("a"), F.greatest("cls", "high").alias("b")))).alias("p")) \
        .select("p.*").where("a != b").distinct()
    pairs = staged(pairs, "paragraph-pairs")
    named = staged(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "paragraph-classes")
    wanted = spark.sparkContext.broadcast(np.packbits(bit_table(named, "cls")))

    def contents(u, ids):
        at = np.flatnonzero(u.banded & _marked(np.unpackbits(wanted.value).astype(bool), u.cls))
        cls, where = np.unique(u.cls[at], return_index=True)
        at = at[where]
        return {"cls": cls.view(np.int64),
                "words": pa.array([u.words[u.first[i]:u.last[i]].astype("<u8").tobytes() for i in at], pa.binary())}

    texts = _mapped(rows, "cls bigint, words binary", contents).join(named, "cls", "left_semi").groupBy("cls").agg(F.min("words").alias("words"))
    texts = staged(texts, "paragraph-words")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), "<u8").astype(np.uint64), np.frombuffer(y.as_py(), "<u8").astype(np.uint64)
                p, q = np.unique(rolled(x, WORDS)), np.unique(rolled(y, WORDS))
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(k)
                elif max(len(x), len(y)) <= SHORT:  # of few shingles, one edit already touches a fifth
                    most = edits(max(len(x), len(y)), percent)
                    if edit_distance(x.tolist(), y.tolist(), most) <= most:
                        keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    joined = pairs.join(texts.withColumnsRenamed({"cls": "a", "words": "x"}), "a").join(texts.withColumnsRenamed({"cls": "b", "words": "y"}), "b")
    links = staged(joined.select("a", "b", "x", "y").mapInArrow(similar, "a bigint, b bigint"), "paragraph-links")
    # buckets of more than three classes in several components: their other pairs are still to be compared
    labels = connected_components(links) if links.limit(1).count() else None
    label = F.col("cls") if labels is None else F.coalesce("label", "cls")
    placed = met if labels is None else met.join(labels.withColumnRenamed("v", "cls"), "cls", "left")
    placed = staged(placed.select("bucket", "cls", label.alias("label")), "bucket-labels")
    mixed_buckets = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("first"), F.max("label").alias("last")).where("n > 3 and first != last")
    left = staged(placed.join(mixed_buckets.select("bucket"), "bucket", "left_semi").select("cls", "label").distinct().join(texts, "cls"), "left")
    if left.limit(1).count():
        links = staged(links.union(finished(left, percent)), "all-links")
    drop_staged(buckets, met, pairs, named, texts, placed, left)
    return links


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """id, start, stop (byte range in the UTF-8 text), n_words, component_id, first_id and kept of every
    stretch of repeated units; ``first_id`` is the smallest id that has the component."""
    spark = docs.sparkSession
    rows = _texts(docs, id_col, text_col)
    classes = staged(_mapped(rows, "cls bigint, id bigint", lambda u, ids: {"cls": u.cls.view(np.int64), "id": ids[u.owner]})
                     .groupBy("cls").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high"), "classes")
    links = near_links(rows, percent)
    ends = links.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    labels = connected_components(links) if links.limit(1).count() else None
    repeated = classes.select("cls").union(ends).distinct()
    label = F.col("cls") if labels is None else F.coalesce("label", "cls")
    named = repeated if labels is None else repeated.join(labels.withColumnRenamed("v", "cls"), "cls", "left")
    named = staged(named.select("cls", label.alias("component_id")), "repeated")
    wanted = spark.sparkContext.broadcast(np.packbits(bit_table(named, "cls")))

    def places(u, ids):
        at = np.flatnonzero(_marked(np.unpackbits(wanted.value).astype(bool), u.cls))
        start = u.offsets[u.owner[at]]
        return {"cls": u.cls[at].view(np.int64), "id": ids[u.owner[at]], "first": u.first[at] - u.bounds[u.owner[at]], "last": u.last[at] - u.bounds[u.owner[at]],
                "start": u.begin[u.first[at]] - start, "stop": u.stop[u.last[at] - 1] - start}

    found = _mapped(rows, "cls bigint, id bigint, first bigint, last bigint, start bigint, stop bigint", places).join(named, "cls").drop("cls").distinct()
    found = staged(found, "places")
    # a component of one document only is no repeat across documents
    across = found.groupBy("component_id").agg(F.min(F.struct("id", "start")).alias("origin"), F.max("id").alias("high")).where("origin.id != high")
    across = staged(across, "components")  # joined as a scan, so that the places of a large component can be split
    found = found.join(across, "component_id").withColumn("kept", F.expr("origin.id = id and origin.start = start")).withColumn("first_id", F.col("origin.id"))
    # stretches: units that touch or overlap and are all kept or all removed
    by_place = Window.partitionBy("id", "kept").orderBy("first", F.desc("last"), "component_id")
    reached = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(F.col("first") <= reached + (WORDS - 1), 0).otherwise(1))
    runs = opened.withColumn("run", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    longest = F.max_by(F.struct("component_id", "first_id"), F.struct(F.col("last") - F.col("first"), -F.col("first"), "component_id"))
    out = runs.groupBy("id", "kept", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"),
                                                (F.max("last") - F.min("first")).alias("n_words"), longest.alias("x"))
    return out.where(F.col("n_words") >= min_words).select(F.col("id").alias(id_col), "start", "stop", "n_words", "x.component_id", "x.first_id", "kept")

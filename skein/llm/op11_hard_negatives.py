"""Hard negatives by threshold joins over an inverted index with norm bounds.

Vectors of whole numbers are indexed in blocks: per block and dimension a list of the rows that have
the dimension, dimensions with the most weight first. Anchors ask a block for the rows whose inner
product reaches a threshold of their own:

* a row's last dimensions are left out of the lists as far as their norm times the norm of the
  anchors' same dimensions stays under the lowest threshold: a row that reaches it must then have a
  positive partial score in the dimensions that are listed;
* partial scores are accumulated list by list; a pair is dropped as soon as partial score plus the
  product of the remaining norms is under the anchor's threshold, and a row leaves the lists when no
  anchor is left for it;
* the pairs that remain get their exact score in whole numbers.

Windows fill in turns. Thresholds begin where, by the scores of a bounded sample (SAMPLE rows),
about FIRST rows are expected above; anchors whose windows don't fill ask again with a threshold for
WIDER times as many rows, and in the end without one. The sample only decides how many turns it takes. First
the positives (the best ``k`` other rows of the anchor's label), then for each positive the best
rows of other labels between ``low`` / 100 of its score and its score.

All rows are indexed and met by all anchors, in blocks: up to ANCHORS anchors at a time are
broadcast, so no row is shuffled for them; a task keeps k rows per anchor or window at most.

Rows without id, label or vector, with a component that is null or not finite, or of another length
than most take no part. Rows that repeat an id are candidates each, never for an anchor of that id; an
anchor that repeats asks once, by its smallest row. Equal scores go to the smaller id. An empty table
gives no rows. Other columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, staged

BLOCK = 4096
ANCHORS = 16384
TILE = 512      # anchors whose partial scores are held at once
CHUNK = 8       # dimensions between two prunings
SAMPLE = 4096
FIRST = 60
WIDER = 12
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max  # no threshold
_NORMAL = NormalDist()


def usable(df: DataFrame, id_col: str, label_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """id, label and vector (whole numbers) of the rows that take part, their length and count."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").where(ok)
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d, n = (most["d"], most["n"]) if most else (0, 0)
    return rows.where(F.size("v") == F.lit(d)).select("id", "label", F.transform("v", lambda x: x.cast("bigint")).alias("v")), d, n


def dimension_order(rows: DataFrame, d: int) -> np.ndarray:
    """Dimensions by descending sum of squares."""
    sums = rows.select(*[F.sum(F.pow(F.col("v")[i].cast("double"), 2)).alias(f"s{i}") for i in range(d)]).first()
    return np.argsort([-(x or 0.0) for x in sums], kind="stable") if d else np.zeros(0, np.int64)


def tail_norms(v: np.ndarray) -> np.ndarray:
    """Per row and chunk border: the norm of what comes from there on (a little above it for rounding)."""
    squares = np.concatenate([v.astype(np.float64) ** 2, np.zeros((len(v), -v.shape[1] % CHUNK))], axis=1)
    chunks = squares.reshape(len(v), -(-v.shape[1] // CHUNK), CHUNK).sum(axis=2)
    tails = np.zeros((len(v), chunks.shape[1] + 1))
    tails[:, :-1] = np.cumsum(chunks[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(tails) * (1 + 1e-9)


def blocks(rows: DataFrame, order: np.ndarray) -> DataFrame:
    """The rows in blocks of up to BLOCK, components in ``order``: ids, labels, vectors as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids, labels, v):
            return pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (ids, labels, v)], names=["ids", "labels", "vectors"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)[:, order]]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            while len(held[0]) >= BLOCK:
                yield emit(*(x[:BLOCK] for x in held))
                held = [x[BLOCK:] for x in held]
        if held is not None and len(held[0]):
            yield emit(*held)

    return rows.mapInArrow(run, "ids binary, labels binary, vectors binary")


class Index:
    """One block: lists per dimension of the rows that have it, and norms of what remains."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.whole = np.frombuffer(vectors, "<i8").reshape(len(self.ids), -1)
        self.tails = tail_norms(self.whole)

    def above(self, anchors: np.ndarray, tails: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of all pairs that reach the anchor's threshold ``low``."""
        d = self.whole.shape[1]
        borders = self.tails.shape[1] - 1
        if (low == LOWEST).any() or not d:  # no threshold: every pair counts
            keep = np.ones((len(anchors), len(self.ids)), bool)
            a, r = np.nonzero(keep)
        else:
            # a row is listed up to the border where its rest and the anchors' rest can't reach the lowest threshold
            rest = tails.max(axis=0)
            listed = (self.tails * rest >= low.min()).sum(axis=1)
            listed = np.minimum(listed, borders)
            rows = np.flatnonzero(listed)
            rows = rows[np.argsort(-listed[rows], kind="stable")]
            part = np.zeros((len(anchors), len(rows)))
            wide = anchors.astype(np.float64)
            for c in range(borders):
                n = int(np.searchsorted(-listed[rows], -c, side="left"))  # rows that are listed beyond border c
                if not n:
                    break
                at = slice(c * CHUNK, (c + 1) * CHUNK)
                part[:, :n] += wide[:, at] @ self.whole[rows[:n], at].T.astype(np.float64)
                stop = np.minimum(listed[rows], c + 1)
                bound = tails[:, stop] * self.tails[rows, stop]
                slack = 1e-9 * (tails[:, :1] * self.tails[rows, 0])
                alive = (part + bound + slack >= low[:, None]).any(axis=0)
                if alive.sum() < 0.8 * len(rows):
                    rows, part = rows[alive], part[:, alive]
            stop = listed[rows]
            slack = 1e-9 * (tails[:, :1] * self.tails[rows, 0])
            a, r = np.nonzero(part + tails[:, stop] * self.tails[rows, stop] + slack >= low[:, None])
            r = rows[r]
        score = np.zeros(len(a), np.int64)
        for i in range(0, len(a), 1 << 17):
            score[i:i + (1 << 17)] = np.einsum("ij,ij->i", anchors[a[i:i + (1 << 17)]], self.whole[r[i:i + (1 << 17)]])
        keep = score >= low[a]
        return a[keep], r[keep], score[keep]


def best(window: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each window, by falling score and rising id."""
    order = np.lexsort((ids, -score, window))
    window, score, ids = window[order], score[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, np.int64)
    rank = np.arange(len(window)) - np.repeat(first, np.diff(np.append(first, len(window))))
    keep = rank < k
    return window[keep], score[keep], ids[keep]


def search(index: DataFrame, asked: dict, k: int) -> DataFrame:
    """window, score and id of the k best rows that every task has for each window.

    ``asked``: anchors (ids, labels, vectors, low) and windows (anchor, low, high, same: whether the
    label must be equal or differ). Windows are numbered by their place.
    """
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        tails = tail_norms(q["vectors"])
        # windows of each anchor, one column per window of the anchor with the most
        by_anchor = np.argsort(q["anchor"], kind="stable")
        counts = np.bincount(q["anchor"], minlength=len(q["ids"]))
        starts = np.concatenate([[0], np.cumsum(counts)])
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for row in batch.to_pylist():
                block = Index(row["ids"], row["labels"], row["vectors"])
                for t in range(0, len(q["ids"]), TILE):
                    a, r, score = block.above(q["vectors"][t:t + TILE], tails[t:t + TILE], q["low"][t:t + TILE])
                    a = a + t
                    other = q["ids"][a] != block.ids[r]
                    a, r, score = a[other], r[other], score[other]
                    same = q["labels"][a] == block.labels[r]
                    for j in range(int(counts[t:t + TILE].max(initial=0))):
                        has = np.flatnonzero(counts[a] > j)
                        w = by_anchor[starts[a[has]] + j]
                        fits = (same[has] == q["same"][w]) & (score[has] >= q["window_low"][w]) & (score[has] <= q["window_high"][w])
                        found = has[fits]
                        held = best(*(np.concatenate([x, y]) for x, y in zip(held, (w[fits], score[found], block.ids[r[found]]))), k)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], names=["window", "score", "id"])

    return index.mapInArrow(run, "window bigint, score bigint, id bigint")


def first_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lowered(mean: np.ndarray, spread: np.ndarray, high: np.ndarray, expected: float, rows: int) -> np.ndarray:
    """Per window the score above which ``expected`` of ``rows`` rows lie below ``high``, by a normal distribution."""
    out = np.full(len(mean), LOWEST)
    for i, (m, s, h) in enumerate(zip(mean.tolist(), spread.tolist(), high.tolist())):
        p = (1.0 if h == HIGHEST else _NORMAL.cdf((h - m) / s) if s else 0.0) - expected / max(rows, 1)
        if 0 < p < 1 and s:
            out[i] = int(min(max(np.ceil(m + s * _NORMAL.inv_cdf(p)), -2.0 ** 62), 2.0 ** 62))
    return out


def filled(index: DataFrame, anchors: dict, windows: dict, stats: tuple, rows: int, k: int) -> DataFrame:
    """window, rank, score and id: the k first rows of every window, by thresholds lowered in turns."""
    spark, got, expected = index.sparkSession, [], float(FIRST)
    left = np.arange(len(windows["anchor"]))
    while len(left):
        anchor, high, floor = windows["anchor"][left], windows["high"][left], windows["low"][left]
        low = np.maximum(lowered(stats[0][anchor], stats[1][anchor], high, expected, rows), floor)
        if expected > rows / 8:
            low = floor
        need, place = np.unique(anchor, return_inverse=True)
        least = np.full(len(need), HIGHEST)
        np.minimum.at(least, place, low)
        asked = {"ids": anchors["ids"][need], "labels": anchors["labels"][need], "vectors": anchors["vectors"][need], "low": least,
                 "anchor": place, "window_low": low, "window_high": high, "same": windows["same"][left]}
        turn = staged(first_of(search(index, asked, k), k), "windows")
        size = turn.groupBy("window").agg(F.count("*").alias("n")).where(F.col("n") >= k).toArrow()  # at most the windows asked for
        full = np.zeros(len(left), bool)
        full[size["window"].to_numpy()] = True
        full |= low <= floor
        named = spark.createDataFrame(pa.table({"window": np.flatnonzero(full), "place": left[full]})) if full.any() else None
        if named is not None:
            got.append(staged(turn.join(F.broadcast(named), "window").select(F.col("place").alias("window"), "rank", "score", "id"), "full"))
        drop_staged(turn)
        left, expected = left[~full], expected * WIDER
    if not got:
        return spark.createDataFrame([], "window bigint, rank int, score bigint, id bigint")
    out = got[0]
    for more in got[1:]:
        out = out.unionByName(more)
    return out


def mined(index: DataFrame, anchors: dict, sample: np.ndarray, rows: int, k: int, low_percent: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, of one block of anchors."""
    spark = index.sparkSession
    scores = anchors["vectors"].astype(np.float64) @ sample.T.astype(np.float64)
    stats = (scores.mean(axis=1), scores.std(axis=1)) if sample.size else (np.zeros(len(scores)), np.zeros(len(scores)))
    n = len(anchors["ids"])
    whole = {"anchor": np.arange(n), "low": np.full(n, LOWEST), "high": np.full(n, HIGHEST), "same": np.ones(n, bool)}
    found = filled(index, anchors, whole, stats, rows, k).toArrow().sort_by([("window", "ascending"), ("rank", "ascending")])  # at most k a anchor
    anchor, score, ids = (found[c].to_numpy() for c in ("window", "score", "id"))
    # between low/100 of the positive's score and the score itself, in whole numbers
    floor = np.array([-(-low_percent * s // 100) for s in score.tolist()], np.int64)
    some = np.flatnonzero(score >= 0)
    windows = {"anchor": anchor[some], "low": floor[some], "high": score[some], "same": np.zeros(len(some), bool)}
    negatives = filled(index, anchors, windows, stats, rows, k)
    named = spark.createDataFrame(pa.table({
        "window": np.arange(len(some)), "anchor_id": anchors["ids"][anchor[some]], "positive_id": ids[some], "positive_score": score[some]}),
        "window bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    return negatives.join(F.broadcast(named), "window").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(df: DataFrame, is_anchor: Callable, k: int = 5, low_percent: int = 80, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "vector") -> DataFrame:
    """For each anchor and each of its ``k`` positives the ``k`` hardest negatives of the window.

    Vectors hold whole numbers (their inner products must fit 64 bits). ``is_anchor`` makes of the id
    column the condition that picks the anchors.
    """
    spark = df.sparkSession
    rows, d, n = usable(df, id_col, label_col, vector_col)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n or not d:
        return spark.createDataFrame([], schema)
    order = dimension_order(rows, d)
    index = staged(blocks(rows.repartition(-(-n // BLOCK)), order), "index")
    asked = rows.where(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("v", "label")).alias("row"))
    parts = max(1, -(-asked.count() // ANCHORS))
    asked = staged(asked.repartition(parts).select("id", "row.*", F.spark_partition_id().alias("part")), "anchors")
    first = index.limit(1).select("vectors").toArrow()["vectors"].to_pylist()  # one block, to choose thresholds by
    sample = np.frombuffer(first[0], "<i8").reshape(-1, d)[:SAMPLE]
    out = []
    for part in range(parts):
        block = asked.where(F.col("part") == part).toArrow()  # ANCHORS rows at most
        if block.num_rows:
            anchors = {"ids": block["id"].to_numpy(), "labels": block["label"].to_numpy(),
                       "vectors": np.asarray(block["v"].combine_chunks().flatten()).reshape(block.num_rows, d)[:, order]}
            out.append(staged(mined(index, anchors, sample, n, k, low_percent), "negatives"))
    drop_staged(index, asked)
    if not out:
        return spark.createDataFrame([], schema)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole

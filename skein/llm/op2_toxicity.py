"""Toxicity scores from a character n-gram classifier scaled by naive Bayes log-count ratios.

Features are the presence of hashed byte n-grams (ORDERS) of the lower-cased text. From labelled
texts come, per feature, the number of toxic and of other texts that have it; their smoothed
log-ratio r scales the feature. A logistic regression on the scaled features (NB-SVM style) gives
the weights, so a text's score is sigmoid(bias + sum over its distinct features of r * beta).

The classifier is fitted on a bounded sample of labelled rows (``sample``): its rows follow from a
hash of the id. Counting runs on Spark; only features whose counts differ by more than chance
(|z| >= MIN_Z, the FEATURES strongest) enter the regression, which is one small task: it keeps two bytes per row and feature and
works on blocks of them. Scoring reads every text whole.

Nulls and empty texts have no feature: they get the score of the bias. Without labels of both kinds
every score is 0. Rows that repeat an id each get a row; if an id has several labels the largest
counts. Other columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART_BYTES, map_texts, slices, text_buffers

ORDERS = (3, 4, 5, 6)
BITS = 20
SAMPLE = 20_000     # labelled rows that the classifier is fitted on, at most
FEATURES = 8_192    # features of the regression, at most
MIN_Z = 4.0
THRESHOLD = 0.3
BLOCK = 1 << 17     # entries of the regression that are worked on at once

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491)  # odd, fixed values of the feature hash


def _folded() -> np.ndarray:
    """A-Z in lower case; every byte that is no letter, digit or part of a longer character becomes a blank."""
    t = np.arange(256, dtype=np.uint32)
    t[65:91] += 32
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[65:91] = keep[128:] = True
    t[~keep] = 32
    return t


_FOLD = _folded()


def hashed_grams(raw: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each byte (the last n - 1 have none)."""
    b = _FOLD[raw]
    out, h = [], np.zeros(len(b), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = np.uint32(_MULTIPLIERS[n - 1])
        if n == 1:
            h = (b + np.uint32(1)) * m
        else:
            h = h[:-1] + (b[n - 1:] + np.uint32(1)) * m if len(h) else h
        if n in ORDERS:
            x = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            out.append((x >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def each_text(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The feature buckets of each text (with repeats). Texts are padded by blanks at both ends."""
    for i, j in slices(offsets, PART_BYTES):
        yield from _each_text(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])


def _each_text(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    n = len(offsets) - 1
    size = np.diff(offsets)
    padded = np.full(len(raw) + 2 * n, 32, np.uint8)
    shift = np.repeat(2 * np.arange(n) + 1, size)
    padded[np.arange(len(raw)) + shift] = raw
    at = offsets + 2 * np.arange(n + 1)
    grams = hashed_grams(padded)
    for i in range(n):
        if not size[i]:
            yield np.zeros(0, np.int32)
            continue
        yield np.concatenate([g[at[i]:max(at[i], at[i + 1] - k + 1)] for k, g in zip(ORDERS, grams)])


class Presence:
    """Picks one place per distinct bucket, without sorting."""

    def __init__(self):
        self.stamp = np.zeros(1 << BITS, np.int32)

    def distinct(self, buckets: np.ndarray) -> np.ndarray:
        place = np.arange(len(buckets), dtype=np.int32)
        self.stamp[buckets] = place
        return buckets[self.stamp[buckets] == place]


def blocks_of(lists: pa.ListArray, dtype: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The columns of some rows (about BLOCK entries; a longer row is a block by itself) and each row's number of them."""
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size)])
    columns = np.asarray(lists.flatten()).astype(dtype)
    for i, j in slices(ends, BLOCK):
        yield columns[ends[i]:ends[j]], size[i:j]


def regression(blocks: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, scale: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression with L2 and momentum. Sums run over all entries in their order, so
    the result doesn't depend on how rows are dealt into blocks."""
    beta, bias = np.zeros(len(scale)), 0.0
    every, squared = np.arange(len(scale)), scale ** 2

    def by_row(weights: np.ndarray, col: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(size)), size), weights=weights[col], minlength=len(size))

    # step by the largest curvature the features can give
    step = 1.0 / max(1e-9, 0.25 * max(by_row(squared, *b).max() for b in blocks) + 0.25)
    v_beta, v_bias = np.zeros_like(beta), 0.0
    for _ in range(rounds):
        look, look_bias = beta + 0.9 * v_beta, bias + 0.9 * v_bias
        weighted, grad, err, i = scale * look, np.zeros(len(scale)), np.zeros(len(y)), 0
        for col, size in blocks:
            j = i + len(size)
            margin = look_bias + by_row(weighted, col, size)
            err[i:j] = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[i:j]) / len(y)
            # the sums so far go first, so each goes on where the last block left it
            grad = np.bincount(np.concatenate([every, col]), weights=np.concatenate([grad, scale[col] * np.repeat(err[i:j], size)]), minlength=len(scale))
            i = j
        grad = grad + 1e-4 * look
        v_beta = 0.9 * v_beta - 10 * step * grad
        v_bias = 0.9 * v_bias - 10 * step * err.sum()
        beta, bias = beta + v_beta, bias + v_bias
    return beta, bias


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """text and y of at most about ``sample`` labelled rows.

    The chosen ids are bounded by ``sample``, so that they can be broadcast and no text is shuffled.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")) \
        .where(F.col("__id").isNotNull() & F.col("y").isin(0, 1)).groupBy("__id").agg(F.max("y").alias("y"))
    n = known.count()
    u = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = known.where(u < F.lit(0.98 * sample / n if n > sample else 1.0)).limit(sample)
    rows = docs.join(F.broadcast(chosen), docs[id_col] == F.col("__id")).select("__id", F.col(text_col).cast("string").alias("text"), "y")
    # copies of a text would count as independent evidence: one of each stays
    return rows.withColumn("__copy", F.xxhash64("text")).dropDuplicates(["__copy", "y"]).drop("__copy")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE, rounds: int = 1500) -> dict:
    """Weights of all buckets (float32) and the bias."""
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, sample)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, have = Presence(), np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            y = np.asarray(batch.column(1))
            for i, j in slices(offsets):
                for k, buckets in enumerate(each_text(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])):
                    have[y[i + k], seen.distinct(buckets)] += 1
                    have[y[i + k], -1] += 1
        at = np.flatnonzero(have.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(have[1, at]), pa.array(have[0, at])], names=["f", "pos", "neg"])

    got = rows.select("text", "y").mapInArrow(counts, "f bigint, pos bigint, neg bigint") \
        .groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()  # at most 2 ** BITS + 1 rows
    pos, neg = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    at = got["f"].to_numpy()
    pos[at], neg[at] = got["pos"].to_numpy(), got["neg"].to_numpy()
    n_pos, n_neg = pos[-1], neg[-1]
    weights = np.zeros(1 << BITS, np.float32)
    if not n_pos or not n_neg:
        return {"weights": weights, "bias": -50.0}
    p, q = (pos[:-1] + 1) / (n_pos + 2), (neg[:-1] + 1) / (n_neg + 2)
    ratio = np.log(p / (1 - p)) - np.log(q / (1 - q))
    both = (pos[:-1] + neg[:-1]) / (n_pos + n_neg)
    z = np.abs(pos[:-1] / n_pos - neg[:-1] / n_neg) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_pos + 1 / n_neg))
    chosen = np.argsort(-z, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[z[chosen] >= MIN_Z])
    column = np.full(1 << BITS, -1, np.int32)
    column[chosen] = np.arange(len(chosen))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Presence()
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                lists = [column[seen.distinct(x[column[x] >= 0])] for x in each_text(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i),
                                                  pa.array(lists, pa.list_(pa.int32()))], names=["id", "y", "x"])

    scale = ratio[chosen]

    def regress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ys = [], []
        for batch in batches:
            ys.append(np.asarray(batch.column(1), dtype=float))
            blocks += blocks_of(batch.column(2), np.min_scalar_type(len(scale)))
        beta, bias = regression(blocks, np.concatenate(ys), scale, rounds)
        yield pa.RecordBatch.from_arrays([pa.array([beta * scale], pa.list_(pa.float64())), pa.array([bias])], names=["w", "bias"])

    small = rows.mapInArrow(features, "id bigint, y int, x array<int>") if dict(rows.dtypes)["__id"] == "bigint" \
        else rows.withColumn("__id", F.xxhash64(F.col("__id"))).mapInArrow(features, "id bigint, y int, x array<int>")
    fitted = small.repartition(1).sortWithinPartitions("id").mapInArrow(regress, "w array<double>, bias double").first()
    weights[chosen] = fitted["w"]
    return {"weights": weights, "bias": float(fitted["bias"])}


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple = ("doc_id",), name: str = "score") -> DataFrame:
    """The ``keep`` columns and the score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(raw, offsets):
        w, bias, seen = shared.value["weights"], shared.value["bias"], Presence()
        used = w != 0
        total = np.array([w[seen.distinct(x[used[x]])].sum(dtype=float) for x in each_text(raw, offsets)])
        return {name: 1 / (1 + np.exp(-np.clip(total + bias, -500, 500)))}

    return map_texts(docs, text_col, f"`{name}` double", fn, list(keep))


def predict(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.withColumn("predicted", F.when(F.col("score") >= F.lit(threshold), 1).otherwise(0))

"""Approximate nearest neighbours from randomly rotated one-bit codes.

Every vector is scaled to length 1 and turned by a random rotation; its code keeps one bit per
coordinate, the sign. With u the code's unit vector (signs / sqrt(d)) and o the turned vector, the
correction scalar <u, o> makes <u, q> / <u, o> an unbiased estimate of <o, q> for a query q, with
error below eps * sqrt((1 - <u, o>^2) / <u, o>^2 / (d - 1)) except with small probability. Queries
are rounded to QUERY_BITS bits per coordinate, so <u, q> comes from AND and popcount over packed
bits. A block's candidates whose upper bound lies under the k-th best exact value are skipped; the
others are reranked by their exact cosine in double precision.

All candidates are indexed and estimated for each query. Rows are coded in blocks where they are read;
queries come to them, QUERY_BLOCK at a time at most, as a broadcast, so no candidate is shuffled, and the
number of tasks follows the candidates. A task keeps the k best of each query from block to block: the
k-th best is the bar that a later candidate's bound must reach to be reranked. Only k rows per query and
task leave it.

Vectors that are null, empty, zero or hold null or non-finite components take no part, and so do rows
without an id; vectors of another length than the most common are left out too. Rows that repeat an
id are candidates each, never for a query of that id. Other columns, of any name, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BLOCK = 4096         # candidates of a block
QUERY_BLOCK = 8192   # queries that are broadcast at once
QUERY_BITS = 6
EPSILON = 3.0        # width of the error bound in standard deviations, about
SEED = 11


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix: the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (64 a word, the last word padded by zeros) and correction scalars of unit vectors."""
    turned = vectors @ turn
    bits = turned > 0
    d = vectors.shape[1]
    words = -(-d // 64)
    padded = np.zeros((len(vectors), words * 64), np.uint8)
    padded[:, :d] = bits
    packed = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    return packed, np.abs(turned).sum(axis=1) / np.sqrt(d)


class Query:
    """A query's rounded coordinates as bit planes."""

    def __init__(self, number: int, vector: np.ndarray, turn: np.ndarray):
        self.id, self.vector, self.norm = number, vector, np.linalg.norm(vector)
        q = vector / self.norm @ turn
        d = len(q)
        low, high = q.min(), q.max()
        self.step = max((high - low) / ((1 << QUERY_BITS) - 1), 1e-12)
        level = np.clip(np.rint((q - low) / self.step), 0, (1 << QUERY_BITS) - 1).astype(np.uint32)
        planes = np.zeros((QUERY_BITS, -(-d // 64) * 64), np.uint8)
        for k in range(QUERY_BITS):
            planes[k, :d] = level >> k & 1
        self.planes = np.packbits(planes, axis=1, bitorder="little").view("<u8")
        self.low, self.root, self.total = low, np.sqrt(d), float(low * d + self.step * level.sum())
        # rounding moves each coordinate by half a step at most
        self.slack = self.step / 2 * self.root

    def estimates(self, packed: np.ndarray, correction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner product with each coded vector, and its error bound."""
        d = self.root ** 2
        ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
        dot = np.zeros(len(packed))
        for k, plane in enumerate(self.planes):
            dot += (1 << k) * np.bitwise_count(packed & plane).sum(axis=1, dtype=np.int64)
        positive = self.low * ones + self.step * dot          # sum of q over the set bits
        along = (2 * positive - self.total) / self.root       # <u, q>
        bound = EPSILON * np.sqrt(np.maximum(0, 1 - correction ** 2) / max(d - 1, 1)) / correction + self.slack / correction
        return along / correction, bound


def search(queries: list[Query], block: dict, best: list[list[tuple[float, int]]], k: int) -> None:
    """Brings the k nearest of every query (minus cosine, id) up to date with the rows of a block."""
    for number, q in enumerate(queries):
        about, bound = q.estimates(block["codes"], block["corrections"])
        upper = about + bound
        own = best[number]
        left = np.flatnonzero((block["ids"] != q.id) & (upper >= (-own[-1][0] if len(own) == k else -np.inf)))
        # rerank in growing runs of the highest upper bounds until no bound reaches the k-th best
        size = 64
        while len(left):
            if len(left) > size:
                part = np.argpartition(-upper[left], size)
                run, left = left[part[:size]], left[part[size:]]
            else:
                run, left = left, left[:0]
            exact = block["vectors"][run] @ q.vector / (block["norms"][run] * q.norm)
            own = sorted([*own, *zip((-exact).tolist(), block["ids"][run].tolist())])[:k]
            if len(own) == k:
                left = left[upper[left] >= -own[-1][0]]
            size *= 2
        best[number] = own


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")) \
        .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == F.lit(sizes["d"] if sizes else 0))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows coded in blocks: one row holds up to ``size`` ids, vectors, codes and correction scalars."""
    names = ["ids", "vectors", "codes", "corrections"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(ids, v):
            packed, correction = encode(v / np.linalg.norm(v, axis=1, keepdims=True), rotation(v.shape[1]))
            held = (ids.astype("<i8"), v.astype("<f8"), packed, correction)
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in held], names=names)

        ids, v = np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            ids, v = np.concatenate([ids, np.asarray(batch.column(0))]), new if v is None else np.concatenate([v, new])
            while len(ids) >= size:
                yield emit(ids[:size], v[:size])
                ids, v = ids[size:], v[size:]
        if len(ids):
            yield emit(ids, v)

    return rows.mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def nearest(df: DataFrame, is_query: Callable, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the k nearest rows of each query, ties going to the smaller id.

    ``is_query`` makes of the id column the condition that picks the queries; an id that repeats
    among them asks once, by its smallest vector.
    """
    spark, rows = df.sparkSession, usable(df, id_col, vector_col)
    asked = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = staged(asked.repartition(parts).withColumn("part", F.spark_partition_id()), "ann-queries")
    index = blocks(rows, BLOCK)
    if parts > 1:  # each block of queries reads it
        index = staged(index, "ann-index")

    def found_by(part: int) -> DataFrame:
        got = asked.where(F.col("part") == part).select("id", "v").toArrow()  # QUERY_BLOCK rows at most
        shared = spark.sparkContext.broadcast((got["id"].to_numpy(), np.array(got["v"].to_pylist(), np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            turn = rotation(vectors.shape[1]) if len(ids) else None
            queries = [Query(i, v, turn) for i, v in zip(ids.tolist(), vectors)]
            best: list[list[tuple[float, int]]] = [[] for _ in queries]
            for batch in batches:
                for row in batch.to_pylist():
                    of = np.frombuffer(row["ids"], "<i8")
                    own = np.frombuffer(row["vectors"], "<f8").reshape(len(of), -1)
                    search(queries, {"ids": of, "vectors": own, "norms": np.linalg.norm(own, axis=1), "codes": np.frombuffer(row["codes"], "<u8").reshape(len(of), -1),
                                     "corrections": np.frombuffer(row["corrections"], "<f8")}, best, k)
            rows_out = [(q.id, i, -s) for q, own in zip(queries, best) for s, i in own]
            q, i, s = zip(*rows_out) if rows_out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "id", "score"])

        return index.mapInArrow(run, "query_id bigint, id bigint, score double")

    found = found_by(0)
    for part in range(1, parts):
        found = found.union(found_by(part))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

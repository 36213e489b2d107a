"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they are in): per pattern one row
with its words. Words flow from patterns to the quotas of their sources. A pattern's words can be
taken up to ``max_repeats`` times, and each further time costs more than the one before (convex), so
the flow repeats nothing while fresh words can serve the same quota. As only the supply arcs have a
cost, and the r-th repetition costs the same for every pattern, the successive cheapest paths are
found by raising all supplies by one repetition at a time and augmenting. Patterns that share no
source, even through others, are independent: each component of patterns and sources is a group of
its own, and nothing is solved on the driver.

The flow tells how many words of a pattern to take: whole passes over it and a rest. The rest is
spread over the histogram of its document sizes, largest first, each size getting its share of the
rest; what rounding leaves over goes to the next smaller size, so the sum misses its quota by less
than the size of a small document (a pattern whose words lie in a few huge documents: by less than one of
these). Which documents of a size are taken is decided by a seeded hash of
their ids: those of the k smallest hashes. The k-th one is found from counts of hash ranges, and only
the one range that it falls in is ranked, so a pattern or a size may hold any share of all rows.

Documents without a source, of null sources or whose sources have no target are not taken. A size
that is null or negative counts as 0. A null among the sources is a source by itself. Rows that
repeat an id are documents each; rows without an id are numbered among those of their sources and size, so that
their partitions don't matter. An empty table gives no rows. Other columns, of any name, are not read.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components

MAX_REPEATS = 3
SEED = 12
RANGE = 4096  # documents of a hash range that is ranked


def encoded(source: Column) -> Column:
    """A source's name that is never null: empty for null, else with a mark before it."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def ranked_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with rank (from 0) by code point, null last; ranges are counted, not sorted in one task."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = max(1, sources.count() // 100_000)
    dealt = staged(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sources")
    before = dealt.groupBy("part").agg(F.count("*").alias("n")) \
        .withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(before, "part").withColumn("rank", F.col("own") + F.col("before")).drop("part", "own", "before")


def weighted_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, size, weight) with the target of each: its share of all words by weight.

    A target stops at ``max_repeats`` times its source's size; the excess is shared anew among the
    others by weight, until none is above. That is min(cap, level x weight) at one level, which
    rises from round to round: each round reads three sums.
    """
    cap, weight = F.col("size") * max_repeats, F.col("weight").cast("double")
    total = sources.agg(F.sum("size").alias("t"), F.sum(weight).alias("w")).first()
    words, level, capped = float(total["t"] or 0), None, -1
    if not total["w"]:
        return sources.withColumn("target", F.lit(0.0))
    level = words / total["w"]
    while True:
        full = cap <= F.lit(level) * weight
        got = sources.agg(F.sum(F.when(full, cap)).alias("c"), F.sum(F.when(~full, weight)).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        if got["n"] == capped or not got["w"]:
            break
        capped, level = got["n"], (words - float(got["c"] or 0)) / got["w"]
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * weight) if got["w"] else cap.cast("double"))


class Network:
    """Arcs with room; words flow along shortest augmenting paths (blocking flows by levels)."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def augment(self, start: int, end: int) -> None:
        while True:
            depth = [-1] * len(self.out)
            depth[start] = 0
            queue = deque([start])
            while queue:
                v = queue.popleft()
                for e in self.out[v]:
                    if self.room[e] and depth[self.to[e]] < 0:
                        depth[self.to[e]] = depth[v] + 1
                        queue.append(self.to[e])
            if depth[end] < 0:
                return
            nxt, path, v = [0] * len(self.out), [], start
            while True:
                if v == end:
                    gain = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= gain
                        self.room[e ^ 1] += gain
                    path, v = [], start
                elif nxt[v] < len(self.out[v]):
                    e = self.out[v][nxt[v]]
                    if self.room[e] and depth[self.to[e]] == depth[v] + 1:
                        path.append(e)
                        v = self.to[e]
                    else:
                        nxt[v] += 1
                elif path:
                    v = self.to[path.pop() ^ 1]
                    nxt[v] += 1
                else:
                    break


def routed(frame: pd.DataFrame, max_repeats: int) -> pd.DataFrame:
    """Words that each pattern gives to each of its sources: pattern, source, words."""
    patterns, sources = pd.unique(frame["pattern"]), pd.unique(frame["source"])
    at = {p: 2 + i for i, p in enumerate(patterns)} | {("s", s): 2 + len(patterns) + i for i, s in enumerate(sources)}
    net = Network(2 + len(patterns) + len(sources))
    size = frame.drop_duplicates("pattern").set_index("pattern")["size"]
    target = frame.drop_duplicates("source").set_index("source")["quota"]
    supply = [(net.arc(0, at[p], 0), int(size[p])) for p in patterns]
    for s in sources:
        net.arc(at["s", s], 1, int(target[s]))
    arcs = [net.arc(at[p], at["s", s], 1 << 62) for p, s in zip(frame["pattern"], frame["source"])]
    for _ in range(max_repeats):  # the cheapest supplies first: one more pass over every pattern
        for e, words in supply:
            net.room[e] += words
        net.augment(0, 1)
    return pd.DataFrame({"pattern": frame["pattern"], "source": frame["source"], "words": [net.room[e ^ 1] for e in arcs]})


def spread(sizes: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """How many documents of each size (descending) to take, so that their words come near ``rest``.

    Beyond half of all words the documents to leave out are chosen that way: the smaller part always
    finds small documents to fill up with.
    """
    take, total = np.zeros(len(sizes), np.int64), int((sizes * counts).sum())
    if 2 * rest > total:
        return counts - spread(sizes, counts, total - rest)
    share, seen, got = rest, 0, 0
    for i, (z, n) in enumerate(zip(sizes.tolist(), counts.tolist())):
        if z <= 0:
            break
        seen += z * n
        k = min(n, (share * seen // total - got) // z)
        take[i], got = k, got + k * z
    for i, (z, n) in enumerate(zip(sizes.tolist(), counts.tolist())):
        if z <= 0 or got >= rest:
            break
        k = min(n - int(take[i]), (rest - got) // z)
        take[i], got = take[i] + k, got + k * z
    return take


def routes(rows: DataFrame, targets: DataFrame, max_repeats: int) -> DataFrame:
    """pattern, source and words of the flow; ``rows`` has pattern, members (encoded sources) and size."""
    arcs = staged(rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size"))
                  .select("pattern", "size", "members", F.explode("members").alias("source")), "patterns")
    quotas = targets.select(encoded(F.col("source")).alias("source"), F.greatest(F.round("target"), F.lit(0)).cast("bigint").alias("quota")) \
        .where("quota is not null").groupBy("source").agg(F.max("quota").alias("quota"))
    arcs = arcs.join(quotas, "source").withColumn("v", F.xxhash64("source"))
    links = arcs.where(F.size("members") > 1).select(F.xxhash64(F.col("members")[0]).alias("a"), F.col("v").alias("b")).where("a <> b")
    if links.limit(1).count():
        arcs = arcs.join(connected_components(links), "v", "left").withColumn("component", F.coalesce("label", "v"))
    else:
        arcs = arcs.withColumn("component", F.col("v"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        return routed(frame.sort_values(["pattern", "source"], ignore_index=True), max_repeats)

    return staged(arcs.select("component", "pattern", "source", "size", "quota").groupBy("component")
                  .applyInPandas(solve, "pattern string, source string, words bigint"), "routes")


def chosen(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` (row, key, pattern, size) with times: how often each is taken."""
    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ascending=False, ignore_index=True)
        frame["k"] = spread(frame["size"].to_numpy(), frame["n"].to_numpy(), int(frame["rest"].iloc[0]))
        return frame[["pattern", "size", "n", "passes", "k"]]

    sizes = rows.groupBy("pattern", "size").agg(F.count("*").alias("n"))
    picks = staged(sizes.join(plan, "pattern").groupBy("pattern").applyInPandas(pick, "pattern string, size bigint, n bigint, passes bigint, k bigint"), "picks")
    # hash ranges of about RANGE documents in each size of a pattern
    span = F.ceil(F.col("n") / F.lit(RANGE))
    dealt = rows.join(picks, ["pattern", "size"], "left").withColumn("h", F.xxhash64(F.lit(seed), "key")) \
        .withColumn("range", F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), F.floor(F.shiftrightunsigned("h", 33) * span / F.lit(1 << 31)).cast("bigint")))
    counted = dealt.where("range is not null").groupBy("pattern", "size", "range").agg(F.count("*").alias("here"), F.first("k").alias("k"))
    below = F.sum("here").over(Window.partitionBy("pattern", "size").orderBy("range")) - F.col("here")
    edges = counted.withColumn("below", below).select("pattern", "size", "range", F.when(F.col("below") >= F.col("k"), 0)
                                                      .when(F.col("below") + F.col("here") <= F.col("k"), F.col("here")).otherwise(F.col("k") - F.col("below")).alias("of_range"), "here")
    edges = staged(edges, "ranges")
    clear = dealt.where("range is null").select("row", F.coalesce(F.col("passes") + F.when(F.col("k") >= F.col("n"), 1).otherwise(0), F.lit(0)).alias("times"))
    within = dealt.where("range is not null").join(edges, ["pattern", "size", "range"])
    sure = within.where("of_range = 0 or of_range = here").select("row", (F.col("passes") + (F.col("of_range") > 0).cast("int")).alias("times"))
    order = Window.partitionBy("pattern", "size", "range").orderBy("h", "row")
    split = within.where("of_range > 0 and of_range < here").withColumn("own", F.row_number().over(order)) \
        .select("row", (F.col("passes") + (F.col("own") <= F.col("of_range")).cast("int")).alias("times"))
    return clear.union(sure).union(split).select("row", F.col("times").cast("bigint").alias("times"))


def numbered(rows: DataFrame) -> DataFrame:
    """row, key, pattern, size of rows without an id: the key is a number among those of the pattern and size."""
    rows = rows.withColumn("part", F.shiftright("row", 33))  # the partition that the row was read in
    before = rows.groupBy("pattern", "size", "part").agg(F.count("*").alias("n")) \
        .withColumn("before", F.sum("n").over(Window.partitionBy("pattern", "size").orderBy("part")) - F.col("n")).drop("n")
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("pattern", "size", "part").orderBy("row")))
    return own.join(before, ["pattern", "size", "part"]) \
        .select("row", F.concat(F.lit("#"), F.col("own") + F.col("before")).alias("key"), "pattern", "size")


def mix(docs: DataFrame, targets: DataFrame, max_repeats: int = MAX_REPEATS, seed: int = SEED, id_col: str = "doc_id",
        size_col: str = "size", sources_col: str = "sources") -> tuple[DataFrame, DataFrame]:
    """The mix and its routes.

    ``docs`` has an id, a size in words and an array of sources; ``targets`` has source and target
    (words). The mix has a row per document: the id, size, sources and times, how often it is taken. The routes tell
    how many words each membership pattern gives to which source: pattern, source, words; names
    in them are encoded as ``encoded`` says.
    """
    members = F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col(f"`{sources_col}`"), F.expr("array()").cast("array<string>")), encoded)))
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("bigint"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), size.alias("size"), members.alias("members"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows.withColumn("pattern", F.to_json("members")), "mix-rows")
    keyed = rows.where("id is not null").select("row", F.col("id").cast("string").alias("key"), "pattern", "size") \
        .unionByName(staged(numbered(rows.where("id is null")), "without-id"))
    ways = routes(rows, targets, max_repeats)
    flow = ways.groupBy("pattern").agg(F.sum("words").alias("words"))
    plan = rows.groupBy("pattern").agg(F.sum("size").alias("all")).join(flow, "pattern").where(F.col("all") > 0) \
        .select("pattern", F.expr("words div all").alias("passes"), F.expr("words % all").alias("rest"))
    times = chosen(keyed, staged(plan, "plan"), seed)
    names = F.transform("members", lambda m: F.when(m != "", F.substring(m, 2, 1 << 30)))
    out = rows.select("row", F.col("id").alias(id_col), "size", names.alias("sources")).join(times, "row").drop("row")
    return out, ways

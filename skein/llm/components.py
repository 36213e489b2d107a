"""Connected components of a table of edges, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def connected_components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """v and label, the smallest vertex it is connected with, for every vertex of ``edges`` (a, b).

    Each round gives a vertex the smallest label around it, then that label's own label, so labels
    travel in doubling steps. Every round is written to the shared folder. ``labels`` of an earlier
    call on part of the edges are taken over.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    if labels is not None:
        both = both.union(labels.select("v", F.col("label").alias("w"))).union(labels.select(F.col("label").alias("v"), F.col("v").alias("w")))
    both = staged(both.where("v != w").distinct(), "edges")
    now = staged(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("label")), "labels")
    while True:
        near = both.join(now.withColumnsRenamed({"v": "w", "label": "near"}), "w").groupBy("v").agg(F.min("near").alias("near"))
        better = now.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("v").alias("label"), F.col("label").alias("beyond"))
        after = staged(better.join(jump, "label", "left").select("v", "old", F.coalesce("beyond", "label").alias("label")), "labels")
        moved = after.where("old != label").limit(1).count()
        drop_staged(now)
        now = after.select("v", "label")
        if not moved:
            drop_staged(both)
            return now

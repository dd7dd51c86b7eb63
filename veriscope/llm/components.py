"""Connected components of a table of links, by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins on the node id; no node's neighbours are ever gathered in one
place, and each round's links are checkpointed to the shared folder. The number of rounds grows with the
logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.common import shared_dir


def connected_components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (id, component): component is the smallest id reachable. Nodes without links are absent.

    Self-links and nulls are ignored, repeated links count once, an empty table gives an empty one.
    """
    shared_dir(links.sparkSession)
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        # large-star: every larger neighbour of a node points to the smallest of its neighbours and itself
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()

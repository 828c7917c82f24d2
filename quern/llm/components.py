"""Connected components of a link table by repeated contraction.

Each round points every node at its smallest neighbour (or itself), jumps pointers until they end at
roots, and redraws the links between roots; at least half of a component's nodes go each round. All
groupings by a hub are minima with partial sums, all joins are between written tables, so a hub's
rows can be dealt to several tasks.

Edge cases: links of a node to itself and repeated or reversed links count for nothing; links with a
null end never join anything; no links give an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Workspace


def _empty(frame: DataFrame) -> bool:
    return not frame.limit(1).count()


def components(links: DataFrame, workspace: Workspace) -> DataFrame:
    """node, root for every node of links (a, b); the root is the same for all that are connected."""
    edges = workspace.materialise(links.where("a != b").select("a", "b").distinct(), "edges-0")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    whole, round_no = None, 0
    while not _empty(edges):
        pointers = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        pointers, jump = workspace.materialise(pointers, f"pointers-{round_no}-0"), 0
        while True:
            onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jump += 1
            jumped = workspace.materialise(pointers.join(onward, "root").select("node", "root", "next"), f"pointers-{round_no}-{jump}")
            pointers = jumped.select("node", F.col("next").alias("root"))
            if _empty(jumped.where("root != next")):
                break
        first = pointers.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        second = pointers.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        if whole is None:
            whole = pointers
        else:
            onward = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
            whole = whole.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            whole = workspace.materialise(whole, f"whole-{round_no}")
        round_no += 1
        redrawn = edges.join(first, "a").join(second, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = workspace.materialise(redrawn.distinct(), f"edges-{round_no}")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return whole if whole is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Connected components of a graph that does not fit one task.

Each round lets every node point to its smallest neighbour or itself, follows the
pointers to their ends by doubling, and keeps only the edges between different ends.
A round at least halves the nodes of every component, so there are few; every step is
a join or an aggregate that combines before it shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.tables import settle


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each end of the edges ``a, b`` (long): root is its component's smallest node.

    Edges with a null end and loops are ignored; edges may repeat. No edges, no rows.
    """
    edges = settle(_between(edges.select("a", "b")), "edges")
    rounds = []
    while n := edges.count():
        pointers = _ends(edges, 2 * n)
        rounds.append(pointers)
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(pointers.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        edges = settle(_between(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))), "edges", n)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return reduce(_follow, rounds)


def _between(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ends(edges: DataFrame, most: int) -> DataFrame:
    """Where the pointers to smaller neighbours end, of ``most`` nodes at most."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pointers = settle(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
            "node", F.least("node", "least").alias("root")
        ),
        "pointers",
        most,
    )
    while True:
        further = settle(_follow(pointers, pointers), "pointers", most)
        # Pointers only ever lead to smaller nodes, so equal sums mean that none moved.
        if _sum_of_roots(further) == _sum_of_roots(pointers):
            return further
        pointers = further


def _follow(pointers: DataFrame, further: DataFrame) -> DataFrame:
    onward = further.select(F.col("node").alias("root"), F.col("root").alias("onward"))
    return pointers.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root"))


def _sum_of_roots(pointers: DataFrame):
    return pointers.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]

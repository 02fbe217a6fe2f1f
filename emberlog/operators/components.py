"""Connected components by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from emberlog.session import cut_lineage


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge the edges of one partition: each node points at its smallest companion."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    found = [(x, find(x)) for x in parent]
    rows = [(x, root) for x, root in found if x != root]
    yield pd.DataFrame(rows, columns=["x", "root"], dtype=object)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(id)``, ``edges(a, b)`` -> ``(id, root)``; the root is the smallest id reached.

    Each round contracts the edges inside every partition before anything is
    shuffled, then merges the partitions' answers by their minimum.  Labels
    only ever get smaller and edges inside one label disappear, so the rounds
    end when no edge is left.
    """
    labels = nodes.select("id", F.col("id").alias("root"))
    open_edges = cut_lineage(edges.select("a", "b").distinct())
    while not open_edges.isEmpty():
        star = open_edges.mapInPandas(_contract, "x string, root string")
        step = star.groupBy("x").agg(F.min("root").alias("to"))
        jump = step.select(F.col("x").alias("to"), F.col("to").alias("further"))
        step = cut_lineage(
            step.join(jump, "to", "left").select("x", F.coalesce("further", "to").alias("to"))
        )
        labels = cut_lineage(
            labels.join(step, labels["root"] == step["x"], "left").select(
                "id", F.coalesce("to", "root").alias("root")
            )
        )
        side_a = step.select(F.col("x").alias("a"), F.col("to").alias("ta"))
        side_b = step.select(F.col("x").alias("b"), F.col("to").alias("tb"))
        open_edges = cut_lineage(
            open_edges.join(side_a, "a", "left")
            .join(side_b, "b", "left")
            .select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
            .where("a <> b")
            .distinct()
        )
    return labels

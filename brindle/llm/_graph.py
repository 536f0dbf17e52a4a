"""Connected components without gathering the graph anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._store import stored


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find inside each batch: edges become links to the smallest member."""
    for batch in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.get(root, root) != root:
                root = parent[root]
            while parent.get(x, x) != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        yield pd.DataFrame({"a": [find(x) for x in parent], "b": list(parent)}, dtype="int64")


def few(df: DataFrame, rows: int) -> DataFrame:
    """As many tasks as ``rows`` need, so that small steps do not pay for every shuffle partition."""
    return df.coalesce(max(6, -(-rows // 50_000)))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; root is the smallest node reachable.

    Each batch of edges is first thinned by union-find. Then rounds of
    contraction follow: each node points to its least neighbour, the pointer is
    followed once more, and edges between different roots go on. All state is
    tables in the shared folder; the number of rounds is logarithmic.
    """
    thin = edges.where("a <> b").select("a", "b").mapInPandas(_local_forest, "a long, b long")
    left = stored(thin.where("a <> b"), "edges")
    hops: list[DataFrame] = []
    rows = left.count()
    while rows:
        if len(hops) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = few(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), rows)
        up = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        hop = stored(few(step.join(up, "root").select("node", F.col("higher").alias("root")), rows), "hop")
        hops.append(hop)
        at, to = hop.select(F.col("node").alias("a"), F.col("root").alias("ra")), hop.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = left.join(at, "a").join(to, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        left = stored(few(moved, rows).mapInPandas(_local_forest, "a long, b long").where("a <> b"), "edges")
        rows = left.count()
    if not hops:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    labels = hops[0]
    for hop in hops[1:]:
        labels = labels.join(hop.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return labels if len(hops) == 1 else stored(labels, "roots")

"""Iterative operators on the web graph."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.urls import extract_links, normalise_links
from brindle.sources.tables import ensure_checkpoints

DAMPING, REST = 0.85, 0.15


def pagerank(nodes: DataFrame | None, edges: DataFrame, epsilon: float = 0.01, percent: float = 100.0, max_iter: int | None = None, exact_iterations: int | None = None) -> DataFrame:
    """(node, rank) from ``nodes(node)`` and ``edges(src, dst)``; without nodes, those of the edges.

    Ranks begin at 1; each turn gives 0.15 and 0.85 of the rank shared out over a node's distinct
    links. Links to unknown nodes and the rank of nodes without links are lost. It ends when
    ``percent`` of the nodes moved by ``epsilon`` at most, or after ``max_iter`` turns if given; all moves together shrink
    to 0.85 a turn, so it ends for any ``epsilon`` above 0. Each turn is one join and one aggregation on the destination;
    ranks are checkpointed, so the plan does not grow.
    """
    ensure_checkpoints(edges.sparkSession)
    links = dealt(adjacency(edges))
    if nodes is None:
        nodes = links.select("src").union(links.select(F.explode("dsts"))).withColumnRenamed("src", "node")
    ranks = nodes.select("node").distinct().withColumn("rank", F.lit(1.0)).checkpoint()
    if ranks.isEmpty():
        links.unpersist()
        return ranks
    most = exact_iterations or max_iter
    for _ in count() if most is None else range(most):
        shares = links.join(ranks, links["src"] == ranks["node"]).select(F.explode("dsts").alias("dst"), (DAMPING * F.col("rank") / F.col("degree")).alias("share"))
        given = shares.groupBy("dst").agg(F.sum("share").alias("got"))
        new = ranks.join(given.withColumnRenamed("dst", "node"), "node", "left").select("node", (REST + F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("before"))
        new = new.checkpoint()
        ranks = new.select("node", "rank")
        if exact_iterations is None:
            if settled(new, epsilon).first()[0] >= percent:
                break
    links.unpersist()
    return ranks


def adjacency(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(src, degree, dsts) of the distinct ``edges(src, dst)``: one row for most sources, of about ``most`` links at the most.

    Edges are dealt once, by source; the rest needs no other exchange.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null").repartition("src").distinct()
    links = links.withColumn("degree", F.count("*").over(Window.partitionBy("src")))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / most))
    return links.groupBy("src", "degree", part.alias("part")).agg(F.collect_list("dst").alias("dsts")).drop("part")


def dealt(links: DataFrame, most: int = 4_000_000) -> DataFrame:
    """Adjacency rows kept by source in tasks of about ``most`` links, so that turns don't move them.

    What a task gives to a node is one row, so fewer and larger tasks send less. A checkpoint forgets how it was dealt, so the rows
    are persisted; if lost they are read from their checkpoint again.
    """
    ensure_checkpoints(links.sparkSession)
    links = links.checkpoint()
    size = links.agg(F.sum(F.size("dsts"))).first()[0] or 0
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-size // most))
    links = links.repartition(tasks, "src").persist()
    links.count()  # only rows that are there tell Spark how they are dealt
    return links


def settled(moves: DataFrame, epsilon: float) -> DataFrame:
    """One row ``percent``: how many of ``moves(rank, before)`` moved by ``epsilon`` at most."""
    return moves.agg(F.avg(F.when(F.abs(F.col("rank") - F.col("before")) <= epsilon, 100.0).otherwise(0.0)).alias("percent"))


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of the links of ``pages(url, page)``; an empty link stands for the page itself."""
    links = pages.select("url", F.explode(extract_links(F.col("page"))).alias("link"))
    return normalise_links(links, self_on_empty=True).select(F.col("url").alias("src"), F.col("normal").alias("dst")).distinct()


def pagerank_of_pages(pages: DataFrame, **how) -> DataFrame:
    """(node, rank) of ``pages(url, page)`` by their links."""
    return pagerank(pages.select(F.col("url").alias("node")), page_links(pages), **how)


def frontier(seeds: DataFrame, links_of: Callable[[DataFrame], DataFrame], max_rounds: int = 10) -> DataFrame:
    """(url, depth) reached from ``seeds(url)`` in rounds; ``links_of`` maps a round's ``url`` rows to found ``url`` rows."""
    ensure_checkpoints(seeds.sparkSession)
    new = seeds.select("url").distinct().withColumn("depth", F.lit(0)).checkpoint()
    seen = new
    for depth in range(1, max_rounds + 1):
        found = links_of(new.select("url")).select("url").where("url is not null").distinct()
        new = found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if new.isEmpty():
            break
        seen = seen.unionByName(new)  # each round is kept once; earlier ones are only read
    return seen


def one_per_host(urls: DataFrame, host: str = "host") -> DataFrame:
    """The least url of each host: what a round may fetch when hosts are asked once a round."""
    return urls.groupBy(host).agg(F.min("url").alias("url"))

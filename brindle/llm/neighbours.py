"""Approximate nearest neighbours with vantage-point trees.

A vantage point halves vectors by their distance to it, its halves have vantage points
of their own, and so on. The upper levels of this tree, fitted on a bounded sample, deal all
vectors over shards; each shard gets the lower levels, down to small leaves. Distances are
those of unit vectors, whose order is the order of the cosine. A search leaves out a shard or a
half if the triangle inequality puts all of it beyond ``factor`` times the distance of the worst
neighbour held so far. With factor one that is exact; below one it skips more and may miss some.

Queries go to trees, not trees to queries: first each to its own shard, and then, with the
bound found there, to those shards that may still hold something nearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm._store import drawn, small, stored

_SLACK = 1e-7  # rounding of distances, so that ties and exact search hold


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so that no square overflows."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / top
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class VantageTree:
    """Nodes as arrays: vantage row, child nodes (or -1), and the range of distances in each child."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 96, seed: int = 3):
        self.ids, self.vectors = ids, vectors
        self.unit = unit_rows(vectors)
        self.nodes: list[tuple] = []
        r = np.random.default_rng(seed)
        # an explicit stack: (rows, parent, side)
        stack = [(np.arange(len(ids)), -1, 0)]
        links: dict[tuple[int, int], int] = {}
        while stack:
            rows, parent, side = stack.pop()
            here = len(self.nodes)
            links[parent, side] = here
            if len(rows) <= leaf:
                self.nodes.append((rows, None, None))
                continue
            point = int(r.integers(len(rows)))
            point, rows = rows[point], np.delete(rows, point)
            d = self._far(self.unit[rows], self.unit[point])
            order = np.argsort(d, kind="stable")
            rows, d = rows[order], d[order]
            half = len(rows) // 2
            self.nodes.append((np.array([point]), (d[0], d[half - 1]), (d[half], d[-1])))
            stack += [(rows[:half], here, 0), (rows[half:], here, 1)]
        self.links = links
        self.measured = 0  # pairs of query and row

    @staticmethod
    def _far(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (rows @ point)))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, within: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """For each query its k best (score, id) found: largest cosine first, ties to the smaller id, never itself.

        All queries go down together: at each node those that may still find something. ``within`` is the distance
        of each query's worst neighbour found elsewhere; what is farther may be left out.
        """
        unit = unit_rows(queries)
        limit = np.full(len(ids), np.inf) if within is None else within
        score = np.full((len(ids), k), -np.inf)
        found = np.full((len(ids), k), np.iinfo(np.int64).max)
        stack: list[tuple[int, np.ndarray, np.ndarray | None]] = [(0, np.arange(len(ids)), None)] if self.nodes else []
        while stack:
            at, who, least = stack.pop()
            if least is not None:  # bounds have moved since this was put off
                keep = least <= factor * np.minimum(limit[who], self._worst(score[who])) + _SLACK
                who = who[keep]
            if not len(who):
                continue
            rows, near, far = self.nodes[at]
            self._offer(rows, who, ids, unit, score, found, k)
            if near is None:
                continue
            d = self._far(unit[who], self.unit[rows[0]])
            for side, (low, high) in ((1, far), (0, near)):
                gap = np.maximum(0.0, np.maximum(low - d, d - high))
                stack.append((self.links[at, side], who, gap))
            # the half that most queries lie in is searched first
            if (d > near[1]).mean() > 0.5:
                stack[-1], stack[-2] = stack[-2], stack[-1]
        return [[(s, i) for s, i in zip(score[q].tolist(), found[q].tolist()) if s > -np.inf] for q in range(len(ids))]

    @staticmethod
    def _worst(score: np.ndarray) -> np.ndarray:
        return np.where(score[:, -1] == -np.inf, np.inf, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * score[:, -1])))

    def _offer(self, rows, who, ids, unit, score, found, k) -> None:
        # einsum, not a matrix product: the same sum for a pair in whatever company it comes
        s = np.einsum("qd,rd->qr", unit[who], self.unit[rows])
        own = self.ids[rows]
        self.measured += s.size
        s[ids[who][:, None] == own[None, :]] = -np.inf
        s = np.concatenate([score[who], s], axis=1)
        i = np.concatenate([found[who], np.broadcast_to(own, (len(who), len(own)))], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        score[who], found[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def pack(self) -> bytes:
        import pickle

        return pickle.dumps((self.ids, self.vectors.astype(np.float64), self.nodes, self.links), protocol=5)

    @classmethod
    def unpack(cls, blob: bytes) -> VantageTree:
        import pickle

        tree = cls.__new__(cls)
        tree.ids, tree.vectors, tree.nodes, tree.links = pickle.loads(blob)
        tree.measured = 0
        tree.unit = unit_rows(tree.vectors) if len(tree.ids) else tree.vectors
        return tree


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


class Router:
    """The upper levels of the tree as a complete binary tree in a heap: vantage points and the distances that halve."""

    def __init__(self, sample: np.ndarray, levels: int, seed: int = 3):
        self.levels, unit, r = levels, unit_rows(sample), np.random.default_rng(seed)
        self.points, self.halves = np.zeros(((1 << levels) - 1, sample.shape[1])), np.zeros((1 << levels) - 1)
        at = [np.arange(len(unit))]
        for node in range(len(self.points)):
            rows = at[node]
            self.points[node] = unit[rows[r.integers(len(rows))]] if len(rows) else self.points[(node - 1) // 2]
            d = VantageTree._far(unit[rows], self.points[node])
            self.halves[node] = np.median(d) if len(rows) else 0.0
            at += [rows[d <= self.halves[node]], rows[d > self.halves[node]]]

    def route(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the leaf, and its distances to the vantage points on the way."""
        node, far = np.zeros(len(unit), np.int64), np.zeros((len(unit), self.levels))
        for level in range(self.levels):
            far[:, level] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("nd,nd->n", unit, self.points[node])))
            node = 2 * node + 1 + (far[:, level] > self.halves[node])
        return node - len(self.points), far

    def gaps(self, unit: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(rows, leaves): the least distance that any vector of a leaf can have, by the ranges to its vantage points."""
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ self.points.T)))
        out = np.zeros((len(unit), 1 << self.levels))
        for level in range(self.levels):
            node = (1 << level) - 1 + (np.arange(1 << self.levels) >> (self.levels - level))
            out = np.maximum(out, np.maximum(low[:, level] - d[:, node], d[:, node] - high[:, level]))
        return out


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(batches: Iterator[pa.RecordBatch], k: int, factor: float) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, part, salt, side, tree, query_id, embedding, within), each tree before its queries, to what these find."""
    tree = None
    for batch in batches:
        side, at = batch.column(3).to_numpy(), 0
        while at < batch.num_rows:
            if side[at] == 0:
                tree, at = VantageTree.unpack(batch.column(4)[at].as_py()), at + 1
                continue
            later = np.flatnonzero(side[at:] == 0)
            end = min(at + 4096, at + int(later[0]) if len(later) else batch.num_rows)
            part = batch.slice(at, end - at)
            ids = part.column(5).to_numpy()
            got = tree.search(ids, _rows(part.column(6)), k, factor, part.column(7).to_numpy())
            flat = [(q, i, s) for q, best in zip(ids.tolist(), got) for s, i in best]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])
            at = end


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = 1.0, shard_rows: int = 8192, sample_rows: int = 65_536, block_rows: int = 65_536) -> DataFrame:
    """The k nearest by cosine to each row whose id is divisible by ``every``, among all other rows.

    Takes ``vectors(vec_id, embedding, ...)``; other columns are ignored. Returns query_id, rank from 1, vec_id, score, the
    nearest first, ties to the smaller vec_id; fewer rows where there are fewer candidates. Scores
    are cosines in double precision. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do null ids, nor vectors of another dimension than most rows have. Rows that repeat
    a vec_id are one candidate, with the first of its vectors in array order, and never a candidate of their own id.
    An empty table gives an empty result.

    The upper levels are fitted on 64 rows a shard, 1,024 at least and ``sample_rows`` at most, the least by a hash of the id, and have a shard for about
    ``shard_rows`` rows, but for 16 rows of the sample at least; all rows are dealt and indexed. Shards that get more, as of a vector
    that many rows share, are cut into parts by a hash. Trees are built once and stored. A shard with many queries
    gets its tree again for each ``block_rows`` of them. At factor 1 the work is quadratic where distances tell nothing
    apart, as for random vectors of many dimensions; a smaller factor bounds it at the price of some neighbours.
    """
    good = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    good = good.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = stored(good.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    sizes = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return small(good.sparkSession, [], schema)
    good = good.where(F.size("embedding") == sizes["d"])
    wanted = min(sample_rows, max(1024, 64 * -(-sizes["count"] // shard_rows)))
    sample = _rows(drawn(good, wanted, "vec_id").select("embedding").toArrow().column(0).combine_chunks())
    levels = int(np.ceil(np.log2(max(1, min(sizes["count"] / shard_rows, len(sample) / 16)))))
    router = Router(sample, levels)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, far = router.route(unit_rows(_rows(batch.column(1)))) if batch.num_rows else (np.zeros(0, np.int64), np.zeros((0, levels)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, max(1, levels), dtype=np.int32) if levels else np.zeros(batch.num_rows + 1, np.int32)), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), lists], names=["vec_id", "embedding", "leaf", "far"])

    dealt = stored(good.mapInArrow(routed, "vec_id long, embedding array<double>, leaf long, far array<double>"), "dealt")
    ranges = [f(F.get("far", F.lit(i))).alias(f"{n}{i}") for i in range(levels) for f, n in ((F.min, "low"), (F.max, "high"))]
    low, high, parts = np.full((1 << levels, levels), np.inf), np.full((1 << levels, levels), -np.inf), {}
    for r in dealt.groupBy("leaf").agg(F.count("*").alias("n"), *ranges).collect():  # a row for each leaf, at most sample_rows / 8
        parts[r["leaf"]] = -(-r["n"] // (2 * shard_rows))
        for i in range(levels):
            low[r["leaf"], i], high[r["leaf"], i] = r[f"low{i}"] - _SLACK, r[f"high{i}"] + _SLACK

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        tree = VantageTree(group["vec_id"].to_numpy(np.int64), _matrix(group["embedding"]))
        return pd.DataFrame({"leaf": [int(group["leaf"].iloc[0])], "part": [int(group["part"].iloc[0])], "tree": [tree.pack()]})

    spark = good.sparkSession
    of_leaf = F.broadcast(small(spark, sorted(parts.items()), "leaf long, parts long"))
    placed = dealt.join(of_leaf, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"), "vec_id", "embedding")
    trees = stored(placed.groupBy("leaf", "part").applyInPandas(build, "leaf long, part long, tree binary"), "trees")

    def wave(asking: DataFrame) -> DataFrame:
        """The k best of ``asking(query_id, leaf, embedding, within)`` in each tree of its leaf."""
        asked = {r["leaf"]: r["n"] for r in asking.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        plan = F.broadcast(small(spark, [(leaf, parts[leaf], -(-n // block_rows)) for leaf, n in sorted(asked.items())], "leaf long, parts long, salts long"))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        none = lambda kind: F.lit(None).cast(kind)
        here = trees.join(plan.select("leaf", "salts"), "leaf").select("leaf", "part", each("salts").alias("salt"), F.lit(0).alias("side"), "tree", none("long").alias("query_id"), none("array<double>").alias("embedding"), none("double").alias("within"))
        there = asking.join(plan, "leaf").select("leaf", each("parts").alias("part"), F.pmod(F.xxhash64("query_id"), F.col("salts")).alias("salt"), F.lit(1).alias("side"), none("binary").alias("tree"), "query_id", "embedding", "within")
        met = here.unionByName(there).repartition("leaf", "part", "salt").sortWithinPartitions("leaf", "part", "salt", "side", "query_id")
        return met.mapInArrow(lambda it: _search(it, k, factor), "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    queries = dealt.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "leaf", "embedding")
    first = stored(best(wave(queries.withColumn("within", F.lit(float("inf"))))), "first")
    worst = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("score")))).otherwise(float("inf")).alias("within"))
    asking = queries.join(worst, "query_id", "left").select("query_id", "leaf", "embedding", F.coalesce("within", F.lit(float("inf"))).alias("within"))

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                near = router.gaps(unit_rows(_rows(part.column(2))), low, high) <= factor * part.column(3).to_numpy()[:, None] + _SLACK
                near[np.arange(len(near)), part.column(1).to_numpy()] = False
                row, leaf = np.nonzero(near & np.isin(np.arange(near.shape[1]), list(parts)))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(leaf.astype(np.int64)), taken.column(2), taken.column(3)], names=["query_id", "leaf", "embedding", "within"])

    more = stored(asking.mapInArrow(elsewhere, "query_id long, leaf long, embedding array<double>, within double"), "more")
    both = best(first.select("query_id", "vec_id", "score").unionByName(wave(more)))
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Placing rows on shards through a hierarchy of weighted hash draws.

A tree has regions, racks and shards. At each level a row draws an exponential
variate for every child, with the child's weight as rate, from a hash of its
key and the child's name; the least draw wins. A child whose weight grows can
only win rows, so rows move into subtrees whose weight grew, out of those whose
weight shrank, and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm._store import stored

_RUN = 10_000  # rows of a group of equal rows that one task makes at once


@dataclass(frozen=True)
class Tree:
    """regions -> racks -> (shard number, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(n_regions: int, n_racks: int, n_shards: int) -> Tree:
        number = iter(range(n_regions * n_racks * n_shards))
        return Tree(tuple(tuple(tuple((next(number), 1.0) for _ in range(n_shards)) for _ in range(n_racks)) for _ in range(n_regions)))

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: rows move into it and nowhere else."""
        number = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return Tree((*self.regions, (((number, weight),),)))


def _draw(key: Column, name: str, weight: float) -> Column:
    """The variate, from 52 bits of a hash that any system can work out again."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("/" + name)))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _least(key: Column, children: list[tuple[str, float, int]]) -> Column:
    if len(children) == 1:
        return F.lit(children[0][2])
    return F.least(*(F.struct(_draw(key, name, w).alias("draw"), F.lit(i).alias("child")) for name, w, i in children))["child"]


def _cases(at: Column, branches: list[Column]) -> Column:
    out = F.when(at == 0, branches[0])
    for i, branch in enumerate(branches[1:], 1):
        out = out.when(at == i, branch)
    return out


def place(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """Add column ``out`` with the shard of each row."""
    weigh = lambda rack: sum(w for _, w in rack)
    k = F.col(key)
    df = df.withColumn("_region", _least(k, [(f"g{i}", sum(map(weigh, g)), i) for i, g in enumerate(tree.regions)]))
    df = df.withColumn("_rack", _cases(F.col("_region"), [_least(k, [(f"g{i}r{j}", weigh(r), j) for j, r in enumerate(g)]) for i, g in enumerate(tree.regions)]))
    shards = [_cases(F.col("_rack"), [_least(k, [(f"g{i}r{j}s{s}", w, s) for s, w in r]) for j, r in enumerate(g)]) for i, g in enumerate(tree.regions)]
    return df.withColumn(out, _cases(F.col("_region"), shards).cast("int")).drop("_region", "_rack")


def shard_rows(docs: DataFrame, tree: Tree | None = None, rows_a_cell: int = 50_000) -> DataFrame:
    """Shard and slot of each document; the key law holds: doc_id and the tree decide.

    Takes ``docs(doc_id, text, ...)``. Returns a row for each input row: doc_id, size
    (UTF-8 bytes and 16), text_crc32, law, shard, slot (gapless from 0 in each shard),
    grown_shard (with one more shard). Null text counts as no bytes with the checksum 0.
    Null doc_ids all go to one shard; rows that repeat a doc_id go to its shard, each
    with a slot of its own. An empty table gives an empty result.

    The same rows give the same result on any layout. Slots are dealt in cells of about ``rows_a_cell`` rows, so that no shard is sorted
    in one task: only the number of rows in each cell is added up along a shard.
    """
    tree = tree or Tree.even(5, 2, 4)
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"))
    placed = place(place(narrow, "doc_id", tree, "shard"), "doc_id", tree.grown(), "grown_shard")
    # rows alike in all that is returned are one group with a number, so that the layout of the files decides nothing
    alike = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    groups = stored(placed.groupBy(*alike).agg(F.count("*").alias("n")), "groups")
    shards = sum(len(rack) for region in tree.regions for rack in region)
    cells = max(1, -(-groups.count() // (shards * rows_a_cell)))
    dealt = groups.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(cells)).cast("int"))
    counts = dealt.groupBy("shard", "cell").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("shard", "cell", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start")), "starts")
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "cell"])
    # a large group is dealt again in runs before it becomes rows
    runs = ranked.select(*alike, "n", (F.col("start") + F.col("before")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_RUN).cast("long"))).alias("at"))
    runs = runs.repartition("doc_id", "text_crc32", "at")
    slots = runs.select(*alike, F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.least(F.col("at") + _RUN, F.col("n")) - 1)).alias("slot"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

"""Mixing sources to target weights by fitting token budgets exactly.

Each source gets a budget of words. Whole passes over the source use up as much
of it as they can. The rest is a subset-sum problem on the source's documents,
solved on their number by exact length: a proportional share of each length,
then a bounded knapsack for what is still left. The documents of a length are
those that come first in a seeded order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm._store import small, stored

WORD = "[^\\x20\\x09-\\x0D]+"
_DP_WORDS = 1 << 15


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Targets of sources that are in order: ``share`` of all words by weight, at most ``most`` times a source's size.

    The excess of sources at their limit is shared out again by weight among the
    others until none is above its limit.
    """
    total = share * sum(n for _, n in sizes)
    limits = [most * n for _, n in sizes]
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    full = {i for i, top in enumerate(limits) if top == 0}
    while True:
        left = total - sum(limits[i] for i in full)
        weight = sum(w for i, w in enumerate(own) if i not in full)
        over = [i for i, w in enumerate(own) if i not in full and left * w / weight > limits[i]]
        if not over:
            return [limits[i] if i in full else left * w / weight for i, w in enumerate(own)]
        full.update(over)


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their words come as near below ``budget`` as can be found."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or total == 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left <= _DP_WORDS:
            break
        more = min(counts[i] - take[i], (left - _DP_WORDS) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    reach, mask, steps = 1, (1 << (left + 1)) - 1, []
    for i, n in sorted(enumerate(lengths), key=lambda x: x[1]):
        spare, part = min(counts[i] - take[i], left // n), 1
        while spare > 0 and not reach >> left & 1:
            part = min(part, spare)
            steps.append((i, part, reach))
            reach |= reach << (n * part) & mask
            spare, part = spare - part, part * 2
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            take[i] += part
            at -= lengths[i] * part
    return take


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    group["extra"] = fit_budget(group["size"].tolist(), group["n"].tolist(), int(group["rest"].iloc[0]))
    return group[["sid", "size", "n", "extra"]]


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, most_sources: int = 100_000) -> DataFrame:
    """Decide how often each document is taken (``copies``) so that sources meet their targets.

    Takes ``docs(doc_id, text, source, ...)``; a document's size is its number of words
    (null text: 0). Sources in code point order, null last, have ``weights``, repeated.
    Returns a row for each input row: doc_id, size, source, source_size, target, copies,
    taken (copies * size). No document is taken more than ``most`` times, rounded up.
    The same rows give the same result on any layout. Documents of size 0 are never
    taken. Rows that repeat a doc_id are documents of their own. An empty table gives
    an empty result.

    The table of sources, one row each, is held on the driver and broadcast; more than
    ``most_sources`` of them are an error.
    """
    base = stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    per = base.groupBy("source").agg(F.sum("size").alias("words")).limit(most_sources + 1).collect()
    if len(per) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    known = sorted(((r["source"], r["words"]) for r in per), key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    rows = []
    for sid, ((source, words), target) in enumerate(zip(known, targets(known, weights, share, most))):
        whole = min(math.floor(target / words), math.floor(most)) if words else 0
        rows.append((sid, source, words, float(target), whole, max(0, round(target) - whole * words)))
    spark = docs.sparkSession
    sources = small(spark, rows, "sid int, source string, source_size long, target double, whole int, rest long")
    placed = base.join(F.broadcast(sources), base["source"].eqNullSafe(sources["source"])).select(base["doc_id"], base["source"], "sid", "size", "source_size", "target", "whole", "rest")
    hist = placed.where("size > 0 and rest > 0").groupBy("sid", "size", "rest").agg(F.count("*").alias("n"))
    plan = stored(hist.groupBy("sid").applyInPandas(_fit, "sid int, size long, n long, extra long").where("extra > 0"), "plan")

    draw = F.xxhash64("doc_id", F.lit(seed))
    cells = F.greatest(F.lit(1), F.ceil(F.col("n") / 2048))
    cell = F.pmod(F.shiftrightunsigned(draw, 32), cells)
    chosen = placed.join(plan, ["sid", "size"], "left").withColumn("draw", draw).withColumn("cell", F.coalesce(cell, F.lit(0)))
    by_cell = chosen.where("extra < n").groupBy("sid", "size", "cell").agg(F.count("*").alias("in_cell"))
    upto = Window.partitionBy("sid", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(by_cell.select("sid", "size", "cell", F.coalesce(F.sum("in_cell").over(upto), F.lit(0)).alias("start")), "cells")
    sure = chosen.where("extra is null or extra >= n").withColumn("more", F.when(F.col("extra").isNull(), 0).otherwise(1))
    within = Window.partitionBy("sid", "size", "cell").orderBy("draw", "doc_id")
    ranked = chosen.where("extra < n").withColumn("rank", F.row_number().over(within)).join(starts, ["sid", "size", "cell"])
    ranked = ranked.withColumn("more", (F.col("start") + F.col("rank") <= F.col("extra")).cast("int"))
    both = sure.select("doc_id", "size", "source", "source_size", "target", "whole", "more").unionByName(ranked.select("doc_id", "size", "source", "source_size", "target", "whole", "more"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.col("more"))
    return both.withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))

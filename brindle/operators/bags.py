"""Bags of strings and bags of key-value pairs as thin layers over DataFrames.

Functions are given as column builders, which stay in the optimiser, or, marked by ``python``, as
Python callables that run on Arrow batches. All operations are lazy. Where a result has all values of a key
in one row (group_by, grouped, cogroup, fold_by_key_ordered), these must fit in one task, as the operation is defined so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Expr = Callable[[Column], Column]
PairExpr = Callable[[Column, Column], Column]


def python(f: Callable) -> Callable:
    """Mark a Python callable on strings, to be given where a column builder could be; it runs on Arrow batches."""
    f_ = lambda *values: f(*values)
    f_.in_python = True
    return f_


def _run(df: DataFrame, f: Callable, schema: str, many: bool) -> DataFrame:
    """Rows of ``f`` over the columns of ``df``: one for each row, or all those of an iterable; null gives none."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = (f(*row) for row in b.itertuples(index=False, name=None))
            made = [x for g in got if g is not None for x in g] if many else [g for g in got if g is not None]
            made = [x for x in made if x is not None]
            columns = zip(*made) if len(names) > 1 else [made]
            yield pd.DataFrame(dict(zip(names, columns)), columns=names, dtype=object)

    return df.mapInPandas(run, schema)


def _in_python(f: Callable) -> bool:
    return getattr(f, "in_python", False)


class Bag:
    """A multiset of strings: one column ``value``.

    Functions are column builders, or Python callables marked by ``python``.
    """

    def __init__(self, df: DataFrame):
        self.df = df.select(F.col(df.columns[0]).cast("string").alias("value"))

    @staticmethod
    def parallelize(spark: SparkSession, values: Iterable[str]) -> Bag:
        return Bag(spark.createDataFrame([(v,) for v in values], "value string"))

    @staticmethod
    def from_table(table: DataFrame, expr: Column | Callable[[dict], str | None]) -> Bag:
        """One element for each row; rows where ``expr`` is null give none. A Python callable gets a row as a dict."""
        if not isinstance(expr, Column):
            names = table.columns
            return Bag(_run(table, lambda *row: expr(dict(zip(names, row))), "value string", False))
        return Bag(table.select(expr.cast("string").alias("value")).where("value is not null"))

    def map(self, f: Expr) -> Bag:
        """One element for each; null gives none."""
        if _in_python(f):
            return Bag(_run(self.df, f, "value string", False))
        return Bag(self.df.select(f(F.col("value")).alias("value")).where("value is not null"))

    def flat_map(self, f: Expr) -> Bag:
        """``f`` gives an array; null and empty arrays give no element."""
        if _in_python(f):
            return Bag(_run(self.df, f, "value string", True))
        return Bag(self.df.select(F.explode(f(F.col("value"))).alias("value")))

    def map_to_pair(self, f: Callable[[Column], tuple[Column, Column]]) -> PairBag:
        if _in_python(f):
            return PairBag(_run(self.df, f, "k string, v string", False))
        k, v = f(F.col("value"))
        return PairBag(self.df.select(k.alias("k"), v.alias("v")).where("k is not null"))

    def flat_map_to_pair(self, f: Expr) -> PairBag:
        """``f`` gives an array of structs of two fields, key and value, or in Python pairs."""
        if _in_python(f):
            return PairBag(_run(self.df, f, "k string, v string", True))
        out = self.df.select(F.explode(f(F.col("value"))).alias("p")).where("p is not null")
        k, v = out.schema["p"].dataType.names
        return PairBag(out.select(F.col("p")[k].alias("k"), F.col("p")[v].alias("v")))

    def filter(self, f: Expr) -> Bag:
        if _in_python(f):
            return Bag(_run(self.df, lambda v: v if f(v) else None, "value string", False))
        return Bag(self.df.where(f(F.col("value"))))

    def map_partitions(self, f: Callable[[Iterator[str]], Iterable[str]]) -> Bag:
        """``f`` runs once for each partition on an iterator of its elements, which streams."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part: list[str] = []
            for value in f(v for b in batches for v in b["value"]):
                part.append(value)
                if len(part) == 10_000:
                    yield pd.DataFrame({"value": part})
                    part = []
            yield pd.DataFrame({"value": pd.Series(part, dtype=object)})

        return Bag(self.df.mapInPandas(run, "value string"))

    def sample(self, share: float, seed: int | None = None) -> Bag:
        return Bag(self.df.sample(False, share, seed))

    def sample_by_hash(self, share: float, seed: int = 0) -> Bag:
        """Elements whose hash lies in the first ``share`` of all hashes: the same in every run, equal ones alike."""
        place = F.conv(F.substring(F.md5(F.concat(F.col("value"), F.lit(f"/{seed}"))), 1, 8), 16, 10).cast("long")
        return Bag(self.df.where(place < int(share * (1 << 32))))

    def distinct(self) -> Bag:
        return Bag(self.df.distinct())

    def intersection(self, other: Bag) -> Bag:
        """Elements of both, each once."""
        return Bag(self.df.intersect(other.df))

    def group_by(self, f: Expr) -> PairBag:
        """Elements by ``f``, in order, joined by commas."""
        if _in_python(f):
            keyed = _run(self.df, lambda v: (f(v), v), "k string, value string", False)
        else:
            keyed = self.df.select(f(F.col("value")).alias("k"), "value")
        return PairBag(keyed.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("v")))

    def fold(self, zero: str, agg: Callable[[Column], Column]) -> DataFrame:
        """One row ``value``: an aggregate of all elements, or ``zero`` for an empty bag."""
        return self.df.agg(F.coalesce(agg(F.col("value")).cast("string"), F.lit(zero)).alias("value"))

    def fold_python(self, zero: str, f: Callable[[str, str], str]) -> str:
        """A left fold inside each partition, then over the partitions; ``zero`` must be neutral."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = zero
            for b in batches:
                for v in b["value"]:
                    acc = f(acc, v)
            yield pd.DataFrame({"value": [acc]})

        out = zero
        for row in self.df.mapInPandas(run, "value string").toLocalIterator():
            out = f(out, row["value"])
        return out

    def count(self) -> int:
        return self.df.count()

    def take(self, n: int) -> list[str]:
        return [r["value"] for r in self.df.take(n)]

    def collect(self) -> list[str]:
        return [r["value"] for r in self.df.collect()]

    def save_as_table(self, name: str, mode: str = "errorifexists") -> None:
        self.df.write.mode(mode).saveAsTable(name)


class PairBag:
    """A multiset of pairs: columns ``k`` and ``v``."""

    def __init__(self, df: DataFrame):
        self.df = df.select(F.col("k").cast("string"), F.col("v").cast("string"))

    def flat_map(self, f: PairExpr) -> Bag:
        if _in_python(f):
            return Bag(_run(self.df, f, "value string", True))
        return Bag(self.df.select(F.explode(f(F.col("k"), F.col("v"))).alias("value")))

    def flat_map_to_pair(self, f: PairExpr) -> PairBag:
        if _in_python(f):
            return PairBag(_run(self.df, f, "k string, v string", True))
        out = self.df.select(F.explode(f(F.col("k"), F.col("v"))).alias("p")).where("p is not null")
        k, v = out.schema["p"].dataType.names
        return PairBag(out.select(F.col("p")[k].alias("k"), F.col("p")[v].alias("v")))

    def fold_by_key(self, zero: str, agg: Callable[[Column], Column]) -> PairBag:
        """An aggregate by key; algebraic ones are combined before the shuffle.

        A Python callable of two strings folds each key's values inside the batches first and then over these parts, so it
        must not depend on order, and ``zero`` must be neutral.
        """
        if _in_python(agg):

            def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    acc: dict[str, str] = {}
                    for k, v in zip(b["k"], b["v"]):
                        acc[k] = agg(acc.get(k, zero), v)
                    yield pd.DataFrame({"k": list(acc), "v": list(acc.values())}, dtype=object)

            def whole(group: pd.DataFrame) -> pd.DataFrame:
                out = zero
                for v in group["v"]:
                    out = agg(out, v)
                return pd.DataFrame({"k": [group["k"].iloc[0]], "v": [out]})

            return PairBag(self.df.mapInPandas(parts, "k string, v string").groupBy("k").applyInPandas(whole, "k string, v string"))
        return PairBag(self.df.groupBy("k").agg(F.coalesce(agg(F.col("v")).cast("string"), F.lit(zero)).alias("v")))

    def fold_by_key_ordered(self, zero: str, f: Callable[[Column, Column], Column]) -> PairBag:
        """A left fold over a key's values in order, for steps that do not commute."""
        return PairBag(self.df.groupBy("k").agg(F.aggregate(F.sort_array(F.collect_list("v")), F.lit(zero), f).alias("v")))

    def join(self, other: PairBag) -> PairBag:
        """For each pair of values of a key: ``left,right``."""
        right = other.df.select("k", F.col("v").alias("w"))
        return PairBag(self.df.join(right, "k").select("k", F.concat_ws(",", "v", "w").alias("v")))

    def cogroup(self, other: PairBag) -> PairBag:
        """For each key of either: ``[values],[values]``, values in order."""
        both = self.df.withColumn("side", F.lit(0)).unionByName(other.df.withColumn("side", F.lit(1)))
        listed = lambda i: F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == i, F.col("v")))), ","), F.lit("]"))
        return PairBag(both.groupBy("k").agg(F.concat_ws(",", listed(0), listed(1)).alias("v")))

    def grouped(self) -> DataFrame:
        """One row for each key with its values in order: the shape of a saved pair table."""
        return self.df.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("values"))

    def save_as_table(self, name: str, mode: str = "errorifexists") -> None:
        self.grouped().write.mode(mode).saveAsTable(name)

    def collect(self) -> list[tuple[str, str]]:
        return [(r["k"], r["v"]) for r in self.df.collect()]

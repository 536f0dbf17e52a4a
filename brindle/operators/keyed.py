"""Tables of rows with free columns: a log of cells whose latest value counts."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "row_key string, col string, value string, seq long"


def latest(log: DataFrame) -> DataFrame:
    """The last cell by ``seq`` for each row and column, combined before the shuffle."""
    return log.groupBy("row_key", "col").agg(F.max_by("value", F.struct("seq", "value")).alias("value"), F.max("seq").alias("seq"))


def rows(cells: DataFrame) -> DataFrame:
    """(row_key, cells map) from current cells."""
    return cells.groupBy("row_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", "value")))).alias("cells"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Current cells after ``new``: its cells replace, all others stay."""
    first = old.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("base"))
    return latest(old.unionByName(new.crossJoin(F.broadcast(first)).withColumn("seq", F.col("seq") + F.col("base")).drop("base")))


def conditional_put(current: DataFrame, puts: DataFrame) -> DataFrame:
    """Outcome of ``puts(row_key, col, value, if_col, equals)``: OK where the row's ``if_col`` is ``equals``, else FAIL."""
    now = current.select("row_key", F.col("col").alias("if_col"), F.col("value").alias("now"))
    return puts.join(now, ["row_key", "if_col"], "left").select("row_key", "col", "value", F.when(F.col("now") == F.col("equals"), "OK").otherwise("FAIL").alias("outcome"))


def scan(table: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= key < end, as text; the bounds are pushed into the scan."""
    keep: Column = F.lit(True)
    if start is not None:
        keep = keep & (F.col("row_key") >= start)
    if end is not None:
        keep = keep & (F.col("row_key") < end)
    return table.where(keep)


def page(cells: DataFrame, from_key: str = "", limit: int = 10) -> DataFrame:
    """The next ``limit`` row keys from ``from_key`` on, with their cells: only the keys are sorted."""
    keys = cells.where(F.col("row_key") >= from_key).select("row_key").distinct().orderBy("row_key").limit(limit)
    return cells.join(F.broadcast(keys), "row_key", "left_semi")


def get(log: DataFrame, row: str, col: str) -> DataFrame:
    """(value) of one cell, or no row."""
    return latest(log.where((F.col("row_key") == row) & (F.col("col") == col))).select("value")


def exists(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(row_key, found) for each of ``keys(row_key)``."""
    there = log.select("row_key").distinct().withColumn("found", F.lit(True))
    return keys.join(there, "row_key", "left").select("row_key", F.coalesce("found", F.lit(False)).alias("found"))


def count(log: DataFrame) -> DataFrame:
    """One row ``n``: the number of row keys."""
    return log.select("row_key").distinct().agg(F.count("*").alias("n"))


def pivoted(cells: DataFrame, from_key: str = "", limit: int = 10) -> DataFrame:
    """The next rows as a table with a column for each column name on this page, in order; missing cells are null."""
    shown = page(cells, from_key, limit)
    names = [r["col"] for r in shown.select("col").distinct().orderBy("col").collect()]
    return shown.groupBy("row_key").pivot("col", names).agg(F.max("value")).orderBy("row_key") if names else shown.select("row_key")


def routed(cells: DataFrame, workers: int) -> DataFrame:
    """Cells dealt by ranges of the row key, in order within each: every key has one place, and scans read few."""
    return cells.repartitionByRange(workers, "row_key").sortWithinPartitions("row_key", "col")


class KeyedTable:
    """A named table in the catalog. Writes append cells; reads see the latest."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def persist(self) -> None:
        """Create the table; one that exists is an error."""
        self.spark.createDataFrame([], CELLS).write.mode("errorifexists").saveAsTable(self.name)

    def log(self) -> DataFrame:
        return self.spark.table(self.name) if self.exists() else self.spark.createDataFrame([], CELLS)

    def cells(self) -> DataFrame:
        return latest(self.log())

    def batch_put(self, cells: Iterable[tuple[str, str, str]] | DataFrame) -> None:
        """Append many cells in one write; in a list the later of two equal cells counts."""
        base = time.time_ns()  # later writes have larger numbers; the log is not read for it
        if isinstance(cells, DataFrame):
            new = cells.select("row_key", "col", "value", F.lit(base).cast("long").alias("seq"))
        else:
            new = self.spark.createDataFrame([(*c, base + i) for i, c in enumerate(cells)], CELLS)
        new.write.mode("append").saveAsTable(self.name)

    def put(self, row: str, col: str, value: str, if_col: str | None = None, equals: str | None = None) -> bool:
        if if_col is not None and (not self.exists() or self.get(row, if_col) != equals or equals is None):
            return False
        self.batch_put([(row, col, value)])
        return True

    def put_row(self, row: str, cells: dict[str, str]) -> None:
        self.batch_put([(row, c, v) for c, v in cells.items()])

    def get(self, row: str, col: str) -> str | None:
        found = get(self.log(), row, col).first()
        return found["value"] if found else None

    def get_row(self, row: str) -> dict[str, str] | None:
        found = rows(latest(self.log().where(F.col("row_key") == row))).first()
        return found["cells"] if found else None

    def exists_row(self, row: str) -> bool:
        return not self.log().where(F.col("row_key") == row).isEmpty()

    def scan(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return rows(latest(scan(self.log(), start, end)))

    def count(self) -> int:
        return count(self.log()).first()["n"]

    def page(self, from_key: str = "", limit: int = 10) -> DataFrame:
        return pivoted(self.cells(), from_key, limit)

    def compact(self) -> None:
        """Rewrite the log as current cells, through a table beside it."""
        beside = f"{self.name}__compacted"
        old = f"{self.name}__old"
        routed(self.cells().select("row_key", "col", "value", "seq"), int(self.spark.conf.get("spark.sql.shuffle.partitions"))).write.mode("overwrite").saveAsTable(beside)
        # the old log keeps a name until the new one has its own
        self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {old}")
        self.spark.sql(f"ALTER TABLE {beside} RENAME TO {self.name}")
        self.spark.sql(f"DROP TABLE {old}")

    def rename(self, to: str) -> None:
        """An error where the table is missing or the new name is taken."""
        if not self.exists():
            raise LookupError(self.name)
        if self.spark.catalog.tableExists(to):
            raise FileExistsError(to)
        self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {to}")
        self.name = to

    def delete(self) -> None:
        if not self.exists():
            raise LookupError(self.name)
        self.spark.sql(f"DROP TABLE {self.name}")


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def summary(spark: SparkSession) -> list[tuple[str, int, bool]]:
    """(name, number of row keys, whether it outlives the session) of each keyed table."""
    out = []
    for t in spark.catalog.listTables():
        df = spark.table(t.name)
        if {"row_key", "col", "value"} <= set(df.columns):
            out.append((t.name, count(df).first()["n"], not t.isTemporary))
    return sorted(out)

"""Intermediate tables that every executor can read again after a loss.

Lineage is cut by writing Parquet below the folder named by
``spark.checkpoint.dir``; only where that setting is missing (tests on one
machine) is a folder of our own made and entered into the session.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_KEY = "spark.checkpoint.dir"
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {_KEY} to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set(_KEY, where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/brindle-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_sweep)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _written.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # a folder that is already gone is no failure
        pass


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path:
            remove(df.sparkSession, path)
            for paths in _written.values():
                if path in paths:
                    paths.remove(path)


def small(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of a few rows, sent to the JVM as Arrow so that no Python worker starts for it."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), kind)


def drawn(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most ``rows`` rows, the least by a hash of ``by``.

    Rows far from the least are left out by a bound on the hash before any are sorted,
    so about twice the rows asked for meet in the last task, however large the table.
    """
    share = min(1.0, 2 * rows / max(1, df.count()))
    near = F.pmod(F.xxhash64(*by), F.lit(1 << 30)) < int(share * (1 << 30))
    draw = F.pmod(F.xxhash64(*by), F.lit(1 << 30))
    return df.where(near).orderBy(draw, *by).limit(rows)

"""Readers and writers of the library's tables."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and columns are pushed into its scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case words of a text file with one word a line; a missing file has none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "word string")
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str, str]] | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(url, response_code, content_type, page) of ``urls(url)``.

    Without a network the pages come from a table ``pages(url, page)``; a ``fetch`` function
    from url to (code, type, body) is run in batches on the executors instead. A url is answered with each page
    stored under it, empty ones too, as often as it is asked for.
    """
    if pages is not None:
        hit = pages.select(F.col("url").alias("_url"), F.lit(200).alias("code"), F.lit("text/html").alias("content_type"), "page")
        found = urls.join(hit, F.equal_null("url", "_url"), "left")
        return found.select("url", F.coalesce("code", F.lit(404)).alias("response_code"), "content_type", "page")
    if fetch is None:
        raise ValueError("give a fetch function or a table of pages")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [fetch(u) for u in batch["url"]]
            yield pd.DataFrame({"url": batch["url"], "response_code": [g[0] for g in got], "content_type": [g[1] for g in got], "page": [g[2] for g in got]})

    return urls.select("url").mapInPandas(run, "url string, response_code int, content_type string, page string")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; a folder of our own only where that is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(where)


def dense_ids(df: DataFrame, order: list[str], name: str, base: int = 0) -> DataFrame:
    """Number rows base+1, base+2, ... in the order of unique columns, without sorting in one task.

    Rows are dealt by range and kept; the rows in each range give the offsets.
    """
    ensure_checkpoints(df.sparkSession)
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = dict(dealt.groupBy("_range").count().collect())
    offsets: dict[int, int] = {}
    for part in sorted(counts):
        offsets[part] = base
        base += counts[part]
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long"))
    from pyspark.sql import Window

    start: Column = F.element_at(F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)), F.col("_range"))
    return dealt.withColumn(name, (start + F.row_number().over(Window.partitionBy("_range").orderBy(*order))).cast("long")).drop("_range")

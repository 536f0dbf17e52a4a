"""Keeping a posting table up to date from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from brindle.functions.text import tokens
from brindle.operators.index import postings_count


def index_stream(docs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append each batch's postings with the batch as version; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, version: int) -> None:
        postings_count(batch, tokens("text")).write.mode("overwrite").parquet(f"{path}/version={version}")

    writer = docs.select("doc_id", "text").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_postings(postings: DataFrame) -> DataFrame:
    """Of each document the postings of its latest version: indexing a document again replaces it."""
    last = postings.groupBy("doc_id").agg(F.max("version").alias("version"))
    return postings.join(last, ["doc_id", "version"], "left_semi").select("term", "doc_id", "tf")

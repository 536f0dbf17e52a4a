"""A training corpus from raw documents in five stages.

Each stage takes what its predecessor kept and all but the last return the columns
of ``documents``. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm._store import stored
from brindle.llm.language import identify_languages
from brindle.llm.mixing import WORD, mix_sources
from brindle.llm.near_dedup import near_duplicates
from brindle.llm.pieces import encode_documents
from brindle.llm.queries import piece_model
from brindle.llm.secrets import scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain stay as they are; others, and null, empty and letterless texts, go.

    Rows that repeat a doc_id, or have none, are judged by their own texts; rows alike in doc_id and text go
    together, if any of them is rejected. An empty table gives an empty one. Columns beside those of documents go.
    """
    rejected = identify_languages(docs).where("not accepted").select("doc_id", "text_hash").distinct()
    return _without(docs.select(*COLUMNS), rejected)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows with a (doc_id, text_hash) of ``gone``; nulls are alike."""
    gone = stored(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(gone, same, "left_anti")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest doc_id stays.

    Texts without a word and rows without a doc_id are in no group and stay. Different texts under one doc_id
    are judged apart; of rows of one group that share its smallest doc_id, the least in order of
    all columns stays. An empty table gives an empty one. Columns beside those of documents go.
    """
    docs = docs.select(*COLUMNS)
    found = stored(near_duplicates(docs, shingle=5, percent=80), "groups")
    out = _without(docs, found.where("not kept").select("doc_id", "text_hash").distinct())
    heads = found.where("kept and n_shingles > 0 and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "group_hash")
    repeated = stored(heads.groupBy("_id", "group_hash").agg(F.count("*").alias("n")).where("n > 1").select("_id").distinct(), "repeated")
    if repeated.isEmpty():
        return out
    mine = out.join(repeated, F.col("doc_id") == F.col("_id"), "left_semi")
    mine = mine.join(heads.distinct(), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    once = mine.where("_id is not null").groupBy("doc_id", "group_hash").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    rest = out.join(repeated, F.col("doc_id") == F.col("_id"), "left_anti").unionByName(mine.where("_id is null").select(*COLUMNS))
    return rest.unionByName(once)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked and n_chars follows.

    Null and empty texts stay as they are, repeated rows are masked alike, an empty table gives an empty
    one. Columns beside those of documents go.
    """
    found = scan_secrets(docs.select(*COLUMNS))
    changed = F.size("findings") > 0
    return found.select(
        "doc_id", F.col("redacted").alias("text"), "lang", "source",
        F.when(changed, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows alike in doc_id, source and size are taken alike. Null, empty and wordless texts have no size and
    are never taken. An empty table gives an empty one. Columns beside those of documents go.
    """
    copies = mix_sources(docs).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    copies = copies.select(*(F.col(c).alias(f"_{c}") for c in copies.columns))
    sized = docs.select(*COLUMNS).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    same = sized["doc_id"].eqNullSafe(copies["_doc_id"]) & sized["source"].eqNullSafe(copies["_source"]) & (sized["size"] == copies["_size"])
    return sized.join(copies, same).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copy")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether they decode to its text.

    Null and empty texts have no ids; repeated rows have the same; an empty table gives an empty one.
    """
    return encode_documents(docs, piece_model(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secrets_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Classifiers, hashes and a knapsack have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

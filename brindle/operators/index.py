"""Inverted indexes as long posting tables: one row for each term and document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.stem import stems_of
from brindle.functions.text import is_zip, page_words
from brindle.sources.tables import dense_ids


def doc_ids(pages: DataFrame, known: DataFrame | None = None, mode: str = "append") -> DataFrame:
    """(doc_id, url, encoded_url) for new urls in order, numbered on from those known; urls with ``..`` have none.

    In mode ``rebuild`` what is known is forgotten and all urls are numbered from 1.
    """
    if mode not in ("append", "rebuild"):
        raise ValueError(f"no such mode: {mode}")
    known = known if mode == "append" else None
    new = pages.select("url").where("url is not null").distinct().withColumn("encoded_url", F.url_encode("url")).where(~F.contains("encoded_url", F.lit("..")))
    base = 0
    if known is not None:
        new = new.join(known.select("url"), "url", "left_anti")
        base = known.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    return dense_ids(new, ["url"], "doc_id", base).select("doc_id", "url", "encoded_url")


def _merged(docs: DataFrame) -> bool:
    """Whether some document has several rows, whose postings have to be put together. Reads ids only."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def postings_count(docs: DataFrame, words: Column, stems: bool = False) -> DataFrame:
    """(term, doc_id, tf) from ``docs(doc_id, ...)`` and an array expression of its words.

    Words are counted inside their row, as runs of its sorted words, so that nothing is exchanged if ids are unique.
    """
    rows = docs.select("doc_id", words.alias("words"))
    if stems:
        rows = rows.withColumn("words", F.concat("words", F.filter(stems_of(F.col("words")), lambda s: s != "")))
    rows = rows.select("doc_id", F.sort_array("words").alias("words"))
    w, at = F.col("words"), F.col("at")
    first = F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i))
    rows = rows.withColumn("at", F.array_compact(first))
    runs = F.transform(at, lambda a, i: F.struct(F.get(w, a).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(w)) - a).cast("long").alias("tf")))
    counted = rows.select("doc_id", F.inline(runs)).select("term", "doc_id", "tf")
    return counted.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")) if _merged(docs) else counted


def postings_present(docs: DataFrame, words: Column) -> DataFrame:
    """(term, doc_id) for each word of a document once: postings of which no count is asked. Found inside the row, without a sort."""
    found = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("term")).select("term", "doc_id")
    return found.distinct() if _merged(docs) else found


def postings_positional(docs: DataFrame, words: Column, stems: bool = False) -> DataFrame:
    """(term, doc_id, tf, positions) with positions from 1; a stem has the positions of its words. Found inside the row, as counts are."""
    rows = docs.select("doc_id", words.alias("words"))
    placed = lambda array: F.transform(array, lambda x, i: F.struct(x.alias("term"), (i + 1).alias("pos")))
    found = placed(F.col("words"))
    if stems:
        found = F.concat(found, F.filter(placed(stems_of(F.col("words"))), lambda x: x["term"] != ""))
    rows = rows.select("doc_id", F.sort_array(found).alias("words"))
    w, at = F.col("words"), F.col("at")
    first = F.transform(w, lambda x, i: F.when((i == 0) | (x["term"] != F.get(w, i - 1)["term"]), i))
    rows = rows.withColumn("at", F.array_compact(first))

    def run(a: Column, i: Column) -> Column:
        n = F.coalesce(F.get(at, i + 1), F.size(w)) - a
        return F.struct(F.get(w, a)["term"].alias("term"), n.cast("long").alias("tf"), F.slice(w, a + 1, n)["pos"].alias("positions"))

    found = rows.select("doc_id", F.inline(F.transform(at, run))).select("term", "doc_id", "tf", "positions")
    if _merged(docs):
        found = found.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return found


def term_stats(postings: DataFrame, n_docs: int | None = None) -> DataFrame:
    """(term, df, idf) with idf = log10(D / df); D, if not given, is the number of documents in the postings."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    if n_docs is not None:
        return df.withColumn("idf", F.log10(F.lit(float(n_docs)) / F.col("df")))
    all_docs = postings.select("doc_id").distinct().agg(F.count("*").alias("d"))  # one row
    return df.crossJoin(F.broadcast(all_docs)).select("term", "df", F.log10(F.col("d") / F.col("df")).alias("idf"))


def index_pages(pages: DataFrame, known: DataFrame | None = None, mode: str = "append", stems: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, postings) of ``pages(url, page)``: ids, and the counts of each page's words and their stems.

    A page is cut, parsed to text, scrubbed and cleaned, and its first valid words count. With
    ``known`` documents and mode ``append`` only new urls get ids, and pages of all known and new ids are indexed.
    """
    new = doc_ids(pages, known, mode)
    documents = new if known is None or mode == "rebuild" else known.select(*new.columns).unionByName(new)
    numbered = pages.where("page is not null and page <> ''").join(documents.select("url", "doc_id"), "url").select("doc_id", page_words("page").alias("words"))
    return documents, postings_count(numbered, F.col("words"), stems)


def zip_table(words: DataFrame) -> DataFrame:
    """(doc_id, zipcode) from ``words(doc_id, pos, term)``: the ZIP codes of a document in order, repeats kept."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"])
    return words.where(is_zip(F.col("term"))).groupBy("doc_id").agg(F.array_join(listed, ",").alias("zipcode"))


def merge_indexes(first: DataFrame, second: DataFrame, accumulate: bool = False) -> DataFrame:
    """Postings of both; where both have a term and document the second counts, or the sum of both."""
    a, b = first.select("term", "doc_id", F.col("tf").alias("a")), second.select("term", "doc_id", F.col("tf").alias("b"))
    tf = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) if accumulate else F.coalesce("b", "a")
    # sorted by document first: postings come in runs of a document's terms, and few keys tie in their first eight bytes
    return a.join(b, ["doc_id", "term"], "full_outer").select("term", "doc_id", tf.alias("tf"))


def merge_doc_ids(first: DataFrame, second: DataFrame) -> DataFrame:
    """Documents of both maps by id; the second counts."""
    a, b = first.select("doc_id", F.struct("url", "encoded_url").alias("a")), second.select("doc_id", F.struct("url", "encoded_url").alias("b"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce("b", "a").alias("x")).select("doc_id", "x.*")


def merge_all(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two indexes, each (documents, postings), as one."""
    return merge_doc_ids(first[0], second[0]), merge_indexes(first[1], second[1])


def content_dedup(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, canonical): the least key with the same body, by hash of the body."""
    hashed = pages.where(F.col(body).isNotNull()).select(F.col(key).alias("key"), F.sha1(body).alias("h"))
    return hashed.join(hashed.groupBy("h").agg(F.min("key").alias("canonical")), "h").select("key", "canonical")

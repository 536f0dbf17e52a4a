"""Ranked retrieval over posting tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.stem import stem

# Fixed values of the serving ranker.
EXACT_BOOST, STEM_BOOST = 50.0, 25.0
POSTING_CAP, RESULT_CAP, PAGE_SIZE = 2000, 101, 10
# Shares of the documents, least by hash, that are counted before a cap; the largest is read twice.
LOW_SHARES = (1 / 8, 1 / 32, 1 / 128, 1 / 512)
NO_TITLE, NO_PAGE = "No title found", "No page found"


def tfidf(postings: DataFrame, stats: DataFrame, words: list[str], limit: int | None = RESULT_CAP) -> DataFrame:
    """(doc_id, score) with the sum of (1 + log10 tf) * idf; a word asked for twice counts twice.

    Postings are cut to the query's words before the join, which pushes into a scan of a stored index.
    """
    asked = {w: words.count(w) for w in words}
    times = F.element_at(F.create_map(*(F.lit(x) for kv in asked.items() for x in kv)), F.col("term"))
    hits = postings.where(F.col("term").isin(*asked)).join(stats.where(F.col("term").isin(*asked)).select("term", "idf"), "term")
    out = hits.groupBy("doc_id").agg(F.sum(times * (1 + F.log10("tf")) * F.col("idf")).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "doc_id").limit(limit)


def _often(postings: DataFrame, cap: int) -> DataFrame:
    """(often, bound): terms with ``cap`` postings or more whose documents hash below a bound, the least such of ``LOW_SHARES``."""
    place = F.xxhash64("doc_id")
    bounds = [int(share * 2**64) - 2**63 for share in sorted(LOW_SHARES)]
    counts = postings.where(place < bounds[-1]).groupBy(F.col("term").alias("often")).agg(*(F.count_if(place < b).alias(f"n{i}") for i, b in enumerate(bounds)))
    least = F.coalesce(*(F.when(F.col(f"n{i}") >= cap, F.lit(b)) for i, b in enumerate(bounds)))
    return counts.where(F.col(f"n{len(bounds) - 1}") >= cap).select("often", least.alias("bound"))


def capped(postings: DataFrame, cap: int = POSTING_CAP, ahead: bool = True) -> DataFrame:
    """Of each term's postings at most ``cap``, those least by a hash of their document.

    With ``ahead`` the documents of least hash are counted beforehand: a term that has ``cap`` postings below a bound has no place
    for one above it, so these need not be exchanged and sorted. The result is the same. Such terms are at most one for each
    ``cap`` postings counted.
    """
    if ahead and (often := _often(postings, cap).toArrow()).num_rows:
        known = F.broadcast(postings.sparkSession.createDataFrame(often))
        postings = postings.join(known, (F.col("term") == F.col("often")) & (F.xxhash64("doc_id") >= F.col("bound")), "left_anti")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return postings.withColumn("place", place).where(F.col("place") <= cap).drop("place")


def search(postings: DataFrame, docs: DataFrame, words: list[str], n_docs: int | None = None, stems: bool = True, cap: int | None = POSTING_CAP, limit: int | None = RESULT_CAP) -> DataFrame:
    """(doc_id, score) of the serving ranker over ``docs(doc_id, url)``.

    Words are taken in order, each first as it is, then as its stem where that differs. At each step
    a document's total grows by (1 + log10 tf) * log10(N / n) and is then multiplied by 50, or 25 for
    a stem, if its url contains the word. N defaults to half the documents. Of a term's postings
    at most ``cap`` take part, those least by a hash of their document.
    """
    n_docs = docs.count() // 2 if n_docs is None else n_docs
    steps: list[tuple[int, str, str, float]] = []
    for word in words:
        steps.append((len(steps), word, word, EXACT_BOOST))
        if stems and (s := stem(word)) != word:
            steps.append((len(steps), s, word, STEM_BOOST))
    if not steps:
        return docs.select("doc_id", F.lit(0.0).alias("score")).where("false")
    plan = F.broadcast(docs.sparkSession.createDataFrame(steps, "ord int, term string, word string, boost double"))
    hits = postings.where(F.col("term").isin(*{s[1] for s in steps}))
    if cap is not None:
        hits = capped(hits, cap, ahead=False)  # few terms
    sizes = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("n")))
    found = hits.join(sizes, "term").join(plan, "term").join(docs.select("doc_id", F.lower("url").alias("url")), "doc_id")
    weight = (1 + F.log10("tf")) * F.log10(F.lit(float(max(n_docs, 1))) / F.col("n"))
    boost = F.when(F.contains("url", "word"), F.col("boost")).otherwise(1.0)
    per = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", weight.alias("w"), boost.alias("b")))).alias("steps"))
    out = per.select("doc_id", F.aggregate("steps", F.lit(0.0), lambda a, x: (a + x["w"]) * x["b"]).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "doc_id").limit(limit)


def harmonic_merge(scores: DataFrame, ranks: DataFrame) -> DataFrame:
    """(url, score) with the harmonic mean of a text score and a page rank; urls without a rank drop out."""
    p, t = F.col("rank"), F.col("text_score")
    return scores.select("url", F.col("score").alias("text_score")).join(ranks.select("url", "rank"), "url").select("url", F.try_divide(2 * p * t, p + t).alias("score"))


def merged_in_order(scores: DataFrame, ranks: DataFrame) -> DataFrame:
    """The harmonic merge in order of url."""
    return harmonic_merge(scores, ranks).orderBy("url")


def page_of(results: DataFrame, offset: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """The next ``size`` of ranked results after the first ``offset``."""
    return results.orderBy(F.desc("score"), "doc_id").offset(offset).limit(size)


def packaged(results: DataFrame, docs: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, score, title, description, url) of ranked results; the description is a quarter of the page."""
    joined = results.join(docs.select("doc_id", "encoded_url"), "doc_id").withColumn("url", F.try_url_decode("encoded_url")).join(titles, "url", "left")
    quarter = F.substring("page", F.lit(1), F.floor(F.length("page") / 4).cast("int"))
    return joined.select("doc_id", "score", F.coalesce("title", F.lit(NO_TITLE)).alias("title"), F.coalesce(quarter, F.lit(NO_PAGE)).alias("description"), "url")


def results_json(results: DataFrame) -> DataFrame:
    """One row ``json`` with the bounded list of packaged results in order of score."""
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "title", "description", "url"))), lambda r: F.struct(r["title"].alias("title"), r["description"].alias("description"), r["url"].alias("url")))
    return results.agg(F.to_json(F.struct(ranked.alias("results"))).alias("json"))

"""Phrase search and completion."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _moved(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p + by)


def phrase_pairwise(positional: DataFrame, words: list[str]) -> DataFrame:
    """doc_id where each two words that follow each other in order of rarity have some positions as far apart as in the phrase.

    Occurrences are not chained, so this is looser than ``phrase_exact``. A missing word or a phrase of one word gives nothing.
    """
    if len(words) < 2:
        return positional.select("doc_id").where("false")
    hits = positional.where(F.col("term").isin(*set(words)))
    frequency = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}
    if any(w not in frequency for w in words):
        return positional.select("doc_id").where("false")
    order = sorted(range(len(words)), key=lambda i: (frequency[words[i]], i))
    per = hits.groupBy("doc_id").agg(*(F.first(F.when(F.col("term") == w, F.col("positions")), True).alias(f"p{i}") for i, w in enumerate(words)))
    tests = [F.arrays_overlap(_moved(f"p{a}", b - a), F.col(f"p{b}")) for a, b in zip(order, order[1:])]
    return per.where(reduce(lambda a, b: a & b, tests)).select("doc_id")


def phrase_exact(positional: DataFrame, words: list[str]) -> DataFrame:
    """doc_id where the words stand one after another."""
    if not words:
        return positional.select("doc_id").where("false")
    hits = positional.where(F.col("term").isin(*set(words)))
    per = hits.groupBy("doc_id").agg(*(F.first(F.when(F.col("term") == w, F.col("positions")), True).alias(f"p{i}") for i, w in enumerate(words)))
    starts = [_moved(f"p{i}", -i) for i in range(len(words))]
    return per.where(F.size(reduce(F.array_intersect, starts)) > 0).select("doc_id")


def documents_with_all(postings: DataFrame, words: list[str]) -> DataFrame:
    """doc_id that holds every word."""
    wanted = set(words)
    return postings.where(F.col("term").isin(*wanted)).groupBy("doc_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(wanted)).select("doc_id")


def autocomplete(words: DataFrame, typed: str, limit: int = 10) -> DataFrame:
    """The first words of ``words(word)`` that begin with what follows the last space; other signs than a-z give none."""
    prefix = typed.lower().rpartition(" ")[2]
    if not re.fullmatch("[a-z]*", prefix):
        return words.select("word").where("false")
    return words.select("word").where(F.startswith("word", F.lit(prefix))).distinct().orderBy("word").limit(limit)


def contains_word(words: DataFrame, word: str) -> bool:
    return not words.where(F.col("word") == word).isEmpty()


def starts_any(words: DataFrame, prefix: str) -> bool:
    return not words.where(F.startswith("word", F.lit(prefix))).isEmpty()

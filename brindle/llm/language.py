"""Language identification by fusing evidence on a log scale.

Four kinds of evidence are added up for each language: the likelihood of the
text's byte trigrams, the language declared in the markup, the suffix of the
address, and the host. What a declaration, a suffix or a host says is estimated
from the documents themselves by grouped counts of the text's own verdicts,
smoothed from host to domain to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm._store import small, stored
from brindle.llm._words import _LOWER, slices

_CELLS = 1 << 16
_NOISE = np.ones(256, bool)
_NOISE[ord("a") : ord("z") + 1] = False
_NOISE[0x80:] = False


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cell of the trigram that ends at each byte, with all but letters as blanks, and each text's first byte."""
    parts = [f" {t or ''} ".lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = _LOWER[np.frombuffer(b"".join(parts), np.uint8)].astype(np.uint32)
    raw[_NOISE[raw]] = 0x20
    cells = raw.copy()
    cells[1:] += raw[:-1] * np.uint32(0x1F35)
    cells[2:] += raw[:-2] * np.uint32(0x9E3B1)
    cells = (cells ^ (cells >> np.uint32(13))) * np.uint32(0x85EBCA6B)
    at = np.cumsum([0, *map(len, parts)])[:-1]
    cells = (cells >> np.uint32(16)).astype(np.int64)
    quiet = raw == 0x20
    blank = quiet.copy()
    blank[1:] &= quiet[:-1]
    blank[at] = True
    cells[blank] = -1
    return cells, at


def _counted(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(languages), _CELLS), np.int64)
    index = {x: i for i, x in enumerate(languages)}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for a, b, texts in slices(batch, 0):
            cells, at = _trigrams(texts)
            which = np.repeat([index[x] for x in langs[a:b]], np.diff([*at, len(cells)]))
            real = cells >= 0
            total += np.bincount(which[real] * _CELLS + cells[real], minlength=total.size).reshape(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int32).tobytes()])], names=["counts"])


class TextModel:
    """Log-probabilities of trigram cells by language, as whole units of 1/1024 to keep the table small."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = (counts + 0.2) / (counts.sum(axis=1, keepdims=True) + 0.2 * _CELLS)
        table = np.log(p) - (np.log(p).max(axis=0) if languages else 0)
        self.table = np.vstack([table.T, np.zeros((1, len(languages)))]).astype(np.float32)

    def logs(self, texts: list[str | None], most: int) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) log-likelihoods of the average trigram times at most ``most``; number of trigrams.

        Neighbouring trigrams depend on each other, so a long text counts as ``most`` independent ones.
        """
        cells, at = _trigrams(texts)
        n = np.add.reduceat((cells >= 0).astype(np.int64), at)
        sums = np.stack([np.add.reduceat(self.table[cells, i].astype(np.float64), at) for i in range(len(self.languages))], axis=1)
        return sums * np.minimum(1, most / np.maximum(n, 1))[:, None], n


def _smoothed(count: Column, total: Column, back: Column, weight: float) -> Column:
    return (F.coalesce(count, F.lit(0)) + weight * back) / (F.coalesce(total, F.lit(0)) + weight)


def _sample(marked: DataFrame, languages: dict[str, int], rows: int) -> DataFrame:
    """At most ``rows`` rows (key, text, lang) of each language, the least by a hash of the row.

    A bound on the hash for each language leaves about twice as many to be sorted, however large the table.
    """
    draw = F.pmod(F.xxhash64("key", "text", "lang"), F.lit(1 << 30))
    bounds = [(x, int(min(1.0, 2 * rows / n) * (1 << 30))) for x, n in languages.items()]
    bound = F.broadcast(small(marked.sparkSession, bounds, "lang string, _bound long"))
    near = marked.join(bound, "lang").where(draw < F.col("_bound"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "key", "text"))
    return near.withColumn("_place", place).where(F.col("_place") <= rows).select("key", "text", "lang")


def _trained(docs: DataFrame, key: str, text: str, declared: str, learn_rows: int, most_languages: int) -> TextModel:
    marked = docs.where(F.col(declared).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(declared).cast("string").alias("lang"))
    counted = {r["lang"]: r["count"] for r in marked.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(counted) > most_languages:
        raise ValueError(f"more than {most_languages} declared languages")
    languages = sorted(counted)
    if not languages:
        return TextModel([], np.zeros((0, _CELLS), np.int64))
    known = stored(_sample(marked, counted, learn_rows).select("text", "lang"), "lid-sample")
    parts = known.repartition(4).mapInArrow(lambda it: _counted(it, languages), "counts binary").collect()
    counts = sum((np.frombuffer(p["counts"], np.int32).reshape(len(languages), _CELLS).astype(np.int64) for p in parts), np.zeros((len(languages), _CELLS), np.int64))
    return TextModel(languages, counts)


def identify_languages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str | None = "source", domain: str | None = None, suffix: str | None = None,
    accept: tuple[str, ...] | None = None, least: float = 0.6, learn_rows: int = 4000, most_languages: int = 256, most_trigrams: int = 60, weight: float = 20.0,
) -> DataFrame:
    """The language of each document, with its posterior probability.

    ``declared`` is the column with the language that the markup declares; ``host``, ``domain`` and
    ``suffix`` are columns or None. The languages are all values declared beside a text in any row; the text model is
    fitted on at most ``learn_rows`` rows of each, the least by a hash of the row. As a table of 256 kB a language is
    sent to each task, more than ``most_languages`` values are an error and none is left out. All counts of hosts,
    suffixes and declarations are over all rows.

    Returns a row for each input row: the key, n_trigrams, text_lang (by text alone), pred_lang,
    posterior, accepted (posterior at least ``least``, some letters, and among ``accept`` if given), and text_hash, by
    which rows of a repeated key are told apart.
    Null, empty and letterless texts have null text_lang, rest on the other evidence and are not accepted.
    Nulls in other columns are no evidence. Long texts are read whole. Of languages that tie, the first in order of name is taken. Rows alike in all these columns are judged alike. An empty table, or one without any declared
    language, gives null languages that are not accepted.
    """
    one = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    given = docs.select(F.col(key).alias(key), F.col(text).alias("_text"), one(declared).alias("_d"), one(host).alias("_h"), one(domain).alias("_o"), one(suffix).alias("_s"), F.xxhash64(F.col(text)).alias("_t"))
    model = _trained(docs, key, text, declared, learn_rows, most_languages)
    names = model.languages
    if not names:
        none = F.lit(None).cast("string")
        return given.select(key, F.lit(0).cast("long").alias("n_trigrams"), none.alias("text_lang"), none.alias("pred_lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"), F.col("_t").alias("text_hash"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [model.logs(texts, most_trigrams) for _, _, texts in slices(batch, 1)]
            logs = np.concatenate([x for x, _ in done]) if done else np.zeros((0, len(names)))
            n = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int64)
            best = pa.array(np.array(names, object)[logs.argmax(axis=1)].tolist() if len(n) else [], pa.string(), mask=n == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, logs.size + 1, len(names), dtype=np.int32)), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(n), best, lists], names=[key, "_d", "_h", "_o", "_s", "_t", "n_trigrams", "text_lang", "_logs"])

    kind = given.schema[key].dataType.simpleString()
    seen = stored(given.mapInArrow(read, f"`{key}` {kind}, _d string, _h string, _o string, _s string, _t long, n_trigrams long, text_lang string, _logs array<double>"), "lid")
    told = seen.where("text_lang is not null")

    def table(*by: str) -> DataFrame:
        """For each value of ``by``: how many texts of each language, in the order of ``names``."""
        return told.where(" and ".join(f"{b} is not null" for b in by)).groupBy(*by).agg(F.array(*(F.count_if(F.col("text_lang") == x) for x in names)).alias("_n"))

    overall = told.agg(*(F.count_if(F.col("text_lang") == x).alias(f"c{i}") for i, x in enumerate(names))).first()
    total = sum(overall)
    base = [(c + 1) / (total + len(names)) for c in overall]
    spread = F.array(*map(F.lit, base))

    def prior(counts: Column, back: Column) -> Column:
        n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(counts.isNull(), back).otherwise(F.zip_with(counts, back, lambda c, p: _smoothed(c, n, p, weight)))

    out = seen
    for column, name, label in (("_d", declared, "_nd"), ("_s", suffix, "_ns"), ("_o", domain, "_no"), ("_h", host, "_nh")):
        if name is None:
            out = out.withColumn(label, F.lit(None).cast("array<bigint>"))
            continue
        # nulls match nothing; each gets one of many keys of its own so that they do not meet in one task
        apart = F.coalesce(F.concat(F.lit("="), column), F.concat(F.lit("?"), F.pmod(F.xxhash64("_logs"), F.lit(4096))))
        out = out.withColumn("_k", apart).join(table(column).select(F.concat(F.lit("="), column).alias("_k"), F.col("_n").alias(label)), "_k", "left").drop("_k")
    out = out.withColumn("_po", prior(F.col("_no"), spread)).withColumn("_ph", prior(F.col("_nh"), F.col("_po")))
    out = out.withColumn("_pd", prior(F.col("_nd"), spread)).withColumn("_ps", prior(F.col("_ns"), spread))
    # p(language | declared) / p(language) is p(declared | language) up to a constant; so for suffixes
    terms = [F.get("_logs", F.lit(i)) + F.log(F.get("_ph", F.lit(i))) + F.log(F.get("_pd", F.lit(i)) / F.lit(p)) + F.log(F.get("_ps", F.lit(i)) / F.lit(p)) for i, p in enumerate(base)]
    out = out.withColumn("_z", F.array(*terms)).withColumn("_top", F.array_max("_z"))
    mass = F.aggregate("_z", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("_top")))
    label = F.get(F.array(*map(F.lit, names)), (F.array_position("_z", F.col("_top")) - 1).cast("int"))
    out = out.withColumn("pred_lang", label).withColumn("posterior", F.lit(1.0) / mass)
    fine = (F.col("posterior") >= least) & (F.col("n_trigrams") > 0)
    if accept is not None:
        fine = fine & F.col("pred_lang").isin(*accept)
    return out.select(key, "n_trigrams", "text_lang", "pred_lang", "posterior", fine.alias("accepted"), F.col("_t").alias("text_hash"))

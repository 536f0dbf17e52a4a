"""Queries over the synthetic tables, one for each operator of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.language import identify_languages
from brindle.llm.language_model import score_texts
from brindle.llm.mixing import mix_sources
from brindle.llm.near_dedup import near_duplicates
from brindle.llm.neighbours import nearest
from brindle.llm.pieces import encode_documents
from brindle.llm.quality_model import quality_scores
from brindle.llm.quality_rules import quality_rules
from brindle.llm.secrets import scan_secrets
from brindle.llm.sharding import shard_rows

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model(path: str | None = None) -> bytes:
    """The bytes of a SentencePiece model file; executors get them with the task."""
    return Path(path or os.environ.get("BRINDLE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")).read_bytes()


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles at 0.8 over all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector among all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of all documents and the verdict of the learned list."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and checksums of the ids of all documents, and whether they decode to the text."""
    return encode_documents(table(spark, sf_dir, "documents"), piece_model(), with_ids=False)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the base model and the filter's pair model."""
    return score_texts(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and secrets of all documents, and a checksum of each redacted text."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), F.to_json("findings").alias("findings"),
        F.crc32(F.encode(F.coalesce("redacted", F.lit("")), "UTF-8")).alias("redacted_crc32"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents at weights 5, 2, 1 and 150 % of all words."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the source as host and the declared language as markup."""
    return identify_languages(table(spark, sf_dir, "documents"))


def lid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same evidence for web pages: tags give the declaration, addresses the host, domain and suffix."""
    html, host = F.col("html"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    bare = F.regexp_replace(html, "(?is)<(script|style|nav)\\b.*?</\\1>|<!--.*?-->|<[^>]*>", " ")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", bare.alias("text"), F.nullif(F.regexp_extract(html, "(?i)<html[^>]*\\blang=[\"']?([a-z]+)", 1), F.lit("")).alias("lang"),
        F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, "([^.]+\\.[^.]+)$", 1), F.lit("")).alias("domain"),
        F.nullif(F.regexp_extract(host, "\\.([^.]+)$", 1), F.lit("")).alias("suffix"),
    )
    return identify_languages(pages, key="page_id", host="host", domain="domain", suffix="suffix")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards in 5 regions of 2 racks."""
    return shard_rows(table(spark, sf_dir, "documents"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; a fifth of the labels is held out."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def neighbours_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op2_neighbours with scores as SQL can compare them."""
    return op2_neighbours(spark, sf_dir).withColumn("score", F.round("score", 6))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of op3_quality_rules that come before the learned list."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def shard_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9_sharding: sizes and shards, without the checksums and the slots."""
    return op9_sharding(spark, sf_dir).select("doc_id", "size", "law", "shard", "grown_shard")


def mixing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7_mixing: sizes, and how many words each source holds and may be taken of a document."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", (F.col("taken") <= 2 * F.col("size")).alias("within"))


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(_LOWERED)} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN list_transform(w, lambda x: [x]) ELSE list_transform(range(1, len(w)), lambda i: w[i:i + 1]) END) AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n FROM sets),
grams AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS inter FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * inter >= 80 * (na + nb - inter)),
ends AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM sized UNION SELECT b, root FROM reach JOIN ends ON a = node WHERE root < b)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM sized JOIN reach ON node = doc_id GROUP BY doc_id, n
"""

_NEIGHBOURS_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
ok AS MATERIALIZED (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_BASE_SQL = f"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM words),
windows AS MATERIALIZED (SELECT doc_id, i, hash(x || ' ' || y2 || ' ' || y3 || ' ' || y4 || ' ' || y5) AS g FROM (
  SELECT doc_id, i, n, x, lead(x, 1) OVER p AS y2, lead(x, 2) OVER p AS y3, lead(x, 3) OVER p AS y4, lead(x, 4) OVER p AS y5 FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)) WHERE i <= n - 4),
again AS (SELECT doc_id, g FROM windows GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows JOIN again USING (doc_id, g)) GROUP BY 1),
stats AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM words)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed FROM stats LEFT JOIN covered USING (doc_id)
"""

_SIZES_SQL = f"""
WITH s AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents)
SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size, true AS within FROM s
"""


def _draw_sql(name: str, weight: str) -> str:
    return f"-ln((CAST(CAST('0x' || substr(md5(k || '/' || {name}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / CAST(4503599627370496 AS DOUBLE)) / {weight}"


# five regions of two racks of four shards, and a sixth region of one shard
_SHARDS_SQL = f"""
WITH keys AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
regions AS (SELECT k, arg_min(i, {_draw_sql("'g' || i", "8.0")}) AS g FROM keys, range(5) r(i) GROUP BY k),
grown AS (SELECT k, arg_min(i, {_draw_sql("'g' || i", "CASE WHEN i < 5 THEN 8.0 ELSE 1.0 END")}) AS grown FROM keys, range(6) r(i) GROUP BY k),
racks AS (SELECT k, g, arg_min(j, {_draw_sql("'g' || g || 'r' || j", "4.0")}) AS r FROM regions, range(2) r(j) GROUP BY k, g),
places AS (SELECT k, arg_min(8 * g + 4 * r + t, {_draw_sql("'g' || g || 'r' || r || 's' || (8 * g + 4 * r + t)", "1.0")}) AS s FROM racks, range(4) r(t) GROUP BY k, g, r)
SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, 'key' AS law, CAST(s AS INTEGER) AS shard, CAST(CASE WHEN grown = 5 THEN 40 ELSE s END AS INTEGER) AS grown_shard
FROM documents JOIN places ON k = coalesce(CAST(doc_id AS VARCHAR), '') JOIN grown USING (k)
"""


def queries() -> dict[str, Query]:
    own = (op1_near_dedup, op2_neighbours, op3_quality_rules, op4_pieces, op5_language_model, op6_secret_scan, op7_mixing, op8_language_id, op9_sharding, op10_quality_model)
    return {q.__name__: q for q in (*own, lid_pages, neighbours_rounded, quality_base, mixing_sizes, shard_draws)}


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same: not for models, draws and checksums, whose queries are tested against plain Python."""
    return {"op1_near_dedup": _NEAR_SQL, "neighbours_rounded": _NEIGHBOURS_SQL, "quality_base": _BASE_SQL, "mixing_sizes": _SIZES_SQL, "shard_draws": _SHARDS_SQL}

"""Each query with SQL gives the rows that DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import index, rank
from brindle.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


@pytest.fixture(scope="module")
def odd_pages(spark, tmp_path_factory):
    """A folder of pages where a url is stored twice, one has no page and one page has no url, and pages link to each other."""
    link = lambda *to: "".join(f'<a href="{x}">x</a>' for x in to)
    rows = [(0, "http://h:80/a", link("/b", "/c")), (1, "http://h:80/a", link("/b")), (2, "http://h:80/b", link("/a")), (3, "http://h:80/c", None), (4, None, link("/a")), (5, "https://o:443/d", link("/x", "#"))]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def _same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    df, want = QUERIES[name](spark, folder), con.execute(ORACLE[name])
    assert _rows(df.columns, df.collect()) == _rows([c[0] for c in want.description], want.fetchall())


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(flat(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE[name])
    assert _rows(df.columns, df.collect()) == _rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_query_words_of_the_whole_text(spark, sf):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    long = [r for r in QUERIES["query_words"](spark, sf).collect() if len(text[r["doc_id"]] or "") > 2000]
    assert long and all(len(r["words"]) > 60 for r in long)


def test_whole_upsert_and_merge(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet").select("c_name")
    assert customers.join(QUERIES["kv_bulk_upsert"](spark, sf), customers["c_name"] == F.col("value"), "left_anti").isEmpty()
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("url")
    assert pages.join(QUERIES["harmonic_merge"](spark, sf), "url", "left_anti").isEmpty()


def test_posting_cap_is_the_operators(spark):
    postings = spark.range(rank.POSTING_CAP + 7).select(F.col("id").alias("doc_id"), F.lit("w").alias("term"), F.lit(1).alias("tf"))
    assert rank.capped(postings).count() == rank.POSTING_CAP and rank.capped(postings, 20).count() == 20


def test_each_stored_page_is_fetched_once(spark, odd_pages):
    _same_as_sql(spark, odd_pages, "fetch_pages")


def test_each_stored_page_is_ranked(spark, odd_pages):
    nodes = [r["node"] for r in QUERIES["pagerank_pages"](spark, odd_pages).collect()]
    assert sorted(nodes, key=str) == sorted([None, "http://h:80/a", "http://h:80/a", "http://h:80/b", "http://h:80/c", "https://o:443/d"], key=str)


def test_ranks_of_linked_pages_settle(spark, odd_pages):
    _same_as_sql(spark, odd_pages, "pagerank_pages")
    ranks = [(r["node"], r["rank"]) for r in QUERIES["pagerank_pages"](spark, odd_pages).collect()]
    assert len(ranks) == 6 and ranks.count((None, 0.15)) == 1
    a, b = dict(ranks)["http://h:80/a"], dict(ranks)["http://h:80/b"]
    # a links to b and c, and b back to a: r(a) = 0.15 + 0.85 r(b), r(b) = 0.15 + 0.425 r(a)
    assert abs(a - 0.2775 / 0.63875) < 0.03 and abs(b - 0.15 - 0.425 * a) < 0.01


def test_posting_cap_exchanges_postings_once(spark, sf):
    plan = QUERIES["posting_cap"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_frequent_terms_are_cut_before_the_exchange(spark):
    # "all" is in each document, "odd" in half of them, "few" in less than the cap
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.array(F.lit("all"), F.when(F.col("id") % 2 == 1, "odd").otherwise("all"), F.when(F.col("id") % 40 == 0, "few").otherwise("all")).alias("words"))
    postings = index.postings_present(docs, F.col("words"))
    got, plain = rank.capped(postings), rank.capped(postings, ahead=False)
    assert sorted(got.collect()) == sorted(plain.collect())
    assert {r["term"]: r["count"] for r in got.groupBy("term").count().collect()} == {"all": rank.POSTING_CAP, "odd": rank.POSTING_CAP, "few": 1000}
    reached = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti")
    assert reached(got) == 1 and reached(plain) == 0


def test_postings_present_of_documents_in_several_rows(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (1, ["a"]), (2, ["a"]), (3, []), (4, None)], "doc_id long, words array<string>")
    assert sorted(tuple(r) for r in index.postings_present(docs, F.col("words")).collect()) == [("a", 1), ("a", 2), ("b", 1)]


@pytest.mark.parametrize("mode", ["query", "v1", "v2"])
def test_tokens_are_the_words_of_the_cleaned_text(spark, mode):
    texts = ["", " ", None, "<b>A</b>b <i\nx> <c", "x\x0b\x0cy\r\n\tz\u00a0w\u0085v", "[a]-(b)_{c}&d<e>f\\\\g^h'i\"j", "\u039f\u0394\u039f\u03a3.\u0391 \u0130.I", "1-2 $3 %4 @5 a.b,c", "<<a>> > <"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    plain = F.filter(F.split(T.clean("text", mode), "\\s+"), lambda w: w != "")
    assert [r["w"] for r in df.select(T.tokens("text", mode).alias("w")).collect()] == [r["w"] for r in df.select(plain.alias("w")).collect()]

"""Crawl rounds, the index chain, jobs, the command line and keyed tables against plain Python."""

import collections
import re

from pyspark.sql import functions as F

from brindle import __main__ as cli
from brindle.functions import text as T
from brindle.functions import urls as U
from brindle.functions.stem import stem
from brindle.operators import graph, index, keyed, rank
from brindle.operators.bags import Bag, PairBag, python
from brindle.operators.crawl import crawl
from brindle.operators.keyed import KeyedTable, summary
from brindle.plans import jobs
from brindle.sources.tables import dictionary, fetched

WEB = {
    "http://a.example:80/": (200, "text/html", None, '<a href="/one">x</a> <a href="/two">x</a> <a href="/secret/x">x</a> <a href="http://b.example/">x</a>'),
    "http://a.example:80/one": (301, "text/html", "/two", None),
    "http://a.example:80/two": (200, "text/html", None, "same body"),
    "http://b.example:80/": (200, "text/html", None, "same body"),
    "http://c.example:80/": (200, "image/png", None, "bytes"),
}


def web(spark):
    rows = [(u, *x) for u, x in WEB.items()]
    pages = spark.createDataFrame(rows, "url string, response_code int, content_type string, location string, page string")

    def fetch(urls):
        return urls.join(pages, "url", "left").select("url", F.coalesce("response_code", F.lit(404)).alias("response_code"), "content_type", F.lit(None).cast("string").alias("content_length"), "location", "page")

    return fetch


def test_crawl_rounds(spark):
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /secret\n")], "host string, body string")
    seeds = spark.createDataFrame([("http://a.example/#top",), ("http://c.example",), (None,), ("nonsense",)], "url string")
    crawled, hosts = crawl(seeds, web(spark), robots, ["*/ignored"], max_rounds=8)
    got = {r["url"]: (r["response_code"], r["page"], r["canonical_url"]) for r in crawled.collect()}
    assert got == {
        "http://a.example:80/": (200, WEB["http://a.example:80/"][3], None), "http://c.example:80/": (200, None, None),
        "http://a.example:80/one": (301, None, None), "http://b.example:80/": (200, "same body", None),
        "http://a.example:80/two": (200, None, "http://b.example:80/"),
    }
    assert {r["host"]: r["last_access_ms"] for r in hosts.collect()} == {"a.example": 2000, "b.example": 1000, "c.example": 0}
    assert crawl(seeds.where("false"), web(spark), robots)[0].count() == 0


def test_crawl_delay_holds_a_host_back(spark):
    robots = spark.createDataFrame([("a.example", "User-agent: *\nCrawl-delay: 3\n")], "host string, body string")
    seeds = spark.createDataFrame([("http://a.example/one",), ("http://a.example/two",)], "url string")
    crawled, hosts = crawl(seeds, web(spark), robots, max_rounds=3)
    assert [r["url"] for r in crawled.collect()] == ["http://a.example:80/one"]
    crawled, hosts = crawl(seeds, web(spark), robots, max_rounds=4)
    assert crawled.count() == 2 and hosts.first()["last_access_ms"] == 3000


def test_index_pages_by_hand(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("url", F.col("html").alias("page"))
    documents, postings = index.index_pages(pages)
    ids = {r["url"]: r["doc_id"] for r in documents.collect()}
    want = collections.Counter()
    for r in pages.collect():
        text = re.sub("[\\x00-\\x1f\\x7f]", " ", re.sub("#", " ", re.sub("[^\\x00-\\x7f]", " ", T.plain_text(r["page"][:30000]))))
        text = re.sub("<.*?>", " ", text)
        for cls in (T.INDEX_PUNCTUATION, "\\[", "\\]"):
            text = re.sub(cls, " ", text)
        words = [w for w in text.lower().split() if re.match("[0-9A-Za-z$#%]", w) and w not in "#$%"][:1500]
        for w in words:
            want[w, ids[r["url"]]] += 1
            if stem(w) != w:
                want[stem(w), ids[r["url"]]] += 1
    assert {(r["term"], r["doc_id"]): r["tf"] for r in postings.collect()} == want
    more = pages.limit(3).withColumn("url", F.concat("url", F.lit("new")))
    both, _ = index.index_pages(more, documents)
    assert both.count() == len(ids) + 3 and both.agg(F.max("doc_id")).first()[0] == len(ids) + 3
    assert sorted(r["doc_id"] for r in index.index_pages(more, documents, mode="rebuild")[0].collect()) == [1, 2, 3]


def test_merge_all(spark):
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, url string, encoded_url string")
    tf = lambda *rows: spark.createDataFrame(rows, "term string, doc_id long, tf long")
    documents, postings = index.merge_all((docs((1, "a", "a"), (2, "b", "b")), tf(("x", 1, 1), ("y", 1, 2))), (docs((2, "c", "c"), (3, "d", "d")), tf(("x", 1, 9), ("z", 3, 1))))
    assert sorted(tuple(r) for r in documents.collect()) == [(1, "a", "a"), (2, "c", "c"), (3, "d", "d")]
    assert sorted(tuple(r) for r in postings.collect()) == [("x", 1, 9), ("y", 1, 2), ("z", 3, 1)]


def test_pagerank_of_pages(spark):
    pages = spark.createDataFrame([("http://a.x:80/p", '<a href="http://b.x/q">1</a><a href="http://b.x/q#f">2</a>'), ("http://b.x:80/q", '<a href="#">me</a><a href="http://a.x/p">1</a>'), ("http://c.x:80/", "")], "url string, page string")
    got = {r["node"]: r["rank"] for r in graph.pagerank_of_pages(pages, exact_iterations=2).collect()}
    a1, b1, c1 = 0.15 + 0.425, 0.15 + 0.85 + 0.425, 0.15
    assert {k: round(v, 9) for k, v in got.items()} == {"http://a.x:80/p": round(0.15 + 0.425 * b1, 9), "http://b.x:80/q": round(0.15 + 0.85 * a1 + 0.425 * b1, 9), "http://c.x:80/": c1}


def test_strict_links(spark):
    links = spark.createDataFrame([("http://a.x/d/e/f.html", x) for x in ("../g", "../../h", "./i", "k", "//c.x/l", "../../../m", "")], "url string, link string")
    got = {r["link"]: r["normal"] for r in U.normalise_links(links, strict=True).collect()}
    assert got == {"../g": "http://a.x:80/d/g", "../../h": "http://a.x:80/h", "./i": "http://a.x:80/d/e/i", "k": "http://a.x:80/d/e/k", "//c.x/l": "http://c.x:80/l", "../../../m": "http://a.x:80/m"}


def test_keyed_views(spark):
    t = KeyedTable(spark, "views_test")
    t.batch_put([("r2", "b", "1"), ("r1", "a", "2"), ("r1", "a", "3"), ("r3", "c", "4")])
    t.batch_put(spark.createDataFrame([("r2", "b", "5")], "row_key string, col string, value string"))
    assert t.page("r1", 2).columns == ["row_key", "a", "b"] and [tuple(r) for r in t.page("r1", 2).collect()] == [("r1", "3", None), ("r2", None, "5")]
    assert ("views_test", 3, True) in summary(spark)
    t.compact()
    assert t.log().count() == 3 and t.get("r2", "b") == "5" and t.count() == 3
    parts = [r["row_key"] for r in keyed.routed(t.cells(), 2).collect()]
    assert parts == sorted(parts)
    t.delete()


def test_command_line(spark, capsys, tmp_path):
    run = lambda *a: (cli.main(a, spark), capsys.readouterr().out.strip())
    assert run("put", "cli_test", "r", "c", "v") == (0, "OK") and run("put", "cli_test", "r", "d", "w", "c", "x") == (0, "FAIL")
    assert run("get", "cli_test", "r", "c") == (0, "v") and run("row", "cli_test", "r") == (0, "c=v") and run("scan", "cli_test") == (0, "r c=v")
    assert run("count", "cli_test") == (0, "1") and run("page", "cli_test") == (0, "r\tv") and "cli_test\t1\tpersistent" in run("tables")[1]
    assert run("rename", "cli_test", "cli_test2") == (0, "OK") and run("delete", "cli_test2") == (0, "OK") and run("nothing")[0] == 2
    (tmp_path / "t.txt").write_text("b a b")
    assert run("run", "word-count", str(tmp_path / "t.txt")) == (0, "b 2\na 1") and "word-count" in run("jobs")[1]


def test_jobs(spark):
    @jobs.job("silent")
    def silent(context, arguments):
        pass

    @jobs.job("loud")
    def loud(context, arguments):
        context.output(arguments[0])
        context.output(str(context.parallelize(["x", "y"]).count()))

    assert jobs.run_job(spark, "silent") == jobs.NO_OUTPUT and jobs.run_job(spark, "loud", ["n="]) == "n=2"


def test_python_callables(spark):
    bag = Bag.parallelize(spark, ["b a", "c", ""])
    assert sorted(bag.map(python(lambda v: v.upper() or None)).collect()) == ["B A", "C"]
    assert sorted(bag.flat_map(python(str.split)).collect()) == ["a", "b", "c"]
    pairs = bag.flat_map_to_pair(python(lambda v: [(w, v) for w in v.split()]))
    assert sorted(pairs.collect()) == [("a", "b a"), ("b", "b a"), ("c", "c")]
    assert sorted(pairs.flat_map(python(lambda k, v: [k] * len(v))).collect()) == ["a"] * 3 + ["b"] * 3 + ["c"]
    assert sorted(pairs.flat_map_to_pair(python(lambda k, v: [(v, k)])).collect()) == [("b a", "a"), ("b a", "b"), ("c", "c")]
    assert sorted(bag.group_by(python(lambda v: str(len(v)))).collect()) == [("0", ""), ("1", "c"), ("3", "b a")]
    assert sorted(Bag.from_table(spark.createDataFrame([(1, "x"), (2, None)], "i int, s string"), lambda r: r["s"]).collect()) == ["x"]
    many = PairBag(spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")))
    assert sorted(many.fold_by_key("0", python(lambda a, b: str(int(a) + int(b)))).collect()) == [(str(i), str(sum(range(i, 100, 3)))) for i in range(3)]


def test_sources(spark, tmp_path):
    assert dictionary(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "words").write_text("Apple\n\npear\napple\n")
    assert sorted(r["word"] for r in dictionary(spark, str(tmp_path / "words")).collect()) == ["apple", "pear"]
    got = fetched(spark.createDataFrame([("u",)], "url string"), fetch=lambda u: (200, "text/html", u * 2)).first()
    assert tuple(got) == ("u", 200, "text/html", "uu")


def test_pages_of_results_and_order_of_merges(spark):
    found = spark.range(25).select(F.col("id").alias("doc_id"), (F.col("id") % 5).cast("double").alias("score"))
    assert [r["doc_id"] for r in rank.page_of(found, 20).collect()] == [0, 5, 10, 15, 20]
    scores = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 1.0)], "url string, score double")
    assert [r["url"] for r in rank.merged_in_order(scores, scores.where("url <> 'c'").withColumnRenamed("score", "rank")).collect()] == ["a", "b"]

"""Micro fixtures for the operators of the retrieval engine."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions import urls as U
from brindle.functions.stem import stem
from brindle.operators import graph, index, keyed, phrase, rank
from brindle.operators.bags import Bag, PairBag
from brindle.sources.tables import dense_ids


def pairs(spark, *rows):
    return PairBag(spark.createDataFrame(list(rows), "k string, v string"))


def test_cogroup(spark):
    a = pairs(spark, ("fruit", "apple"), ("fruit", "banana"), ("x", "1"))
    b = pairs(spark, ("fruit", "cherry"), ("fruit", "date"), ("fruit", "fig"), ("y", "2"))
    assert dict(a.cogroup(b).collect()) == {"fruit": "[apple,banana],[cherry,date,fig]", "x": "[1],[]", "y": "[],[2]"}


def test_join_and_folds(spark):
    joined = pairs(spark, ("k", "a1"), ("k", "a2"), ("n", "z")).join(pairs(spark, ("k", "b1")))
    assert sorted(joined.collect()) == [("k", "a1,b1"), ("k", "a2,b1")]
    assert Bag.parallelize(spark, []).fold("0", lambda v: F.sum(v.cast("long"))).first()[0] == "0"
    assert Bag.parallelize(spark, ["1", "2", "4"]).fold_python("0", lambda a, b: str(int(a) + int(b))) == "7"


def test_bags(spark):
    bag = Bag.parallelize(spark, ["a", "a", "b"])
    assert bag.intersection(Bag.parallelize(spark, ["a", "c", "a"])).collect() == ["a"]
    grouped = Bag.parallelize(spark, ["apple", "avocado", "banana"]).group_by(lambda v: F.substring(v, 1, 1))
    assert dict(grouped.collect()) == {"a": "apple,avocado", "b": "banana"}
    assert bag.flat_map(lambda v: F.when(v == "b", F.array(v))).collect() == ["b"]
    assert bag.count() == 3 and len(bag.take(2)) == 2 and sorted(bag.distinct().collect()) == ["a", "b"]
    assert bag.map_partitions(lambda values: (v + "!" for v in values)).filter(lambda v: v == "a!").count() == 2


@pytest.mark.parametrize(
    ("word", "expected"),
    list(zip("caresses ponies ties cats feed agreed disabled matting mating meetings is".split(), "caress poni ti cat feed agre disabl mat mate meet is".split())),
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_cleaning(spark):
    text = spark.createDataFrame([("zip 19104, $5 50% a-b c+d=e [x] run-ning",)], "t string")
    get = lambda c: text.select(c).first()[0]
    assert get(T.tokens("t", "v2")) == "zip $ a b c d e x run ning".split()
    assert get(T.index_tokens("t", "v2")) == "zip a b c d e x run ning".split()
    assert get(T.tokens("t", "query")) == "zip 19104 $5 50% a b c+d=e [x] run ning".split()
    assert get(T.query_tokens("t")) == "zip 19104 $5 50% b c+d=e [x] run ning".split()
    assert T.plain_text("<p>a &amp; <b>b</b>c</p><script>x</script><br>d") == "a & bc d"


def test_addresses(spark):
    rows = ["http://h:8080/a/b?q=1#f", "https://h", "x/y", "//h/x"]
    df = spark.createDataFrame([(r,) for r in rows], "u string")
    got = df.select(*(c.alias(n) for n, c in U.url_parts(F.col("u")).items())).collect()
    assert [tuple(r) for r in got] == [("http", "h", "8080", "/a/b?q=1#f"), ("https", "h", None, "/"), (None, None, None, "x/y"), (None, None, None, "//h/x")]


def test_links(spark):
    html = '<a href="x">1</a><A class=c href="/y#z">2</A><abbr href="no"></a>'
    assert spark.createDataFrame([(html,)], "h string").select(U.extract_links(F.col("h"))).first()[0] == ["x", "/y#z"]
    base = "http://h:80/a/b/c.html"
    cases = {"d.html": "http://h:80/a/b/d.html", "/r": "http://h:80/r", "../x": "http://h:80/a//x", "#f": None, "mailto://m": None, "mailto:m": "http://h:80/a/b/mailto:m", "p.PNG": None, "https://o/z": "https://o:443/z"}
    df = spark.createDataFrame([(k, base) for k in cases], "link string, url string")
    got = {r["link"]: r["normal"] for r in U.normalise_links(df).collect()}
    assert got == {k: v for k, v in cases.items() if v}
    assert {r["link"]: r["normal"] for r in U.normalise_links(df, self_on_empty=True).collect()}["#f"] == base


def test_robots(spark):
    body = "User-agent: *\nCrawl-delay: 3\nAllow: /a/b\nDisallow: /a\n\nUser-agent: other\nDisallow: /z\n"
    df = spark.createDataFrame([(body, p) for p in ("/a/b/c", "/a/x", "/z")], "body string, path string").withColumn("r", U.robots_rules(F.col("body")))
    assert [r[0] for r in df.select(U.robots_allow(F.col("r.rules"), F.col("path"))).collect()] == [True, False, True]
    assert df.select("r.delay").first()[0] == 3.0


def test_pagerank(spark):
    def ranks(nodes, edges):
        n, e = spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string")
        return {r["node"]: round(r["rank"], 9) for r in graph.pagerank(n, e, exact_iterations=1).collect()}

    assert ranks("ABC", [("A", "B"), ("B", "A"), ("C", "A"), ("C", "A")]) == {"A": 1.85, "B": 1.0, "C": 0.15}
    assert ranks("AB", [("A", "B"), ("A", "nowhere")]) == {"A": 0.15, "B": 0.575}


def test_boosts(spark):
    postings = spark.createDataFrame([("u", 1, 1), ("w", 1, 10)], "term string, doc_id long, tf long")
    docs = spark.createDataFrame([(1, "http://u/")], "doc_id long, url string")
    score = lambda words: rank.search(postings, docs, words, n_docs=10, stems=False).first()["score"]
    assert score(["u", "w"]) == pytest.approx((0 + 1) * 50 + 2)
    assert score(["w", "u"]) == pytest.approx((2 + 1) * 50)


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "a b x b c"), (2, "a b c"), (3, "c b a")], "doc_id long, text string")
    pos = index.postings_positional(docs, T.tokens("text"))
    assert sorted(r[0] for r in phrase.phrase_pairwise(pos, ["a", "b", "c"]).collect()) == [1, 2]
    assert [r[0] for r in phrase.phrase_exact(pos, ["a", "b", "c"]).collect()] == [2]
    assert phrase.phrase_pairwise(pos, ["a", "nope"]).isEmpty()


def test_merge_and_stems(spark):
    schema = "term string, doc_id long, tf long"
    a, b = spark.createDataFrame([("t", 1, 5), ("t", 2, 1)], schema), spark.createDataFrame([("t", 1, 9), ("u", 3, 2)], schema)
    assert sorted(map(tuple, index.merge_indexes(a, b).collect())) == [("t", 1, 9), ("t", 2, 1), ("u", 3, 2)]
    docs = spark.createDataFrame([(1, "run running")], "doc_id long, text string")
    assert {r["term"]: r["tf"] for r in index.postings_count(docs, T.tokens("text"), stems=True).collect()} == {"run": 2, "running": 1}


def test_keyed(spark):
    log = spark.createDataFrame([("r", "c", "1", 1), ("r", "c", "2", 2), ("r", "d", "9", 1)], keyed.CELLS)
    assert keyed.rows(keyed.latest(log)).first()["cells"] == {"c": "2", "d": "9"}
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "row_key string")
    assert [r[0] for r in keyed.scan(keys, "a", "c").collect()] == ["a", "b"]


def test_keyed_table(spark):
    t = keyed.KeyedTable(spark, "cells_a")
    t.persist()
    assert t.put("r", "c", "1") and not t.put("r", "c", "2", "c", "other") and t.put("r", "c", "3", "c", "1")
    t.put_row("q", {"x": "1", "y": "2"})
    assert t.get("r", "c") == "3" and t.get_row("q") == {"x": "1", "y": "2"} and t.get_row("none") is None
    assert t.count() == 2 and t.exists_row("q") and not t.exists_row("z")
    t.compact()
    t.rename("cells_b")
    assert t.log().count() == 3 and t.get("r", "c") == "3"
    with pytest.raises(LookupError):
        keyed.KeyedTable(spark, "cells_a").delete()
    t.delete()


def test_completion_and_zips(spark):
    words = spark.createDataFrame([(w,) for w in ("car", "card", "cat", "dog")], "word string")
    assert [r[0] for r in phrase.autocomplete(words, "my ca").collect()] == ["car", "card", "cat"]
    assert phrase.autocomplete(words, "c4").isEmpty() and phrase.autocomplete(words, "x ").count() == 4
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate(["00500", "00501", "19104", "99951", "1910a", "19104"])], "doc_id long, pos int, term string")
    assert index.zip_table(tokens).first()["zipcode"] == "00501,19104,19104"


def test_dense_ids(spark):
    df = spark.range(0, 500).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    rows = dense_ids(df, ["k"], "n", base=10).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: r["k"])] == list(range(11, 511))


def test_stream(spark, tmp_path):
    from brindle.streaming.indexing import current_postings, index_stream

    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    run = lambda: index_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(1, "c")], docs.schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = current_postings(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert sorted(map(tuple, got)) == [("b", 2, 1), ("c", 1, 1)]


def test_links_are_dealt_once(spark):
    rows = [("hub", f"n{i}") for i in range(50)] * 2 + [("a", "hub"), ("a", None), (None, "a")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    got = graph.adjacency(edges, most=10).collect()
    assert sorted((r["src"], r["degree"], x) for r in got for x in r["dsts"]) == sorted([("hub", 50, f"n{i}") for i in range(50)] + [("a", 1, "hub")])
    assert len(got) > 3 and max(len(r["dsts"]) for r in got) < 50
    # a join of the kept rows by source moves the ranks only
    links = graph.dealt(graph.adjacency(edges), most=5)
    ranks = spark.range(10).select(F.col("id").cast("string").alias("node"))
    plan = links.hint("merge").join(ranks, links["src"] == ranks["node"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(node") == 1 and plan.count("ENSURE_REQUIREMENTS") == 1
    links.unpersist()
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(None, edges, exact_iterations=1).collect()}
    assert len(ranks) == 52 and ranks["hub"] == 1.0 and ranks["a"] == 0.15 and ranks["n7"] == pytest.approx(0.15 + 0.85 / 50)


def test_counts_stay_in_their_row(spark):
    docs = spark.createDataFrame([(1, "run b run"), (2, "runs running b"), (3, None), (4, " "), (5, "é")], "doc_id long, text string")
    count = lambda d, stems=True: index.postings_count(d, T.tokens("text"), stems)
    want = {("run", 1, 2), ("b", 1, 1), ("runs", 2, 1), ("running", 2, 1), ("run", 2, 2), ("b", 2, 1), ("é", 5, 1)}
    assert sorted(map(tuple, count(docs).collect())) == sorted(want)
    assert "Exchange" not in count(docs)._jdf.queryExecution().executedPlan().toString()
    # a document of several rows is put together
    split = spark.createDataFrame([(1, "run b"), (1, "run"), (2, "runs running b"), (5, "é")], docs.schema)
    assert sorted(map(tuple, count(split).collect())) == sorted(want)
    assert {r["term"]: r["tf"] for r in count(split, False).where("doc_id = 1").collect()} == {"run": 2, "b": 1}


def test_positions_stay_in_their_row(spark):
    docs = spark.createDataFrame([(1, "run b run"), (2, "runs b running"), (3, None), (4, "")], "doc_id long, text string")
    found = lambda d, stems=True: index.postings_positional(d, T.tokens("text"), stems)
    rows = sorted((*r[:3], list(r["positions"])) for r in found(docs).collect())
    assert rows == sorted([("run", 1, 2, [1, 3]), ("b", 1, 1, [2]), ("runs", 2, 1, [1]), ("running", 2, 1, [3]), ("run", 2, 2, [1, 3]), ("b", 2, 1, [2])])
    assert "Exchange" not in found(docs)._jdf.queryExecution().executedPlan().toString()
    # the places of a document's rows come together
    split = spark.createDataFrame([(1, "run b"), (1, "run")], docs.schema)
    assert sorted((*r[:3], list(r["positions"])) for r in found(split, False).collect()) == [("b", 1, 1, [2]), ("run", 1, 2, [1, 1])]


def test_merge_sorts_by_document_first(spark):
    schema = "term string, doc_id long, tf long"
    a, b = spark.createDataFrame([("t", 1, 5), ("t", 2, 1), ("v", 1, 4)], schema), spark.createDataFrame([("t", 1, 9), ("u", 3, 2)], schema)
    merged = index.merge_indexes(a, b, accumulate=True)
    assert merged.columns == ["term", "doc_id", "tf"] and sorted(map(tuple, merged.collect())) == [("t", 1, 14), ("t", 2, 1), ("u", 3, 2), ("v", 1, 4)]
    assert "Sort [doc_id" in index.merge_indexes(a.hint("merge"), b)._jdf.queryExecution().executedPlan().toString()

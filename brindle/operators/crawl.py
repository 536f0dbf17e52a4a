"""Crawling in rounds over tables: what is fetched, what is kept of it, and what is asked for next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import urls as U
from brindle.functions.text import hash_key
from brindle.sources.tables import ensure_checkpoints

# Fixed values of the crawl protocol.
REDIRECTS = (301, 302, 303, 307, 308)
PAGE_TYPE = "text/html"
DELAY_MS = 1000

CRAWL = "url_hash string, url string, content_type string, content_length string, response_code int, page string, canonical_url string"
HOSTS = "host string, last_access_ms long"


def whole_url(url: Column) -> Column:
    """scheme://host:port/path without a fragment; the port is that of the scheme where there is none."""
    part = U.url_parts(url)
    port = F.coalesce(part["port"], F.when(F.lower(part["scheme"]) == "http", "80").otherwise("443"))
    return F.concat(part["scheme"], F.lit("://"), part["host"], F.lit(":"), port, F.regexp_replace(part["path"], "(?s)#.*$", ""))


def due(queue: DataFrame, crawled: DataFrame, hosts: DataFrame, robots: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Of ``queue(url)`` what may be fetched now, and what has to wait: (url, host, rules) and (url).

    Urls that were crawled before drop out. A host whose last access is less than its crawl delay ago waits, and
    of the others one url, the least, is fetched in a round. ``robots(host, body)`` gives delays and rules.
    """
    asked = queue.where("url is not null").select(whole_url(F.col("url")).alias("url")).where("url is not null").distinct()
    asked = asked.join(crawled.select("url"), "url", "left_anti").withColumn("host", U.url_parts(F.col("url"))["host"])
    rules = robots.select("host", U.robots_rules(F.col("body")).alias("robots"))
    asked = asked.join(rules, "host", "left").join(hosts.select("host", "last_access_ms"), "host", "left")
    wait = F.coalesce(F.col("robots.delay") * 1000, F.lit(DELAY_MS))
    ready = F.col("last_access_ms").isNull() | (F.lit(now_ms) - F.col("last_access_ms") >= wait)
    turn = asked.where(ready).groupBy("host").agg(F.min_by(F.struct("url", "robots"), "url").alias("x")).select("host", "x.url", "x.robots.rules")
    return turn, asked.join(turn.select("url"), "url", "left_anti").select("url")


def kept(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the crawl table from ``answers(url, response_code, content_type, content_length, page)``.

    Only pages of type text/html that came with code 200 are kept. A body that is among ``known(body_hash, url)``,
    or came from a smaller url in the same round, is replaced by that url as ``canonical_url``.
    """
    page = F.when((F.col("response_code") == 200) & (F.col("content_type") == PAGE_TYPE), F.col("page"))
    found = answers.withColumn("page", page).withColumn("body_hash", hash_key(F.col("page")))
    before = known.groupBy("body_hash").agg(F.min("url").alias("before"))
    least = found.where("page is not null").groupBy("body_hash").agg(F.min("url").alias("least"))
    out = found.join(least, "body_hash", "left").join(before, "body_hash", "left")
    canonical = F.when(F.col("page").isNotNull(), F.nullif(F.coalesce("before", "least"), F.col("url")))
    return out.withColumn("canonical_url", canonical).select(
        hash_key(F.col("url")).alias("url_hash"), "url", "content_type", "content_length", "response_code",
        F.when(canonical.isNull(), F.col("page")).alias("page"), "canonical_url",
    )


def asked_next(rows: DataFrame, answers: DataFrame, turn: DataFrame, blacklist: list[str]) -> DataFrame:
    """(url) of links of pages that were kept, and of redirects, that the host's robots rules and the blacklist allow."""
    links = rows.where("page is not null").select("url", F.explode(U.extract_links(F.col("page"))).alias("link"))
    moved = answers.where(F.col("response_code").isin(*REDIRECTS)).select("url", F.col("location").alias("link"))
    found = U.normalise_links(links.unionByName(moved).where("link is not null"))
    allowed = found.join(turn.select("url", "rules"), "url", "left").where(U.robots_allow(F.col("rules"), U.url_parts(F.col("normal"))["path"]))
    return U.without_blacklisted(allowed.select(F.col("normal").alias("url")), blacklist, "url").distinct()


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], robots: DataFrame, blacklist: list[str] | None = None, max_rounds: int = 10, round_ms: int = DELAY_MS, start_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """The crawl table and the hosts' last access after rounds from ``seeds(url)``.

    ``fetch`` maps ``(url)`` to (url, response_code, content_type, content_length, location, page). The clock moves by
    ``round_ms`` a round. Each round's rows are kept apart and only joined to, never written again. Empty seeds
    give empty tables. A url without a host is never fetched.
    """
    spark = seeds.sparkSession
    ensure_checkpoints(spark)
    crawled, hosts, known = (spark.createDataFrame([], s) for s in (CRAWL, HOSTS, "body_hash string, url string"))
    queue = seeds.select("url")
    for turn_no in range(max_rounds):
        now = start_ms + turn_no * round_ms
        turn, waiting = due(queue, crawled, hosts, robots, now)
        turn = turn.where("host is not null").checkpoint()
        waiting = waiting.checkpoint()
        if turn.isEmpty() and waiting.isEmpty():
            break
        answers = fetch(turn.select("url")).checkpoint()
        rows = kept(answers, known).checkpoint()
        queue = waiting.unionByName(asked_next(rows, answers, turn, blacklist or [])).checkpoint()
        crawled = crawled.unionByName(rows)
        known = known.unionByName(rows.where("page is not null").select(hash_key(F.col("page")).alias("body_hash"), "url"))
        hosts = hosts.unionByName(turn.select("host", F.lit(now).cast("long").alias("last_access_ms"))).groupBy("host").agg(F.max("last_access_ms").alias("last_access_ms")).checkpoint()
    return crawled, hosts

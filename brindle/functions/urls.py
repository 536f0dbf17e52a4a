"""Addresses and links as column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Files that are not followed, and what counts as an opening tag.
SKIPPED_FILES = "\\.(?:jpg|jpeg|gif|png|txt)$"
OPENING_TAG = "<(?!/)[^>]*>"


_URL = "(?s)^(?!//)(.*?).//([^/][^/:]*|)(?::([^/]*))?(/.*)?$"
_IS_URL = "(?s)^(?!//).+?//"


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, host, port and path; a text without ``//`` after its first character is all path."""
    whole = url.rlike(_IS_URL)
    part = lambda n: F.when(whole, F.nullif(F.regexp_extract(url, _URL, n), F.lit("")))
    path = F.when(whole, F.coalesce(F.nullif(F.regexp_extract(url, _URL, 4), F.lit("")), F.lit("/"))).otherwise(url)
    return {"scheme": part(1), "host": part(2), "port": part(3), "path": path}


def extract_links(html: Column) -> Column:
    """Targets of the anchors of a page, in order: the first attribute that begins with href, less its quotes."""
    bodies = F.transform(F.regexp_extract_all(html, F.lit(OPENING_TAG), F.lit(0)), lambda t: F.split(F.substring(t, F.lit(2), F.length(t) - 2), " "))
    anchors = F.filter(bodies, lambda b: F.lower(F.get(b, F.lit(0))) == "a")
    hrefs = F.transform(anchors, lambda b: F.get(F.filter(F.slice(b, F.lit(2), F.greatest(F.size(b), F.lit(1))), lambda x: F.startswith(F.lower(x), F.lit("href"))), F.lit(0)))
    values = F.transform(F.filter(hrefs, lambda h: h.isNotNull()), lambda h: F.substring(h, F.instr(h, "=") + 1, F.length(h)))
    return F.transform(F.filter(values, lambda v: F.length(v) >= 2), lambda v: F.substring(v, F.lit(2), F.length(v) - 2))


def normalise_links(links: DataFrame, link: str = "link", base: str = "url", out: str = "normal", self_on_empty: bool = False, strict: bool = False) -> DataFrame:
    """Add ``out``: each link of the page ``base`` as scheme://host:port/path; skipped links drop out.

    Empty links and ``/`` are skipped, or with ``self_on_empty`` give the base. Text such as
    ``mailto:x`` has no ``//`` and counts as a relative path. The steps are columns of their own, so that no
    expression is worked out twice.

    By default one ``..`` at the start of a link goes up one folder and no more. With ``strict`` links are resolved as
    RFC 3986 has it, with any number of ``.`` and ``..``.
    """
    b, df = url_parts(F.col(base)), links
    scheme_port = lambda s: F.when(F.lower(s) == "http", "80").otherwise("443")
    df = df.withColumns({f"_b{k}": v for k, v in b.items()}).withColumn("_bare", F.regexp_replace(link, "(?s)#.*$", ""))
    df = df.withColumns({f"_u{k}": v for k, v in url_parts(F.col("_bare")).items()})
    df = df.withColumn("_bpath", F.regexp_replace("_bpath", "(?s)#.*$", "")).withColumn("_bport", F.coalesce("_bport", scheme_port(F.col("_bscheme"))))
    # the folder of the page; a page directly below the root counts as a folder itself
    df = df.withColumn("_dir", F.when(F.col("_bpath").rlike("(?s)^.+/[^/]*$"), F.regexp_replace("_bpath", "/[^/]*$", "")).otherwise(F.col("_bpath")))
    up = F.col("_upath").rlike("^\\.\\.")
    df = df.withColumn("_dir", F.when(up & F.col("_dir").rlike("/"), F.regexp_replace("_dir", "/[^/]*$", "")).otherwise(F.col("_dir")))
    df = df.withColumn("_dir", F.when(F.col("_dir").rlike("/$"), F.col("_dir")).otherwise(F.concat("_dir", F.lit("/"))))
    if strict:
        df = df.withColumn("_strict", resolved(F.concat("_bscheme", F.lit("://"), "_bhost", F.lit(":"), "_bport", "_bpath"), F.col("_bare")))
        df = df.withColumns({f"_s{k}": v for k, v in url_parts(F.col("_strict")).items()})
    rest = F.when(up & ~F.contains("_upath", F.lit("/")), F.lit(None)).when(up, F.regexp_replace("_upath", "^[^/]*", "")).otherwise(F.col("_upath"))
    df = df.withColumn("_path", F.when(F.col("_upath").rlike("^/"), F.col("_upath")).otherwise(F.concat("_dir", rest)))
    scheme = F.coalesce("_uscheme", "_bscheme")
    made = F.concat(scheme, F.lit("://"), F.coalesce("_uhost", "_bhost"), F.lit(":"), F.coalesce("_uport", scheme_port(scheme)), F.col("_path"))
    if strict:
        made = F.concat("_sscheme", F.lit("://"), "_shost", F.lit(":"), F.coalesce("_sport", scheme_port(F.col("_sscheme"))), F.col("_spath"))
    mine = F.concat("_bscheme", F.lit("://"), "_bhost", F.lit(":"), "_bport", "_bpath") if self_on_empty else F.lit(None).cast("string")
    skipped = (F.col("_uscheme").isNotNull() & ~F.lower("_uscheme").isin("http", "https")) | F.lower("_bare").rlike(SKIPPED_FILES)
    df = df.withColumn("_out", F.when(F.col("_bare").isin("", "/"), mine).when(~skipped, made))
    # an explode, as a filter on the column would be pushed down and repeat all the steps
    return df.select(*links.columns, F.explode(F.array_compact(F.array("_out"))).alias(out))


@F.pandas_udf(StringType())
def resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    """Links resolved against their pages; those that cannot be are null."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            return None if b is None or x is None else urljoin(b, x)
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


def without_blacklisted(links: DataFrame, patterns: list[str], column: str = "link") -> DataFrame:
    """Drop links that one of the patterns matches as a whole; ``*`` stands for any text."""
    if not patterns:
        return links
    import re

    whole = "|".join("(?:" + ".*".join(re.escape(p) for p in pattern.split("*")) + ")" for pattern in patterns)
    return links.where(~F.coalesce(F.col(column).rlike(f"^(?:{whole})$"), F.lit(False)))


def parse_robots(body: str | None, agent: str = "brindle") -> tuple[float | None, list[tuple[str, bool]]]:
    """(delay, [(prefix, allowed)]) for ``*`` and for our agent; a block for our agent ends the reading."""
    delay, rules = None, []
    for block in (body or "").replace("\r", "").split("\n\n"):
        names, own = [], []
        for line in block.split("\n"):
            head, _, value = line.partition(": ")
            if head == "User-agent":
                names.append(value)
            elif head in ("Allow", "Disallow"):
                own.append((value, head == "Allow"))
            elif head == "Crawl-delay" and ("*" in names or agent.lower() in map(str.lower, names)):
                try:
                    delay = float(value)
                except ValueError:
                    pass
        exact = agent.lower() in map(str.lower, names)
        if exact or "*" in names:
            rules += own
        if exact:
            break
    return delay, rules


ROBOTS = "struct<delay:double,rules:array<struct<prefix:string,allow:boolean>>>"


def robots_rules(body: Column, agent: str = "brindle") -> Column:
    @F.pandas_udf(ROBOTS)
    def parsed(bodies: pd.Series) -> pd.DataFrame:
        both = [parse_robots(b, agent) for b in bodies]
        return pd.DataFrame({"delay": [d for d, _ in both], "rules": [[{"prefix": p, "allow": a} for p, a in r] for _, r in both]})

    return parsed(body)


def robots_allow(rules: Column, path: Column) -> Column:
    """The first rule whose prefix begins the path decides; without one the path is allowed."""
    return F.coalesce(F.get(F.filter(rules, lambda r: F.startswith(path, r["prefix"])), F.lit(0))["allow"], F.lit(True))


def encoded(url: Column) -> Column:
    return F.url_encode(url)


def decoded(url: Column) -> Column:
    return F.try_url_decode(url)

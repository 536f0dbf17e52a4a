"""Cleaning and tokenising of page text as column expressions."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stop words of queries and the character classes that define the vocabularies.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were",
    "will", "with",
)
TAG = "<.*?>"
QUERY_PUNCTUATION = "[.,:;!?'\"()-]"
INDEX_PUNCTUATION = "[.,:;!?'\"()%-@#&*^`<>(){}]"
SIGNS = {"query": QUERY_PUNCTUATION[1:-1], "v1": QUERY_PUNCTUATION[1:-1], "v2": INDEX_PUNCTUATION[1:-1] + "\\[\\]"}
FIRST_ZIP, LAST_ZIP = "00501", "99950"
PAGE_LIMIT, WORD_LIMIT = 30_000, 1_500


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(text: Column | str, mode: str = "query") -> Column:
    """Strip tags and punctuation and lower. ``query`` and ``v1`` keep digits; ``v2`` strips them and more."""
    out = F.regexp_replace(_col(text), TAG, " ")
    if mode == "v2":
        out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, INDEX_PUNCTUATION, " "), "\\[", " "), "\\]", " ")
    elif mode in ("query", "v1"):
        out = F.regexp_replace(out, QUERY_PUNCTUATION, " ")
    else:
        raise ValueError(f"no such mode: {mode}")
    return F.lower(F.regexp_replace(out, "[\r\n\t]", " "))


def tokens(text: Column | str, mode: str = "query") -> Column:
    """The words of the cleaned text. Signs and white space other than spaces go in one pass, as only words are asked for."""
    if mode not in SIGNS:
        raise ValueError(f"no such mode: {mode}")
    out = F.regexp_replace(F.regexp_replace(_col(text), TAG, " "), f"[\\t\\n\\x0B\\f\\r{SIGNS[mode]}]", " ")
    return F.array_remove(F.split(F.lower(out), " "), "")


def cut_page(html: Column | str, most: int = PAGE_LIMIT) -> Column:
    """The first characters of a page, cut before it is parsed."""
    return F.left(_col(html), F.lit(most))


def hash_key(text: Column | str) -> Column:
    """The key under which an address or a body is stored."""
    return F.sha1(_col(text))


def scrub(text: Column | str) -> Column:
    """Non-ASCII, number signs and control characters become spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(text), "[^\\x00-\\x7F]", " "), "#", " "), "\\p{Cc}", " ")


def valid_word(word: Column) -> Column:
    """Begins with a digit, a letter, ``$``, ``#`` or ``%`` and is not one of these signs alone."""
    return word.rlike("^[\\p{IsDigit}\\p{IsAlphabetic}$#%]") & ~word.isin("#", "$", "%")


def index_tokens(text: Column | str, mode: str = "v2", limit: int | None = WORD_LIMIT) -> Column:
    """The first ``limit`` valid words; cut before any row is exploded."""
    words = F.filter(tokens(text, mode), valid_word)
    return words if limit is None else F.slice(words, 1, limit)


def page_words(html: Column | str, page_limit: int = PAGE_LIMIT, word_limit: int = WORD_LIMIT) -> Column:
    """The words of a page that are indexed: cut, visible text, ASCII only, cleaned, valid, the first of them."""
    return index_tokens(scrub(html_text(cut_page(html, page_limit))), "v2", word_limit)


def query_tokens(text: str | Column) -> Column:
    return F.filter(tokens(text, "query"), lambda w: ~w.isin(*STOP_WORDS))


def split_query(text: str, stop_words: bool = True) -> list[str]:
    """The same for a query on the driver."""
    import re

    text = re.sub(QUERY_PUNCTUATION, " ", re.sub(TAG, " ", text)).lower()
    return [w for w in text.split() if not (stop_words and w in STOP_WORDS)]


def is_zip(word: Column) -> Column:
    return word.rlike("^[0-9]{5}$") & word.between(FIRST_ZIP, LAST_ZIP)


_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td th thead title tr ul".split())
_HIDDEN = frozenset(("script", "style", "noscript", "template"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        if tag in _BLOCKS:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in _HIDDEN))
        if tag in _BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def plain_text(html: str | None) -> str | None:
    """Visible text with entities decoded, a space at block tags, and white space put together."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join("".join(parser.parts).split())


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(plain_text)

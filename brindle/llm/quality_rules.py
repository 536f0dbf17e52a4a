"""Quality rules: text statistics and a learned decision list, in SQL functions only.

The list is learned by sequential covering. Each rule is a conjunction of
thresholds on text statistics that picks out low-quality texts: it is grown on
one part of the labelled rows, pruned on another, and the rows it covers are set
aside before the next is grown. The list is applied as one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm._store import drawn, stored

GAP = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
FEATURES = ("symbol_rate", "bang_rate", "upper_rate", "digit_rate", "repeat_rate", "dup_line_rate", "distinct_rate", "word_length")


def text_stats(docs: DataFrame, window: int = 5) -> DataFrame:
    """Add to ``docs(doc_id, text)`` the statistics of each whole text; null text has none of anything."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    out = out.withColumn("_w", F.filter(F.split("_t", f"{GAP}+"), lambda w: w != ""))
    out = out.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    out = out.withColumn("_lines", lines)
    out = out.withColumn("n_words", F.size("_h").cast("long"))
    counted = {
        "word_chars": F.char_length(F.regexp_replace("_t", f"{GAP}+", "")),
        "n_symbols": F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", "")),
        "n_bangs": F.char_length("_t") - F.char_length(F.translate("_t", "!?", "")),
        "n_upper": F.char_length("_t") - F.char_length(F.regexp_replace("_t", "\\p{Lu}+", "")),
        "n_digits": F.char_length("_t") - F.char_length(F.translate("_t", "0123456789", "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_distinct": F.size(F.array_distinct("_h")),
    }
    out = out.select("doc_id", "n_words", "_h", *(c.cast("long").alias(n) for n, c in counted.items()))
    spots = F.sequence(F.lit(0), F.col("n_words").cast("int") - window)
    grams = F.transform(spots, lambda i: F.xxhash64(*(F.get("_h", i + j) for j in range(window))))
    out = out.withColumn("_g", F.when(F.col("n_words") >= window, grams).otherwise(F.array().cast("array<long>"))).drop("_h")
    some = F.size(F.array_distinct("_g")) < F.size("_g")
    paired = F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(some, paired)).drop("_g")
    twice = F.filter("_s", lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"]))
    out = out.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_s")
    start = F.struct(F.lit(0).alias("covered"), F.lit(-window).alias("last"))
    covered = F.aggregate("_p", start, lambda a, x: F.struct((a["covered"] + F.least(F.lit(window), x - a["last"])).alias("covered"), x.alias("last")), lambda a: a["covered"])
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    over = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    rates = {
        "symbol_rate": over("n_symbols", "n_words"), "bang_rate": over("n_bangs", "n_words"), "upper_rate": over("n_upper", "word_chars"),
        "digit_rate": over("n_digits", "word_chars"), "repeat_rate": over("n_repeat_words", "n_words"), "dup_line_rate": over("n_dup_lines", "n_lines"),
        "distinct_rate": over("n_distinct", "n_words"), "word_length": over("word_chars", "n_words"),
    }
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(c.alias(n) for n, c in rates.items()))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.bound) if self.above else F.col(self.feature) <= F.lit(self.bound)

    def on(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.bound if self.above else x[self.feature] <= self.bound


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (t.on(x) for t in rule), np.ones(n, bool))


def _cuts(values: np.ndarray, bad: np.ndarray, most: int) -> np.ndarray:
    """Midpoints between the classes' quantiles."""
    points = [np.quantile(v, np.linspace(0, 1, most)) for v in (values[bad], values[~bad]) if len(v)]
    points = np.unique(np.concatenate(points)) if points else np.empty(0)
    return (points[1:] + points[:-1]) / 2


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 3, cuts: int = 24, precision: float = 0.8) -> list[Rule]:
    """Sequential covering. The every third row prunes, the others grow; a rule must reach ``precision`` on both."""
    n = len(bad)
    prunes, left, rules = np.arange(n) % 3 == 2, np.ones(n, bool), []
    options = [Test(f, above, float(c)) for f in FEATURES for c in _cuts(x[f], bad, cuts) for above in (True, False)]
    masks = [t.on(x) for t in options]
    for _ in range(most_rules):
        grow = left & ~prunes
        if not (grow & bad).any():
            break
        rule: Rule = ()
        held = grow
        for _ in range(most_tests):
            p, q = (held & bad).sum(), (held & ~bad).sum()
            if q == 0:
                break
            base = np.log2(p / (p + q))
            gains = []
            for m in masks:
                a, b = np.count_nonzero(held & bad & m), np.count_nonzero(held & ~bad & m)
                gains.append(a * (np.log2(a / (a + b)) - base) if a else -1.0)
            best = int(np.argmax(gains))
            if gains[best] <= 1e-9:
                break
            rule, held = (*rule, options[best]), held & masks[best]
        if not rule:
            break
        check = left & prunes

        def worth(r: Rule) -> float:
            m = _covers(r, x, n) & check
            a, b = (m & bad).sum(), (m & ~bad).sum()
            return (a - b) / (a + b) if a + b else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        m = _covers(rule, x, n) & left
        if (m & bad).sum() < precision * max(1, m.sum()) or (m & bad & ~prunes).sum() < 2:
            break
        rules.append(rule)
        left &= ~m
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that a row meets; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        met = reduce(lambda a, b: a & b, (t.column() for t in rule))
        out = F.when(met, i) if out is None else out.when(met, i)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, learn_rows: int = 20_000) -> DataFrame:
    """Statistics and verdict for each whole text.

    Takes ``docs(doc_id, text, ...)`` and ``labels(doc_id, quality, ...)``. Rules are learned from at
    most ``learn_rows`` labelled rows, those least by a hash of doc_id; null labels and null doc_ids
    teach nothing, of clashing labels the smaller holds; without rows of both classes the list is empty. Returns a row for each input
    row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    rule (number of the rule that dropped it, else 0). Null and blank texts have zeros and fail the
    base. Repeated rows are judged alike. An empty table gives an empty result.
    """
    base = docs.select("doc_id", "text")
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = stored(drawn(marked, learn_rows, "doc_id"), "labelled")
    taught = text_stats(base.join(picked, "doc_id", "left_semi")).join(picked, "doc_id")
    rows = taught.orderBy(F.xxhash64("doc_id"), "doc_id").select("quality", *FEATURES).limit(2 * learn_rows).collect()
    bad = np.array([r["quality"] == 0 for r in rows], bool)
    rules = learn_list({f: np.array([r[f] for r in rows]) for f in FEATURES}, bad) if bad.any() and not bad.all() else []
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = text_stats(base).withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")

"""Quality rules, quality model, languages and language model."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import language_model as lm
from brindle.llm import quality_model as qm
from brindle.llm.language import identify_languages
from brindle.llm.quality_model import quality_scores
from brindle.llm.quality_rules import quality_rules, text_stats
from brindle.llm.queries import lid_pages, op3_quality_rules, op5_language_model, op8_language_id, op10_quality_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, "\n\n"), (4, "word"), (4, "word"), (None, "a b c d e f a b c d e"), (6, "long " * 20000), (7, "Zeile eins\nZeile eins\n\nx")]


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def odd(spark):
    return spark.createDataFrame([(d, t, None, "s", "clash") for d, t in ODD], "doc_id long, text string, lang string, source string, score string")


def no_labels(spark):
    return spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")


def stats(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark, sf):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    text = {d["doc_id"]: d["text"] for d in docs_of(spark, sf)}
    for r in op3_quality_rules(spark, sf).collect():
        want = stats(text[r["doc_id"]])
        assert tuple(r[n] for n in names) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["rule"] == 0)
    got = collections.Counter(tuple(r[n] for n in names) for r in text_stats(odd(spark)).collect())
    assert got == collections.Counter(stats(t) for _, t in ODD)


def test_rules_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    wrong = sum((quality[r["doc_id"]] == 1) != (r["kept"] or r["n_words"] < 10) for r in op3_quality_rules(spark, sf).collect() if r["doc_id"] in quality)
    assert wrong <= 0.03 * len(quality)


def test_rules_odd(spark):
    assert quality_rules(odd(spark), no_labels(spark)).count() == len(ODD)
    assert quality_rules(odd(spark).where("false"), no_labels(spark)).count() == 0


def test_quality_model(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = total = 0
    for r in op10_quality_model(spark, sf).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        if r["held_out"] and r["doc_id"] in quality:
            right, total = right + (r["predicted"] == quality[r["doc_id"]]), total + 1
    assert right >= 0.95 * total
    out = quality_scores(odd(spark), no_labels(spark)).collect()
    assert len(out) == len(ODD) and len({r["score"] for r in out}) == 1
    assert quality_scores(odd(spark).where("false"), no_labels(spark)).count() == 0


def test_scores_are_sums_of_tables(spark, sf):
    text = {d["doc_id"]: d["text"] for d in docs_of(spark, sf)}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in text and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    order = [r["doc_id"] for r in spark.createDataFrame([(d,) for d in quality], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    model = qm.fit(qm.text_features([text[d] for d in order]), np.array([quality[d] for d in order]))
    for r in op10_quality_model(spark, sf).collect():
        x = qm.text_features([text[r["doc_id"]]])[0]
        b = [sum(v > bound for bound in bounds) for v, bounds in zip(x, model.bounds)]
        z = model.base + sum(t[i] for t, i in zip(model.tables, b)) + sum(t[b[i]][b[j]] for (i, j), t in model.pairs.items())
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-6)


def test_verdicts_are_those_of_the_list(spark, sf):
    from brindle.llm.quality_rules import FEATURES, learn_list

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    made = {r["doc_id"]: r for r in text_stats(docs).collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r["doc_id"] in made}
    order = [r["doc_id"] for r in spark.createDataFrame([(d,) for d in quality], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rules = learn_list({f: np.array([made[d][f] for d in order]) for f in FEATURES}, np.array([quality[d] == 0 for d in order]))
    meets = lambda rule, r: all(r[t.feature] > t.bound if t.above else r[t.feature] <= t.bound for t in rule)
    assert rules
    for r in op3_quality_rules(spark, sf).collect():
        assert r["rule"] == next((i for i, rule in enumerate(rules, 1) if meets(rule, made[r["doc_id"]])), 0)


def test_languages(spark, sf):
    lang = {d["doc_id"]: d["lang"] for d in docs_of(spark, sf)}
    out = op8_language_id(spark, sf).collect()
    assert len(out) == len(lang)
    assert sum(r["pred_lang"] == lang[r["doc_id"]] and r["accepted"] for r in out) >= 0.99 * len(lang)


def fused(spark, rows, weight=20.0, most=60, least=0.6):
    """Posteriors by plain loops from (key, text, declared, host, domain, suffix): the text model is the operator's, all counts are made here."""
    from brindle.llm.language import _trained

    docs = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id long, text string, lang string")
    model = _trained(docs, "doc_id", "text", "lang", 4000, 256)
    names, (logs, n) = model.languages, model.logs([r[1] for r in rows], most)
    text_lang = [names[int(x.argmax())] if k else None for x, k in zip(logs, n)]
    seen = [collections.defaultdict(collections.Counter) for _ in range(4)]
    overall = collections.Counter(x for x in text_lang if x)
    for r, x in zip(rows, text_lang):
        for kind in range(4):
            if x and r[2 + kind] is not None:
                seen[kind][r[2 + kind]][x] += 1
    base = {x: (overall[x] + 1) / (sum(overall.values()) + len(names)) for x in names}

    def prior(kind, value, back):
        c = seen[kind].get(value) if value is not None else None
        return back if c is None else {x: (c[x] + weight * back[x]) / (sum(c.values()) + weight) for x in names}

    out = []
    for r, own, k, by_text in zip(rows, logs, n, text_lang):
        host = prior(1, r[3], prior(2, r[4], base))
        declared, suffix = prior(0, r[2], base), prior(3, r[5], base)
        z = [own[i] + math.log(host[x] * declared[x] / base[x] * suffix[x] / base[x]) for i, x in enumerate(names)]
        top = max(z)
        posterior = 1 / sum(math.exp(v - top) for v in z)
        out.append((r[0], by_text, names[z.index(top)], posterior, bool(posterior >= least and k)))
    return out


def same_languages(got, want, key):
    got = {r[key]: r for r in got}
    return len(got) == len(want) and all(
        (got[k]["text_lang"], got[k]["pred_lang"], got[k]["accepted"]) == (text, pred, fine) and math.isclose(got[k]["posterior"], p, rel_tol=1e-6) for k, text, pred, p, fine in want
    )


def test_evidence_is_fused_as_by_hand(spark, sf):
    rows = [(d["doc_id"], d["text"], d["lang"], d["source"], None, None) for d in docs_of(spark, sf)]
    assert same_languages(op8_language_id(spark, sf).collect(), fused(spark, rows), "doc_id")


def test_pages_are_fused_as_by_hand(spark, sf):
    rows = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        bare = re.sub(r"(?is)<(script|style|nav)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", r["html"])
        tag, host = re.search("(?i)<html[^>]*\\blang=[\"']?([a-z]+)", r["html"]), re.match("^[a-z]+://([^/:?#]+)", r["url"])
        host = host.group(1).lower() if host else ""
        domain, suffix = re.search("([^.]+\\.[^.]+)$", host), re.search("\\.([^.]+)$", host)
        rows.append((r["page_id"], bare, tag and tag.group(1), host or None, domain and domain.group(1), suffix and suffix.group(1)))
    assert same_languages(lid_pages(spark, sf).collect(), fused(spark, rows), "page_id")


def test_languages_without_and_against_the_declaration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 80")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    wrong = F.when(F.col("lang") == "en", "de").otherwise("en")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).when(F.col("doc_id") % 25 == 1, wrong).otherwise(F.col("lang")))
    out = identify_languages(hidden).collect()
    for some in ([r for r in out if r["doc_id"] % 2 == 0], [r for r in out if r["doc_id"] % 25 == 1 and r["doc_id"] % 2]):
        assert len(some) > 10 and sum(r["pred_lang"] == truth[r["doc_id"]] for r in some) >= 0.97 * len(some)


def test_languages_odd(spark, sf):
    out = identify_languages(odd(spark)).collect()
    assert len(out) == len(ODD) and not any(r["accepted"] for r in out)
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    mixed = identify_languages(some.union(odd(spark).select("doc_id", "text", "lang", "source"))).collect()
    assert len(mixed) == len(ODD) + some.count()
    assert not any(r["accepted"] for r in mixed if r["n_trigrams"] == 0)
    assert identify_languages(odd(spark).where("false")).count() == 0


def test_rare_and_many_languages(spark):
    # one language of few texts among many, and 80 declared values
    r = np.random.default_rng(6)
    tongue = lambda i, n: " ".join("".join(chr(97 + (i * 7 + x * (1 + i % 5)) % 26) for x in r.integers(0, 6, 6)) for _ in range(n))
    rows = [(i, tongue(0, 12), "aa", None) for i in range(6000)] + [(7000 + i, tongue(3, 40), "rr", None) for i in range(3)]
    out = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), learn_rows=100).where("doc_id >= 7000").collect()
    assert [x["text_lang"] for x in out] == ["rr"] * 3
    rows = [(100 * i + j, " ".join(chr(0x4E00 + 40 * i + x) * 2 for x in r.integers(0, 30, 40)), f"l{i:02d}", None) for i in range(80) for j in range(3)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert all(x["text_lang"] == f"l{x['doc_id'] // 100:02d}" for x in identify_languages(many).collect())
    with pytest.raises(ValueError):
        identify_languages(many, most_languages=79)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_language_model(spark, sf):
    docs = [(d["doc_id"], WORD.findall(lowered(d["text"]))) for d in docs_of(spark, sf)]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    count = collections.Counter(w for d, ws in docs if not held(d) for w in ws)
    ends = sum(not held(d) for d, _ in docs)
    n, v = sum(count.values()) + ends, len(count) + 1
    got = {r["doc_id"]: r for r in op5_language_model(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, ws in docs:
        r = got[d]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(ws) + 1, sum(w in count for w in ws) + 1, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] <= 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_odd(spark):
    out = lm.score_texts(odd(spark).select("doc_id", "text", "source")).collect()
    assert len(out) == len(ODD) and sum(r["doc_id"] is None for r in out) == 1
    assert {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert lm.score_texts(odd(spark).where("false")).count() == 0


def test_filter_grows_and_stays_in_cells(spark, sf, monkeypatch):
    for tokens in (10**4, 10**8, 10**11):
        assert 8 * tokens <= lm.filter_bits(tokens) <= max(1 << 16, 16 * tokens)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    junk = spark.createDataFrame([(i, " ".join(f"q{i}x{j}" for j in range(50))) for i in range(10**6, 10**6 + 60)], "doc_id long, text string")
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *_: (_ for _ in ()).throw(AssertionError("broadcast of a filter that grows")))
    out = [r for r in lm.score_texts(docs.union(junk), block_chars=1 << 14).collect() if r["held_out"]]
    mean = lambda rows: sum(r["score"] / r["n_tokens"] for r in rows) / len(rows)
    assert mean([r for r in out if r["doc_id"] >= 10**6]) < mean([r for r in out if r["doc_id"] < 10**6]) - 0.5


def model_by_hand(docs, order):
    """Scores from exact counts, quantised as the filter does, by plain loops; weights fitted on the tokens themselves."""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
    texts = {d: [*WORD.findall(lowered(t)), None] for d, t in docs}
    gram = lambda own, i, n: (n, *(own[i - n + 1 : i + 1] if i >= n - 1 else ["", *own[: i + 1]][-n:]))
    count = collections.Counter()
    for d, own in texts.items():
        for i in range(len(own) if held[d] else 0, len(own)):
            for n in range(1, order + 1):
                count[gram(own, i, n)] += 1
    ends, tokens, types = sum(not h for h in held.values()), sum(len(t) for d, t in texts.items() if not held[d]), sum(g[0] == 1 for g in count)
    middle = lambda n: lm._MIDDLES[np.searchsorted(lm._FLOORS, n, side="right")] if n else 0.0

    def seen(own, i, n):
        if n == 1:
            return float(ends) if own[i] is None else middle(count[gram(own, i, 1)])
        return middle(count[gram(own, i, n)])

    rows = [(d, i) for d, own in texts.items() for i in range(len(own))]
    single = np.array([min(1.0, (seen(texts[d], i, 1) + 1) / (tokens + types + 1)) for d, i in rows])
    train, p, loo = np.array([not held[d] for d, _ in rows]), single.copy(), single.copy()
    for n in range(2, order + 1):
        c = np.array([seen(texts[d], i, n) for d, i in rows])
        x = np.array([seen(texts[d], i - 1, n - 1) if i else float(ends) for d, i in rows])
        rest, cls, weights = np.clip((c - 1) / np.maximum(x - 1, 1), 0, 1), lm._class(x), np.full(24, 0.3)
        for _ in range(25):
            w = weights[cls[train]]
            share = w * rest[train] / ((1 - w) * loo[train] + w * rest[train])
            weights = (np.bincount(cls[train], share, 24) + 0.1) / (np.bincount(cls[train], minlength=24) + 10)
        weights[0] = 0.0
        w = weights[cls]
        p, loo = (1 - w) * p + w * np.minimum(1.0, c / np.maximum(x, 1)), (1 - w) * loo + w * rest
    out = collections.defaultdict(float)
    for (d, _), q in zip(rows, p):
        out[d] += math.log10(q)
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_the_model(spark, monkeypatch, order):
    r = np.random.default_rng(12)
    docs = [(i, " ".join(f"w{x}" for x in np.cumsum(r.integers(0, 3, int(r.integers(1, 60)))) % 40)) for i in range(150)]
    monkeypatch.setattr(lm, "filter_bits", lambda _: 1 << 25)
    want = model_by_hand(docs, order)
    got = lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), order=order, block_chars=1 << 11).collect()
    assert len(got) == len(docs) and all(math.isclose(x["score"], want[x["doc_id"]], rel_tol=0.01) for x in got)


def test_scores_stay_log_probabilities(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "filter_bits", lambda tokens: 1 << int(np.log2(max(1024, tokens // 4))))
    out = lm.score_texts(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert all(r["score"] <= 0 for r in out)


def test_weights_come_from_all_blocks(spark):
    # a sixth of the texts has words in order, all others in none; few blocks can hold no such mixture
    r = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in ((np.arange(200) + r.integers(300)) % 300 if i < 20 else r.integers(0, 300, 200)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    one, many = ({x["doc_id"]: x["score"] for x in lm.score_texts(docs, block_chars=size).collect()} for size in (1 << 22, 1 << 14))
    assert all(math.isclose(one[d], many[d], rel_tol=0.01) for d in one)


def test_binned_weights_are_those_of_the_tokens():
    r = np.random.default_rng(9)
    single, pair, context = r.random(5000) / 100 + 1e-6, r.integers(1, 40, 5000).astype(float), r.integers(1, 4000, 5000).astype(float)
    rest, cls, weights = np.clip((pair - 1) / np.maximum(context - 1, 1), 0, 1), lm._class(context), np.full(24, 0.3)
    for _ in range(25):
        w = weights[cls]
        share = w * rest / ((1 - w) * single + w * rest)
        weights = (np.bincount(cls, share, 24) + 0.1) / (np.bincount(cls, minlength=24) + 10)
    bins, tokens = np.unique(lm.ratio_bins(single, pair, context), return_counts=True)
    assert np.abs(lm.fit_weights(bins, tokens)[1:] - weights[1:]).max() < 0.005


def test_filter_counts():
    r = np.random.default_rng(4)
    keys, counts = np.unique(r.integers(0, 1 << 63, 5000, dtype=np.uint64)), None
    counts = r.integers(1, 2000, len(keys))
    cells, width = 8, 1 << 20
    where = lm.cell_of(keys, cells)
    bits = np.concatenate([lm.FrequencyFilter.fill(keys[where == c], counts[where == c], width) for c in range(cells)])
    got = lm.FrequencyFilter(bits, cells).counts(keys)
    assert (got >= counts * 0.86).all() and (np.abs(got - counts) <= 0.16 * counts + 1).mean() > 0.9
    assert (lm.FrequencyFilter(bits, cells).counts(r.integers(0, 1 << 63, 2000, dtype=np.uint64)) > 0).mean() < 0.2

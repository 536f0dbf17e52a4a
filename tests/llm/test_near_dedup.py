"""SuperMinHash grouping against brute force and on odd tables."""

import random
import re

import numpy as np
import pytest

from brindle.llm.near_dedup import near_duplicates, signatures
from brindle.llm.queries import op1_near_dedup


def brute(rows, k, percent=80):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append((doc, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 600, dtype=np.uint64)
    a, b = np.unique(base[:500]), np.unique(base[100:])
    both = signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 200)
    assert abs((both[0] == both[1]).mean() - 400 / 600) < 0.12
    small = signatures(a[:3], np.zeros(3, int), 1, 200)
    ranks = small[0] >> np.uint32(24)
    assert ranks.max() < 200 and len(np.unique(small)) > 100


def test_dense_and_sparse_permutations_agree(monkeypatch):
    r = np.random.default_rng(2)
    x, owner = r.integers(0, 1 << 63, 40, dtype=np.uint64), np.repeat(np.arange(10), 4)
    a = signatures(x, owner, 10, 64)
    monkeypatch.setattr("brindle.llm.near_dedup._DENSE_FROM", 1000)
    assert (a == signatures(x, owner, 10, 64)).all()


def test_tables(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op1_near_dedup(spark, sf).collect()}
    assert got == brute(rows, 2)


def grouped(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates(df, **how).collect()}


def family(n, least, most, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        own = list(words)
        for at in r.sample(range(120), r.randint(least, most)):
            own[at] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("least, most, how", [(0, 9, {}), (5, 10, {"block": 40}), (3, 8, {"elements": 3000})])
def test_family_of_copies(spark, least, most, how):
    rows = family(400, least, most, 3)
    assert grouped(spark, rows, shingle=2, **how) == brute(rows, 2)


def test_links_between_members_that_lead_nothing(spark):
    # all share a core at 0.78; only the two of a pair reach 0.8, and mostly meet in buckets with half of all rows
    core = [f"c{i}" for i in range(142)]
    rows = [(2 * p + m, " ".join([*core, f"t{p}a", f"t{p}b", *(f"o{p}x{m}x{i}" for i in range(18))])) for p in range(80) for m in range(2)]
    for how in ({}, {"block": 16}):
        assert grouped(spark, rows, shingle=1, **how) == brute(rows, 1)


@pytest.mark.parametrize("exact", [True, False])
def test_blocks_meet_across_roots(spark, exact):
    from brindle.llm.near_dedup import _across

    rows = [(7, i, 1, 0 if i < 9 else i, [5] * (1 if exact else 15)) for i in range(14)]
    placed = spark.createDataFrame(rows, "key long, cid long, n long, root long, values array<long>")
    got = [(r["a"], r["b"]) for r in _across(placed, 80, exact, block=3).collect()]
    root = {i: 0 if i < 9 else i for i in range(14)}
    for a, b in got:
        root = {i: min(root[a], root[b]) if r in (root[a], root[b]) else r for i, r in root.items()}
    assert set(root.values()) == {0}
    assert len(got) <= 5 * 5  # five members outside the largest root, five blocks


def test_repeated_ids_link_nothing(spark):
    words = [f"w{i}" for i in range(40)]
    a, b = " ".join(words), " ".join(w + "z" for w in words)
    rows = [(5, a), (5, b), (3, a + " more"), (9, b + " more"), (5, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == [(3, 37, 3, True), (5, 36, 3, False), (5, 36, 5, True), (5, 36, 5, True), (9, 37, 5, False)]


def test_groups_of_any_size_stay_whole():
    import pyarrow as pa

    from brindle.llm._words import whole_groups

    keys = np.repeat(np.arange(9), [1, 2, 30, 1, 1, 12, 3, 3, 1])
    table = pa.table({"k": keys, "v": np.arange(len(keys))})
    for size in (1, 4, 7, 100):
        got = list(whole_groups(iter(table.to_batches(max_chunksize=size)), 1))
        assert [x for t, _ in got for x in t.column("v").to_pylist()] == list(range(len(keys)))
        groups = [tuple(t.column("k")[a:b].to_pylist()) for t, at in got for a, b in zip(at[:-1], at[1:])]
        assert groups == [(k,) * int((keys == k).sum()) for k in range(9)]


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", "a"), (4, "One", "a"), (5, "one", None), (5, "one", None), (None, "one", "b"), (7, "two " * 30000, "b"), (8, "two " * 30000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=repr)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, None, True), (7, 1, 7, True), (8, 1, 7, False)]
    assert got == sorted(want, key=repr)
    assert near_duplicates(df.where("false")).count() == 0


def test_slots_are_checked():
    with pytest.raises(ValueError):
        signatures(np.zeros(1, np.uint64), np.zeros(1, int), 1, 256)

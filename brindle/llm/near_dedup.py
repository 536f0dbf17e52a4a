"""Near-duplicate grouping with SuperMinHash signatures.

Every distinct shingle set gets a signature in which slot ``s`` holds the
least ``rank + fraction`` over the elements, where an element's ranks are one
random permutation of the slots. As all values of rank ``j`` exceed those of
lower ranks, a set is finished as soon as its largest slot lies below the next
rank. Signatures are cut into bands. Sets that share a band and whose signatures
are near enough go to one family, by union-find; inside a family all links are
found on full sets, and joined by union-find again.

But for two leaders of each bucket that meet its members, no step emits pairs. A task holds a bounded block of sets, compares them in
memory and gives back only the links that join what was apart, so rows stay linear
in the sets however large a bucket or a family is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm._graph import components, few
from brindle.llm._store import released, stored
from brindle.llm._words import _GOLDEN, Words, mix, shingle_hashes, slices, whole_groups

_FULL = np.uint32(0xFFFFFFFF)
_DENSE_FROM = 4
_MOST_SENT = 4_000_000  # ids, of 8 bytes each, that are broadcast at most
_BLOCK = 2048  # sets of a bucket or family that meet as many others in one task
_BLOCK_ELEMENTS = 1 << 21  # and their shingles
_LEADERS = 8  # of a family in several blocks: sets that meet all others first
_SLOTS = 240  # slots in a signature; bands are cut from the first of them, comparison uses all


def signatures(elements: np.ndarray, owner: np.ndarray, n_sets: int, slots: int) -> np.ndarray:
    """SuperMinHash of many sets at once: (n_sets, slots), rank in the high byte, fraction below.

    ``elements`` are distinct 64-bit hashes within a set and ``owner`` the index of
    the set of each. A set without elements keeps the largest value everywhere.
    """
    if not 1 <= slots <= 255:
        raise ValueError("slots must lie in 1..255")
    sig = np.full(n_sets * slots, _FULL, np.uint32)
    hit: list[tuple[np.ndarray, np.ndarray]] = []  # positions drawn so far and what was put there
    dense: np.ndarray | None = None
    for j in range(slots):
        draw = mix(elements + np.uint64((j + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        k = (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64) + j
        if j == _DENSE_FROM:
            dense = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
            row = np.arange(len(elements))
            for position, value in hit:
                dense[row, position] = value
        if dense is None:
            here, there = np.full(len(k), j, np.int64), k.copy()
            for position, value in hit:
                here = np.where(position == j, value, here)
                there = np.where(position == k, value, there)
            hit.append((k, here))
        else:
            row = np.arange(len(elements))
            here, there = dense[row, j], dense[row, k].astype(np.int64)
            dense[row, k] = here
        value = (np.uint32(j) << np.uint32(24)) | (draw >> np.uint64(40)).astype(np.uint32)
        np.minimum.at(sig, owner * slots + there, value)
        if j + 1 == slots:
            break
        open_sets = sig.reshape(n_sets, slots).max(axis=1) >= (np.uint32(j + 1) << np.uint32(24))
        keep = open_sets[owner]
        if not keep.any():
            break
        if not keep.all():
            elements, owner = elements[keep], owner[keep]
            hit = [(p[keep], v[keep]) for p, v in hit] if dense is None else []
            dense = None if dense is None else dense[keep]
    return sig.reshape(n_sets, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), np.uint64)
    wide = sig.astype(np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * _GOLDEN + wide[:, b * rows + r])
        out[:, b] = key
    return out


def packed_slots(sig: np.ndarray) -> np.ndarray:
    """Four low bits of each slot, sixteen slots to a 64-bit number, for comparing signatures in SQL."""
    n, slots = sig.shape
    low = np.zeros((n, -(-slots // 16) * 16), np.uint64)
    low[:, :slots] = sig & np.uint32(15)
    return np.bitwise_or.reduce(low.reshape(n, -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)


def _most_apart(slots: int, percent: int) -> float:
    """Slots in which sets at the similarity are expected to differ, and four standard deviations."""
    p = percent / 100 + (1 - percent / 100) / 16
    return slots - (slots * p - 4 * (slots * p * (1 - p)) ** 0.5)


def _differ(x: str, y: str, slots: int) -> Column:
    differ = None
    for i in range(-(-slots // 16)):
        d = F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))
        d = d.bitwiseOR(F.shiftright(d, 1))
        d = F.bit_count(d.bitwiseOR(F.shiftright(d, 2)).bitwiseAND(F.lit(0x1111111111111111)))
        differ = d if differ is None else differ + d
    return differ


def _distinct_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    words = Words(texts)
    hashes, at = words.hashes(), words.offsets
    return [np.unique(shingle_hashes(hashes[at[i] : at[i + 1]], k)) for i in range(len(texts))]


def _fingerprints(elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over the elements of each set, by which equal sets are known."""
    first, second = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        first[full] = np.add.reduceat(mix(elements), at)
        second[full] = np.add.reduceat(mix(elements ^ _GOLDEN), at)
    return first.view(np.int64), second.view(np.int64)


def _sized(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    sets = _distinct_sets(texts, k)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.fromiter(map(len, sets), np.int64, len(sets))


def _signed(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, texts in slices(batch, 1, 1 << 19):
            elements, sizes = _sized(texts, k)
            sig = signatures(elements, np.repeat(np.arange(len(sizes)), sizes), len(sizes), max(_SLOTS, bands * rows))
            keys, packed = band_keys(sig, bands, rows), packed_slots(sig)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.view(np.int64).ravel())) for x in (keys, packed)]
            part = batch.slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(sizes), *map(pa.array, _fingerprints(elements, sizes)), *lists],
                names=["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "bands", "slots"],
            )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, texts in slices(batch, 1, 1 << 19):
            elements, sizes = _sized(texts, k)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, end - begin), *map(pa.array, _fingerprints(elements, sizes)), pa.ListArray.from_arrays(offsets, pa.array(elements.view(np.int64)))],
                names=["doc_id", "fp1", "fp2", "grams"],
            )


def _plausible(pairs: DataFrame, slots: DataFrame, n_slots: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures are near enough for the similarity."""
    left = slots.select(F.col("cid").alias("a"), F.col("slots").alias("sa"))
    right = slots.select(F.col("cid").alias("b"), F.col("slots").alias("sb"))
    return pairs.join(left, "a").join(right, "b").where(_differ("sa", "sb", n_slots) <= _most_apart(n_slots, percent)).select("a", "b")


def _stars(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs of each bucket's leaders, the least member and the one in most company, with its members: linear in these."""
    own = F.struct("cid", "n")
    heads = shared.groupBy("key").agg(F.array_distinct(F.array(F.min_by(own, "cid"), F.max_by(own, F.struct("weight", "cid")))).alias("heads"))
    met = shared.join(heads, "key").select("cid", "n", F.explode("heads").alias("h"))
    fits = F.least("n", F.col("h.n")) * 100 >= F.greatest("n", F.col("h.n")) * percent
    return met.where((F.col("cid") != F.col("h.cid")) & fits).select(F.least("cid", "h.cid").alias("a"), F.greatest("cid", "h.cid").alias("b")).distinct()


def _joined(near: Callable[[int], np.ndarray], label: np.ndarray, begin: int, within: bool) -> list[tuple[int, int]]:
    """Links (i, j) of rows that join different labels, enough to join all that are near.

    Rows before ``begin`` meet those from it on. With ``within`` these then meet each other: only rows outside
    the component of one fixed row need to, as of any two that are apart one is outside. ``near(i)`` tells which
    rows from ``begin`` on are near row i. ``label`` is changed.
    """
    out: list[tuple[int, int]] = []
    right = label[begin:]

    def meet(i: int) -> None:
        other = right != label[i]
        if other.any():
            at = np.flatnonzero(near(i) & other)
            if len(at):
                found, first = np.unique(right[at], return_index=True)
                out.extend((i, begin + int(j)) for j in at[first])
                label[np.isin(label, found)] = label[i]

    for i in range(begin):
        meet(i)
    if within and len(right):
        if not begin:
            meet(0)
        names, sizes = np.unique(right, return_counts=True)
        fixed = begin + int(np.argmax(right == names[sizes.argmax()]))
        for i in range(begin, len(label)):
            if label[i] != label[fixed]:
                meet(i)
    return out


def _near_signatures(n: np.ndarray, slots: np.ndarray, begin: int, percent: int) -> Callable[[int], np.ndarray]:
    most, other, size = _most_apart(slots.shape[1] * 16, percent), slots[begin:], n[begin:]

    def near(i: int) -> np.ndarray:
        out = np.minimum(size, n[i]) * 100 >= np.maximum(size, n[i]) * percent
        at = np.flatnonzero(out)
        d = other[at] ^ slots[i]
        d |= d >> np.uint64(1)
        d = (d | (d >> np.uint64(2))) & np.uint64(0x1111111111111111)
        out[at] = np.bitwise_count(d).sum(axis=1, dtype=np.int64) <= most
        return out

    return near


def _near_sets(elements: np.ndarray, at: np.ndarray, begin: int, percent: int) -> Callable[[int], np.ndarray]:
    """Exact similarity of one set with all from ``begin`` on, by the lists of the sets that hold each element."""
    sizes = np.diff(at)
    rest, mine = elements[at[begin] :], sizes[begin:]
    order = np.argsort(rest, kind="stable")
    holder = np.repeat(np.arange(len(mine), dtype=np.int32), mine)[order]
    names, first = np.unique(rest[order], return_index=True)
    ends = np.append(first[1:], len(rest))

    def near(i: int) -> np.ndarray:
        own = elements[at[i] : at[i + 1]]
        place = np.minimum(np.searchsorted(names, own), len(names) - 1)
        place = place[names[place] == own]
        length = ends[place] - first[place]
        where = np.repeat(first[place] - np.cumsum(length) + length, length) + np.arange(length.sum())
        inter = np.bincount(holder[where], minlength=len(mine))
        return inter * 100 >= (sizes[i] + mine - inter) * percent

    return near


def _links(batches: Iterator[pa.RecordBatch], percent: int, exact: bool, within: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (key, i, j, side, cid, n, root, values) sorted by the first five: links (a, b) that join roots in each block.

    ``values`` are the shingles, or the packed signature if not ``exact``. Rows alike in the first five count once.
    """
    for table, bounds in whole_groups(batches, 3):
        side, cid, n, root = (table.column(c).to_numpy() for c in ("side", "cid", "n", "root"))
        values = table.column("values")
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(values).to_numpy())]).astype(np.int64)
        flat = values.flatten().to_numpy().view(np.uint64)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            rows = np.arange(low, high)
            again = (cid[low + 1 : high] == cid[low : high - 1]) & (side[low + 1 : high] == side[low : high - 1])
            part, cut = flat[at[low] : at[high]], at[low : high + 1] - at[low]
            if again.any():
                keep = np.append(True, ~again)
                part, rows = part[np.repeat(keep, np.diff(cut))], rows[keep]
                cut = np.concatenate([[0], np.cumsum(np.diff(cut)[keep])])
            begin = int((side[rows] == 0).sum())
            if begin == len(rows):
                continue
            near = _near_sets(part, cut, begin, percent) if exact else _near_signatures(n[rows], part.reshape(len(rows), -1), begin, percent)
            if links := _joined(near, root[rows].copy(), begin, within):
                x, y = cid[rows[np.array(links)]].T
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


_ROW = ("key", "i", "j", "side", "cid", "n", "root", "values")


def _met(rows: DataFrame, percent: int, exact: bool, within: bool) -> DataFrame:
    laid = rows.select(*_ROW).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "cid")
    return laid.mapInArrow(lambda it: _links(it, percent, exact, within), "a long, b long")


def _across(placed: DataFrame, percent: int, exact: bool, block: int = _BLOCK, elements: int = _BLOCK_ELEMENTS) -> DataFrame:
    """Links that join the roots of each key of ``placed(key, cid, n, root, values)``.

    Of two members with different roots one at least is outside the key's largest root, so those outside meet
    all members. Both sides are dealt in blocks, a pair of blocks to a task; only joining links leave it.
    """
    roots = placed.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("n").alias("e"))
    sizes = roots.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.max_by("e", F.struct("m", "root")).alias("most_e"), F.max("m").alias("most"), F.sum("m").alias("all"), F.sum("e").alias("all_e"))
    e = F.lit(elements if exact else 1 << 62)
    blocks = lambda m, e_: F.greatest(F.ceil(m / block), F.ceil(e_ / e)).cast("long")
    sizes = sizes.where("all > most").select("key", "main", blocks(F.col("all"), F.col("all_e")).alias("nr"), blocks(F.col("all") - F.col("most"), F.col("all_e") - F.col("most_e")).alias("nl"))
    rows = stored(placed.join(sizes, "key"), "across")
    place = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = ("cid", "n", "root", "values")
    left = rows.where("root <> main").select("key", place("nl").alias("i"), each("nr").alias("j"), F.lit(0).alias("side"), *own)
    right = rows.select("key", each("nl").alias("i"), place("nr").alias("j"), F.lit(1).alias("side"), *own)
    return _met(left.unionByName(right), percent, exact, within=False)


def _families(classes: DataFrame, percent: int, n_slots: int) -> DataFrame:
    """(node, root): classes joined by plausible pairs that share a band. Every plausible pair is inside one family."""
    slots = classes.select("cid", "slots")
    spread = classes.select("cid", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    crowded = spread.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = stored(spread.join(crowded, "key"), "met")
    n_shared = met.count()
    # a set that meets many others is near the middle of its group
    weights = few(met.groupBy("cid").agg(F.sum("members").alias("weight")), n_shared)
    shared = stored(few(met.join(weights, "cid"), n_shared), "shared")
    released(met)
    links = stored(_plausible(_stars(shared, percent), slots, n_slots, percent), "pairs")
    roots = components(links)
    # in buckets of up to three, the leaders have met all; in others what is then apart meets
    placed = stored(few(_rooted(shared.where("members > 3"), roots, "cid", "root"), n_shared), "placed")
    mixed = few(placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key"), n_shared)
    placed = placed.join(mixed, "key").join(slots.withColumnRenamed("slots", "values"), "cid")
    rest = stored(_across(placed.select("key", "cid", "n", "root", "values"), percent, exact=False), "rest")
    return components(links.union(rest)) if not rest.isEmpty() else roots


def _linked(families: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int, block: int, elements: int) -> DataFrame:
    """Links (a, b) on full sets, enough to join all classes of a family that any links join."""
    of = families.select(F.col("node").alias("cid"), F.col("root").alias("key"))
    wanted = stored(of.join(classes.select("cid", F.col("rep").alias("doc_id"), "fp1", "fp2", F.col("n_shingles").alias("n")), "cid"), "wanted")
    ids = wanted.select("doc_id").distinct()
    # ids go to the texts as long as they fit; beyond that both are dealt by id, once
    ids = F.broadcast(ids) if wanted.count() <= _MOST_SENT else ids
    made = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lambda it: _sets(it, shingle), "doc_id long, fp1 long, fp2 long, grams array<long>")
    sets = stored(made.join(wanted, ["doc_id", "fp1", "fp2"]).select("key", "cid", "n", F.col("grams").alias("values")), "sets")
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / elements)).cast("long")
    large = stored(wanted.groupBy("key").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    n_large = large.count()
    # as each has a block of sets at least, there are few large families
    sent = (lambda df: F.broadcast(df)) if n_large * _LEADERS <= _MOST_SENT // 8 else (lambda df: df)
    zero, side = F.lit(0).cast("long"), lambda n: F.lit(n).alias("side")
    dealt = sets.join(sent(large), "key", "left").withColumn("i", F.when(F.col("blocks").isNull(), zero).otherwise(F.pmod(F.xxhash64("cid"), F.col("blocks"))))
    own = (F.col("cid"), F.col("n"), F.col("cid").alias("root"), F.col("values"))
    rows = dealt.select("key", "i", zero.alias("j"), side(1), *own)
    if n_large:
        drawn = F.array_distinct(F.array(*(F.min_by("cid", F.xxhash64("cid", F.lit(i))) for i in range(_LEADERS))))
        heads = wanted.join(sent(large), "key").groupBy("key", "blocks").agg(drawn.alias("heads")).select("blocks", F.explode("heads").alias("cid"))
        heads = sets.join(sent(stored(heads, "heads")), "cid")
        rows = rows.unionByName(heads.select("key", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("i"), zero.alias("j"), side(0), *own))
    links = stored(_met(rows, percent, exact=True, within=True), "links")
    if n_large:
        # a family in one block is done; in others what the leaders left apart meets in pairs of blocks
        placed = _rooted(sets.join(sent(large.select("key")), "key"), components(links), "cid", "root")
        links = links.union(stored(_across(placed.select("key", "cid", "n", "root", "values"), percent, True, block, elements), "more"))
    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, block: int = _BLOCK, elements: int = _BLOCK_ELEMENTS) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Takes ``docs(doc_id, text, ...)``; other columns are ignored. Returns one row for
    each input row: doc_id, n_shingles, component_id (smallest doc_id reachable over
    links), kept (it is that smallest), group_hash (least fingerprint of the group) and text_hash; by the last two, groups
    and rows of a repeated doc_id are told apart.
    With 32 bands of 5 rows, a pair at 0.8 shares no band with probability below 1e-5, and
    has signatures too far apart with probability below 1e-4, before links over third documents.

    Null or blank texts have an empty set and no links. Rows that repeat a doc_id
    are judged each by its own set: different texts under one doc_id are not linked by it. A null doc_id has no links,
    a null component_id, and is kept. Very long texts are read whole. An empty table gives an empty result.

    Rows with equal sets are one class before any pairing. In a bucket of a band, two leaders meet all members, and
    then what is still in different families meets in blocks, on signatures. In a family, blocks of at most about ``block``
    sets or ``elements`` shingles are compared in full; families in several blocks have leaders, and
    then what is still apart meets in pairs of blocks. Leaders save work and decide nothing; at
    worst the work is quadratic in a bucket or family whose members stay apart, but never the rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = stored(
        base.mapInArrow(lambda it: _signed(it, shingle, bands, rows), "doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, bands array<long>, slots array<long>"), "signed"
    )
    same = ["fp1", "fp2", "n_shingles"]
    middle = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min_by(F.struct("bands", "slots"), "doc_id").alias("x"), F.min("doc_id").alias("rep"))
    # a class has a number of its own, as one doc_id may stand for several
    classes = stored(middle.select(*same, "rep", "x.bands", "x.slots", F.monotonically_increasing_id().alias("cid")), "classes")
    families = _families(classes, percent, max(_SLOTS, bands * rows))
    roots = components(_linked(families, classes, base.select("doc_id", "text"), shingle, percent, block, elements))

    grouped = roots.select(F.col("node").alias("cid"), "root").join(classes.select("cid", "rep", "fp1"), "cid")
    least = grouped.groupBy("root").agg(F.min("rep").alias("least"), F.min("fp1").alias("group"))
    found = stored(grouped.join(least, "root").select("cid", "least", "group"), "found")
    known = classes.select(*same, "cid", "rep").join(found, "cid", "left").select(*same, F.coalesce("least", "rep").alias("known"), F.coalesce("group", "fp1").alias("group_hash"))
    out = signed.select("doc_id", "text_hash", *same).join(known, same, "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("known", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "group_hash", "text_hash")


def _rooted(df: DataFrame, roots: DataFrame, column: str, out: str) -> DataFrame:
    known = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return df.join(known, column, "left").withColumn(out, F.coalesce("_root", column)).drop("_root")

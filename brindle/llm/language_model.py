"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of runs of up to ``order`` words are quantised on a logarithmic scale. The
filter holds an n-gram once for every level up to its own; its count is read by probing
level after level until one is missing. Each text is scored by smoothed probabilities
that take all their counts from the filter.

Texts are cut into blocks of a bounded number of characters. A block sends its
sorted hashes of n-grams, cut by hash range into cells, and gets the corpus counts of words
and the filter's levels of all back in the same order; so only a block's distinct n-grams
travel, and a cell's part of the filter never leaves its task. Of each token only its levels are kept then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._store import released, stored
from brindle.llm._words import _GOLDEN, Words, mix, slices

_PROBES = 3
_CLASSES = 24
# a class's tokens by the ratio of left-out pair to word probability: 32 bins for each doubling, and one for no pair
_PER_DOUBLING, _DOUBLINGS = 32, 64
_BINS = 2 * _PER_DOUBLING * _DOUBLINGS + 2
# the salt of words leaves the top bits as they are: they name the cell
_WORD_SALT, _PAIR_SALT = np.uint64(0x4C957F2D), np.uint64(0x14057B7EF767814F)
_ENDS = 255  # the level of a text's start and end, whose count is exact
_END = np.uint64(0x2545F4914F6CDD1D)


def level_floors(base: float = 1.15, most: float = 1e12) -> np.ndarray:
    """Least count of each level: consecutive whole numbers first, then powers of ``base``."""
    return np.unique(np.floor(base ** np.arange(0, np.log(most) / np.log(base))).astype(np.int64))


_FLOORS = level_floors()
#: What a count at each level is taken for: the middle of the level.
_MIDDLES = np.concatenate([[0.0], (_FLOORS[:-1] + _FLOORS[1:] - 1) / 2, [float(_FLOORS[-1])]])


class FrequencyFilter:
    """Bits in cells; a key's cell is given by its top bits, so that cells are filled apart from each other."""

    def __init__(self, bits: np.ndarray, cells: int):
        self.bits, self.cells = bits, cells
        self.width = bits.size * 8 // cells

    @staticmethod
    def spots(keys: np.ndarray, level: int, width: int) -> list[np.ndarray]:
        h = mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) % np.uint64(width) for i in range(_PROBES)]

    @staticmethod
    def fill(keys: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
        """The bytes of one cell with these keys in it."""
        bits = np.zeros(width, bool)
        levels = np.searchsorted(_FLOORS, counts, side="right")
        for level in range(1, int(levels.max(initial=0)) + 1):
            keys = keys[levels >= level]
            levels = levels[levels >= level]
            for spot in FrequencyFilter.spots(keys, level, width):
                bits[spot.astype(np.int64)] = True
        return np.packbits(bits, bitorder="little")

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key by repeated probes; never less than the level it was put in at."""
        return _MIDDLES[self.levels(keys)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        level_of = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        cell = cell_of(keys, self.cells).astype(np.int64) * self.width
        level = 0
        while len(alive) and level < len(_FLOORS):
            level += 1
            there = np.ones(len(alive), bool)
            for spot in self.spots(keys[alive], level, self.width):
                at = cell[alive] + spot.astype(np.int64)
                there &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive = alive[there]
            level_of[alive] = level
        return level_of


def filter_bits(tokens: int) -> int:
    """8 to 16 bits for each training token, at any size."""
    return 1 << int(np.ceil(np.log2(max(1 << 16, 8 * tokens))))


def cell_of(keys: np.ndarray, cells: int) -> np.ndarray:
    return keys >> np.uint64(65 - cells.bit_length()) if cells > 1 else np.zeros(len(keys), np.uint64)


def gram_keys(own: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Of each token, keys of the runs of 2 to ``order`` tokens that end with it; a text begins with zeros."""
    out, before = [], own
    for _ in range(2, order + 1):
        before = np.concatenate([np.zeros(min(1, len(own)), np.uint64), before[:-1]])
        before[first] = 0
        out.append(mix(before * _GOLDEN + mix(own ^ _PAIR_SALT)))
        before = out[-1]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, held) to blocks: ids, held flags, word offsets, codes into the sorted vocabulary, vocabulary."""
    for batch in batches:
        ids, held = batch.column(0).to_pylist(), np.array(batch.column(2).to_pylist(), bool)
        for a, b, texts in slices(batch, 1, chars):
            words = Words(texts)
            vocabulary, codes = np.unique(words.hashes(), return_inverse=True)
            sizes = np.diff(words.offsets)
            trained = int((sizes[~held[a:b]] + 1).sum())
            parts = (pd.Series(ids[a:b], dtype="Int64").isna().to_numpy(), pd.Series(ids[a:b], dtype="Int64").fillna(0).to_numpy(np.int64), held[a:b], words.offsets, codes.astype(np.uint32), vocabulary)
            yield pa.RecordBatch.from_arrays(
                [pa.array([trained]), pa.array([int((~held[a:b]).sum())]), *(pa.array([p.tobytes()]) for p in parts)],
                names=["trained", "train_docs", "nulls", "ids", "held", "offsets", "codes", "vocabulary"],
            )


_BLOCK = "trained long, train_docs long, nulls binary, ids binary, held binary, offsets binary, codes binary, vocabulary binary"


class _Block:
    def __init__(self, row: dict):
        self.nulls, self.ids, self.held = np.frombuffer(row["nulls"], bool), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["held"], bool)
        self.offsets, self.codes = np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["codes"], np.uint32).astype(np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)

        self.sizes = np.diff(self.offsets)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token and each text's end: the text, its hash, and whether it is no end; and the texts' first tokens."""
        text = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        last = np.cumsum(self.sizes + 1) - 1
        inner = np.ones(len(text), bool)
        inner[last] = False
        own = np.empty(len(text), np.uint64)
        own[inner], own[last] = self.vocabulary[self.codes], _END
        return text, own, inner, last - self.sizes


def _requests(batches: Iterator[pa.RecordBatch], cells: int, order: int) -> Iterator[pa.RecordBatch]:
    """Each block's distinct words and longer n-grams, with their counts in training texts, cut by cell."""
    for batch in batches:
        for row in batch.to_pylist():
            block = _Block(row)
            text, own, _, first = block.tokens()
            words = np.bincount(block.codes, np.repeat(~block.held, block.sizes), len(block.vocabulary)).astype(np.int64)
            wanted, trained = [(block.vocabulary, words)], ~block.held[text]
            for keys in gram_keys(own, first, order):
                keys, back = np.unique(_clipped(keys, cells), return_inverse=True)
                wanted.append((keys, np.bincount(back, trained, len(keys)).astype(np.int64)))
            out = []
            for kind, (keys, counts) in enumerate(wanted):
                at = np.searchsorted(cell_of(keys, cells), np.arange(cells + 1, dtype=np.uint64))
                # of a longer n-gram's key, 32 bits below those that name the cell are enough for a filter
                low = (keys << np.uint64(cells.bit_length() - 1) >> np.uint64(32)).astype(np.uint32) if kind else keys
                for c in np.flatnonzero(np.diff(at)).tolist():
                    part = counts[at[c] : at[c + 1]]
                    tight = part.astype(np.uint8 if part.max() < 256 else np.uint32 if part.max() < 1 << 32 else np.uint64)
                    out.append((c, kind, row["block"], low[at[c] : at[c + 1]].tobytes(), tight.itemsize, tight.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()))],
                names=["cell", "kind", "block", "keys", "width", "counts"],
            )


def _unpacked(row, cells: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(row.counts, f"u{row.width}").astype(np.int64)
    if row.kind == 0:
        return np.frombuffer(row.keys, np.uint64), counts
    shift = cells.bit_length() - 1
    low = np.frombuffer(row.keys, np.uint32).astype(np.uint64) << np.uint64(32) >> np.uint64(shift)
    return low | (np.uint64(row.cell) << np.uint64(64 - shift) if shift else np.uint64(0)), counts


def _clipped(keys: np.ndarray, cells: int) -> np.ndarray:
    """Keys as they come back from a request: the bits that were not sent are zero."""
    low = np.uint64((1 << (32 - min(32, cells.bit_length() - 1))) - 1)
    return keys & ~low


def _answer(group: pd.DataFrame, cells: int, width: int, order: int) -> pd.DataFrame:
    """Add up one cell, fill its part of the filter, and answer each block that asked with counts of words and levels."""
    asked, distinct = [], 0
    for kind in range(order):
        rows = [r for r in group.itertuples(index=False) if r.kind == kind]
        if not rows:
            continue
        parts = [_unpacked(r, cells) for r in rows]
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        total = np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)
        distinct += int((total > 0).sum()) if kind == 0 else 0
        # the salt keeps words apart from longer n-grams, whose keys are their own
        asked.append((kind, rows, [len(k) for k, _ in parts], keys ^ _WORD_SALT if kind == 0 else keys, total, back))
    cell = int(group["cell"].iloc[0])
    bits = FrequencyFilter.fill(np.concatenate([k[t > 0] for _, _, _, k, t, _ in asked]), np.concatenate([t[t > 0] for *_, t, _ in asked]), width)
    out = [(-1, cell, 0, 0, b"", b"", distinct)]
    for kind, rows, sizes, keys, total, back in asked:
        levels, at = FrequencyFilter(bits, 1).levels(keys).astype(np.uint8), 0
        for r, size in zip(rows, sizes):
            mine = back[at : at + size]
            at += size
            part = total[mine] if kind == 0 else np.zeros(1, np.int64)
            tight = part.astype(np.uint8 if part.max() < 256 else np.uint32 if part.max() < 1 << 32 else np.uint64)
            out.append((int(r.block), cell, kind, tight.itemsize, tight.tobytes() if kind == 0 else b"", levels[mine].tobytes(), 0))
    return pd.DataFrame(out, columns=["block", "cell", "kind", "width", "data", "levels", "known"])


_READ = "nulls binary, ids binary, held binary, sizes binary, known binary, base binary, levels binary"


def _read(left: pd.DataFrame, right: pd.DataFrame, cells: int, totals: tuple[int, int, int], order: int) -> pd.DataFrame:
    """A block with the answers of all cells: exact sums of its texts, and the levels of each token's word and longer n-grams."""
    mine, (tokens, types, ends), out = right.sort_values(["kind", "cell"]), totals, []
    whole = tokens + types + 1
    for row in left.to_dict("records"):
        block = _Block(row)
        text, own, inner, first = block.tokens()
        words = mine[mine["kind"] == 0]
        counts = np.concatenate([np.frombuffer(d, f"u{w}").astype(np.int64) for d, w in zip(words["data"], words["width"])] or [np.empty(0, np.int64)])
        text_of, n = np.repeat(np.arange(len(block.sizes)), block.sizes), len(block.sizes)
        base = np.bincount(text_of, np.log10((counts + 1) / whole)[block.codes], n) + np.log10((ends + 1) / whole)
        known = np.bincount(text_of, counts[block.codes] > 0, n).astype(np.int64) + int(ends > 0)
        levels = np.full((order, len(text)), _ENDS, np.uint8)
        levels[0, inner] = np.frombuffer(b"".join(words["levels"]), np.uint8)[block.codes]
        for kind, keys in enumerate(gram_keys(own, first, order), 1):
            back = np.unique(_clipped(keys, cells), return_inverse=True)[1]
            levels[kind] = np.frombuffer(b"".join(mine.loc[mine["kind"] == kind, "levels"]), np.uint8)[back]
        out.append((row["nulls"], row["ids"], row["held"], block.sizes.tobytes(), known.tobytes(), base.tobytes(), levels.tobytes()))
    return pd.DataFrame(out, columns=["nulls", "ids", "held", "sizes", "known", "base", "levels"])


class Levels:
    """Of one block's tokens: the text, whether it is learned from, and the counts of its n-grams and of their contexts."""

    def __init__(self, row: dict, totals: tuple[int, int, int], order: int):
        tokens, types, ends = totals
        self.nulls, self.ids, self.held = np.frombuffer(row["nulls"], bool), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["held"], bool)
        self.sizes, self.known, self.base = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["known"], np.int64), np.frombuffer(row["base"], float)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        first = np.cumsum(self.sizes + 1) - self.sizes - 1
        value = np.zeros(256)
        value[: len(_MIDDLES)], value[_ENDS] = _MIDDLES, float(ends)
        counts = value[np.frombuffer(row["levels"], np.uint8).reshape(order, -1)]
        self.single = np.minimum(1.0, (counts[0] + 1) / (tokens + types + 1))
        # the context of a token's n-gram is the n-gram of the token before it that is one shorter
        self.grams = [(c, np.concatenate([[float(ends)], lower[:-1]])) for lower, c in zip(counts[:-1], counts[1:])]
        for _, context in self.grams:
            context[first] = float(ends)


def _class(context: np.ndarray) -> np.ndarray:
    return np.where(context < 1, 0, np.minimum(_CLASSES - 1, 1 + np.log2(np.maximum(context, 1)).astype(np.int64)))


def interpolated(single: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], weights: list[np.ndarray], left_out: int = 0) -> np.ndarray:
    """Probabilities of tokens: word, pair and longer estimates, each mixed in with the weight of its context's class.

    With ``left_out`` 1 a token does not count among its own n-grams.
    """
    p = single
    for (count, context), weight in zip(grams, weights):
        w = weight[_class(context)]
        p = (1 - w) * p + w * np.clip((count - left_out) / np.maximum(context - left_out, 1), 0, 1)
    return p


def ratio_bins(lower: np.ndarray, count: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Of training tokens, each left out of its own counts: the class, and in it the bin of the ratio to the probability by shorter n-grams."""
    rest = np.clip((count - 1) / np.maximum(context - 1, 1), 0, 1)
    some = rest > 0
    bins = np.zeros(len(rest), np.int64)
    place = np.rint(np.log2(rest[some] / lower[some]) * _PER_DOUBLING).astype(np.int64)
    bins[some] = 1 + np.clip(place + _PER_DOUBLING * _DOUBLINGS, 0, _BINS - 2)
    return _class(context) * _BINS + bins


def fit_weights(bins: np.ndarray, tokens: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights by expectation maximisation from numbers of tokens by ``ratio_bins``: a token's share depends on its ratio only."""
    cls, place = bins // _BINS, bins % _BINS
    ratio = np.where(place > 0, 2.0 ** ((place - 1) / _PER_DOUBLING - _DOUBLINGS), 0.0)
    weights = np.full(_CLASSES, 0.3)
    total = np.bincount(cls, tokens, _CLASSES)
    for _ in range(rounds):
        w = weights[cls]
        share = w * ratio / ((1 - w) + w * ratio)
        weights = (np.bincount(cls, share * tokens, _CLASSES) + 0.1) / (total + 10)
    weights[0] = 0.0
    return weights


def score_texts(docs: DataFrame, folds: int = 7, held_fold: int = 2, order: int = 2, block_chars: int = 1 << 22) -> DataFrame:
    """Base-10 log-probabilities of whole texts under a smoothed model of the corpus, with n-grams of up to ``order`` words.

    Takes ``docs(doc_id, text, ...)``. Texts whose crc32(doc_id as text) mod ``folds`` is ``held_fold`` are held
    out; all others are learned from. Tokens are words with A-Z lowered and one end for each text. Returns a row for
    each input row: doc_id, held_out, n_tokens, n_known (tokens that occur in training), train_tokens,
    base_score (add-one word model, from exact counts) and score (the model, from the filter). Null and blank
    texts are their end alone. A null doc_id is learned from. Repeated rows count each time and score alike. An
    empty table gives an empty result. A text longer than ``block_chars`` is read whole, as a block of its own.

    The filter has 8 to 16 bits for each training token and order above the first at any size: it is held by cells, each in one
    task, and probed there. Probabilities never exceed one, however full it is. The weights are fitted on all training
    tokens, each left out of its own counts, whose ratios to the probability by shorter n-grams are counted in bins of 2 %,
    one order after the other. Words are told apart by 64-bit hashes, longer n-grams by 32 bits and the cell.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    fold = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(folds))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold == held_fold, F.lit(False)).alias("held"))
    cut = given.mapInArrow(lambda it: _blocks(it, block_chars), _BLOCK).withColumn("block", F.monotonically_increasing_id())
    blocks = stored(cut, "lm-blocks")
    n_blocks, tokens, ends = blocks.agg(F.count("*"), F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("train_docs"), F.lit(0))).first()
    cells = 1 << max(4, int(np.ceil(np.log2(max(1, n_blocks * max(1, order - 1)) / 2))))
    width = max(64, filter_bits(tokens * max(1, order - 1)) // cells)
    asked = blocks.mapInArrow(lambda it: _requests(it, cells, order), "cell int, kind int, block long, keys binary, width int, counts binary")
    schema = "block long, cell int, kind int, width int, data binary, levels binary, known long"
    answers = stored(asked.repartition(cells, "cell").groupBy("cell").applyInPandas(lambda g: _answer(g, cells, width, order), schema), "lm-counts")
    types = int(ends > 0) + answers.where("block = -1").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    totals = (int(tokens), int(types), int(ends))
    met = blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInPandas(lambda x, y: _read(x, y, cells, totals, order), _READ)
    read = stored(met, "lm-read")
    released(blocks, answers)

    weights: list[np.ndarray] = []
    for kind in range(order - 1):
        lower = list(weights)

        def binned(batches: Iterator[pa.RecordBatch], kind: int = kind, lower: list[np.ndarray] = lower) -> Iterator[pa.RecordBatch]:
            total = np.zeros(_CLASSES * _BINS, np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    own = Levels(row, totals, order)
                    train = ~own.held[own.text]
                    grams = [(c[train], x[train]) for c, x in own.grams[: kind + 1]]
                    total += np.bincount(ratio_bins(interpolated(own.single[train], grams, lower, 1), *grams[kind]), minlength=len(total))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bin", "n"])

        seen = read.mapInArrow(binned, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
        weights.append(fit_weights(np.array([r["bin"] for r in seen], np.int64), np.array([r["n"] for r in seen], float)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Levels(row, totals, order)
                score = np.bincount(own.text, np.log10(interpolated(own.single, own.grams, weights)), len(own.sizes))
                columns = [pa.array(own.ids, mask=own.nulls), pa.array(own.held), pa.array(own.sizes + 1), pa.array(own.known), pa.array(np.full(len(own.sizes), totals[0], np.int64)), pa.array(own.base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return read.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

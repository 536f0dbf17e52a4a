"""Vectorised word splitting and hashing over batches of whole texts.

A word is a maximal run of characters outside the space and U+0009..U+000D.
In UTF-8 those separators are single bytes, so whole batches are cut with
array operations instead of a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for i, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


class Words:
    """Words of a batch: byte bounds, hashes, and each text's range of words."""

    def __init__(self, texts: list[str | None], lower: bool = True):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = b" ".join(parts) + b" "
        buf = np.frombuffer(self.raw, np.uint8)
        self.bytes = _LOWER[buf] if lower else buf
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.doc_ends = np.cumsum(sizes + 1)
        space = _SPACE[buf]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(space & ~before)
        stops = np.searchsorted(self.starts, self.doc_ends)
        self.offsets = np.concatenate([[0], stops]).astype(np.int64)
        self.space = space

    def hashes(self) -> np.ndarray:
        n = len(self.bytes)
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        own = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(own + (self.ends - self.starts).astype(np.uint64) * _GOLDEN)

    def texts(self) -> list[bytes]:
        low = self.bytes.tobytes()
        return [low[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text; the whole text if it is shorter."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    out = words[: n - width + 1].copy()
    for i in range(1, width):
        out = mix(out * _GOLDEN + words[i : n - width + 1 + i])
    return out


def chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, so that arrays stay in cache."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str | None]]]:
    """Ranges of rows with about ``most`` bytes of text, and their texts: only one range is ever turned into a list."""
    text = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(text):
        done = int(ends[begin - 1]) if begin else 0
        end = min(len(text), int(np.searchsorted(ends, done + most)) + 1)
        yield begin, end, text.slice(begin, end - begin).to_pylist()
        begin = end


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows again, cut only between groups of the first ``keys`` columns, with the bounds of the groups in each batch."""
    held: list[pa.RecordBatch] = []

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        named = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        return np.flatnonzero(np.any([x[1:] != x[:-1] for x in named], axis=0)) + 1

    def out() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return whole, np.concatenate([[0], changes(whole), [whole.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys)):
            yield out()
            held = []
        cuts = changes(batch)
        if len(cuts):
            last = int(cuts[-1])
            held.append(batch.slice(0, last))
            yield out()
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield out()

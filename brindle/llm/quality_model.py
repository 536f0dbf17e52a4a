"""Quality classifier: a generalised additive model with pairwise interactions.

The score is the sum of one lookup table per text feature and one per chosen
pair of features. Tables are learned by cyclic boosting: the features take
turns, and at each turn a tree of a few leaves over the feature's bins is fitted
to the current residuals and added to the feature's table. Pairs follow, chosen
by how much of the residual a tree with four leaves over both features explains.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._store import drawn, stored
from brindle.llm._words import Words, slices

FEATURES = (
    "log_words", "word_length", "symbols", "bangs", "pipes", "upper", "digits", "commas",
    "other", "lines", "same_next", "distinct", "most_frequent", "long_words",
)
_CLASSES = np.zeros((256, 8), np.float32)
for _i, _chars in enumerate((b"#*$%&<>", b"!?", b"|", bytes(range(65, 91)), b"0123456789", b",.;:", b"@/\\_=+~^{}[]\"'", b"\n")):
    _CLASSES[list(_chars), _i] = 1


def text_features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each whole text; null and blank texts have zeros."""
    words = Words(texts, lower=False)
    hashes, at = words.hashes(), words.offsets
    n = np.diff(at)
    begins = np.concatenate([[0], words.doc_ends[:-1]])
    raw = words.bytes
    kinds = np.stack([np.add.reduceat(_CLASSES[raw, c], begins) for c in range(_CLASSES.shape[1])], axis=1)
    sizes = words.ends - words.starts
    total = np.concatenate([[0], np.cumsum(sizes)])
    chars = (total[at[1:]] - total[at[:-1]]).astype(float)
    long_words = np.concatenate([[0], np.cumsum(sizes > 18)])
    same = np.concatenate([[0], np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]]))]) if len(hashes) else np.zeros(1)
    distinct, top = np.zeros(len(texts)), np.zeros(len(texts))
    for i in np.flatnonzero(n):
        c = np.unique(hashes[at[i] : at[i + 1]], return_counts=True)[1]
        distinct[i], top[i] = len(c), c.max()
    per, per_char = np.maximum(n, 1), np.maximum(chars, 1)
    out = np.empty((len(texts), len(FEATURES)))
    out[:, 0] = np.log1p(n)
    out[:, 1] = chars / per
    out[:, 2:5] = kinds[:, :3] / per[:, None]
    out[:, 5:7] = kinds[:, 3:5] / per_char[:, None]
    out[:, 7:9] = kinds[:, 5:7] / per[:, None]
    out[:, 9] = (kinds[:, 7] + 1) / per * (n > 0)
    inner = np.maximum(same[at[1:]] - same[np.minimum(at[:-1] + 1, len(same) - 1)], 0)
    out[:, 10], out[:, 11], out[:, 12] = inner / per, distinct / per, top / per
    out[:, 13] = (long_words[at[1:]] - long_words[at[:-1]]) / per
    return out


@dataclass
class AdditiveModel:
    """Bin bounds by feature, a table by feature, and a table by pair of features."""

    base: float
    bounds: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(self.bounds)], axis=1) if self.bounds else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for i, t in enumerate(self.tables):
            z += t[b[:, i]]
        for (i, j), t in self.pairs.items():
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values by bin of a regression tree over ordered bins, split greedily; Newton steps as leaf values."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            at = np.arange(a + 1, b)
            at = at[(ch[at] - ch[a] >= least) & (ch[b] - ch[at] >= least)]
            if len(at):
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (a, int(at[k]), b))
        if best[1] is None:
            break
        a, m, b = best[1]
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each axis: its gain and its values by cell."""
    cg, ch = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return 0.0, np.zeros_like(g)
    gain, values = 0.0, []
    for rows, cols in itertools.product((0, 1), (0, 1)):
        part = []
        for c in (cg, ch):
            whole_rows, whole_cols, whole = c[i, -1], c[-1, j], c[-1, -1]
            low = c[i, j]
            part.append([[low, whole_rows - low], [whole_cols - low, whole - whole_rows - whole_cols + low]][rows][cols])
        gain = gain + part[0] ** 2 / (part[1] + 1)
        values.append(part[0] / (part[1] + 1))
    gain = gain - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    a, b = np.unravel_index(np.argmax(gain), gain.shape)
    out = np.empty_like(g)
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = (v[a, b] for v in values)
    return float(gain[a, b]), out


def fit(x: np.ndarray, y: np.ndarray, most_bins: int = 48, rounds: int = 120, rate: float = 0.15, leaves: int = 3, n_pairs: int = 4, pair_rounds: int = 30, pair_bins: int = 12) -> AdditiveModel:
    prior = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2:
        return model
    for i in range(x.shape[1]):
        points = np.unique(np.concatenate([np.quantile(x[y == c, i], np.linspace(0, 1, most_bins // 2)) for c in (0, 1)]))
        model.bounds.append((points[1:] + points[:-1]) / 2)
    b = model.bins(x)
    model.tables = [np.zeros(len(c) + 1) for c in model.bounds]
    z = np.full(len(y), model.base)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-z))), np.maximum(p * (1 - p), 1e-6))
    for _ in range(rounds):
        for i, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, i], g, len(t)), np.bincount(b[:, i], h, len(t)), leaves, 0.5)
            t += step
            z += step[b[:, i]]
    grid = [np.minimum(np.arange(len(t)) * pair_bins // len(t), pair_bins - 1) for t in model.tables]

    def hist(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(grid[i][b[:, i]] * pair_bins + grid[j][b[:, j]], v, pair_bins**2).reshape(pair_bins, pair_bins)

    g, h = slopes()
    ranked = sorted(((_quadrants(hist(i, j, g), hist(i, j, h))[0], i, j) for i, j in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    chosen = {(i, j): np.zeros((pair_bins, pair_bins)) for _, i, j in ranked[:n_pairs]}
    for _ in range(pair_rounds):
        for (i, j), t in chosen.items():
            g, h = slopes()
            step = rate * _quadrants(hist(i, j, g), hist(i, j, h))[1]
            t += step
            z += step[grid[i][b[:, i]], grid[j][b[:, j]]]
    model.pairs = {(i, j): t[grid[i]][:, grid[j]] for (i, j), t in chosen.items()}
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, texts in slices(batch, 1):
            x = text_features(texts)
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, end - begin), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), flat), batch.column(2).slice(begin, end - begin)],
                names=["doc_id", "x", "quality"],
            )


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, cut: float = 0.3, learn_rows: int = 20_000) -> DataFrame:
    """Score each whole text by the chance that ``labels.quality`` is 1.

    Takes ``docs(doc_id, text, ...)`` and ``labels(doc_id, quality, ...)``. Rows whose
    crc32(doc_id as text) mod ``folds`` is ``held_fold`` are held out of training; of the others at
    most ``learn_rows``, least by a hash of doc_id, are learned from. Only the text is an input of a score.
    Returns a row for each input row: doc_id, held_out, score, predicted. Null and blank texts are
    scored from zero features. Null labels and null doc_ids teach nothing, of clashing labels the smaller holds; a null doc_id is not held
    out. With labels of one class only, all scores are the smoothed prior. Repeated rows are scored
    alike. An empty table gives an empty result.
    """
    fold = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(folds))
    marked = labels.where("quality is not null and doc_id is not null").where(fold != held_fold).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked = stored(drawn(marked, learn_rows, "doc_id"), "labelled")
    taught = docs.select("doc_id", "text").join(picked, "doc_id").select("doc_id", "text", "quality")
    rows = taught.mapInArrow(_featured, "doc_id long, x array<double>, quality int").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * learn_rows).toPandas()
    model = fit(np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES)), rows["quality"].to_numpy(int))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.score(text_features(texts)) for _, _, texts in slices(batch, 1)]
            s = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold == held_fold, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held).mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")

"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of the whole text. Each is cut into at most ``BINS`` bins at quantiles of the
training sample. Boosting goes round the features: in each turn a shallow regression tree (at most ``LEAVES``
leaves) is fitted to the logistic loss on one feature's bins and added to that feature's look-up table. Then the
pairs that still explain most of the residual get tables of their own, boosted by trees with one cut per axis.
A score adds up one table cell for each feature and pair.

The fit reads at most ``SAMPLE`` labelled rows, chosen by hash of the id among those that may be learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rtlake.llm.common import held_out, labelled_sample, table
from rtlake.llm.texts import map_texts

FEATURES = (
    "chars", "words", "word_length", "long_words", "distinct_words", "upper", "upper_words", "digits", "blanks", "punctuation",
    "symbols", "bangs", "stops", "lines", "line_length", "repeated_lines", "short_lines", "word_repeats", "mixed_ends", "high_bytes",
)
SAMPLE, BINS, LEAVES = 20_000, 32, 4
ROUNDS, PAIR_ROUNDS, PAIRS, PAIR_BINS, RATE = 150, 60, 10, 8, 0.1
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n\v\f", b",;:'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~", b"!?", b"."), 1):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _k
_CLASS[128:] = 8


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for a whole text; null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    by = np.bincount(_CLASS[raw], minlength=9)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    w, k = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = sum(not x[-1].isalnum() for x in words)
    repeats = sum(a == b for a, b in zip(words, words[2:], strict=False))
    uppers = sum(map(str.isupper, words)) if by[1] else 0
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean() if len(words) else 0.0, (lengths > 20).sum() / w, len(set(words)) / w, by[1] / n, uppers / w, by[2] / n, by[3] / n, by[4] / n,
        by[5] / n, by[6] / n, by[7] / w, np.log1p(len(lines)), np.log1p(w / k), 1 - len(set(lines)) / k, sum(len(x) < 20 for x in lines) / k, repeats / w, ends / w, by[8] / n,
    ]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], 1).astype(np.int64) if len(x) else np.zeros((0, len(cuts)), np.int64)


def tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values over ordered bins: the best cuts one after another, with sums of gradients and curvatures by bin."""
    parts = [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1)
    while len(parts) < leaves:
        found = [(worth(a, c) + worth(c, b) - worth(a, b), a, c, b) for a, b in parts for c in range(a + 1, b) if min(ch[c] - ch[a], ch[b] - ch[c]) > 0.5]
        if not found or max(found)[0] < 1e-6:
            break
        _, a, c, b = max(found)
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on each axis of a square of bins."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    gains, out = np.zeros((len(g) - 1, len(g) - 1)), np.zeros_like(g)
    quads = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    for a, b in zip(quads(cg), quads(ch), strict=True):
        gains += a**2 / (b + 1)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return float(gains[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)), out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """The model: bias, cuts, a table for each feature, and pairs with their coarser cuts and tables."""
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    at = lambda bins: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    cuts, coarse = at(BINS), at(PAIR_BINS)
    model = {"bias": bias, "cuts": cuts, "coarse": coarse, "tables": [np.zeros(len(c) + 1) for c in cuts], "pairs": []}
    if not 0 < y.sum() < len(y):
        return model
    bins, z = binned(x, cuts), np.full(len(y), bias)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-z))), p * (1 - p))
    for _ in range(ROUNDS):
        for j, t in enumerate(model["tables"]):
            g, h = slopes()
            step = RATE * tree(np.bincount(bins[:, j], g, len(t)), np.bincount(bins[:, j], h, len(t)), LEAVES)
            t += step
            z += step[bins[:, j]]
    low = binned(x, coarse)
    cell = lambda i, j: low[:, i] * PAIR_BINS + low[:, j]
    square = lambda i, j, v: np.bincount(cell(i, j), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    best = sorted(combinations(range(len(FEATURES)), 2), key=lambda p: -pair_tree(square(*p, g), square(*p, h))[0])[:PAIRS]
    model["pairs"] = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for i, j in best]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model["pairs"]:
            g, h = slopes()
            step = RATE * pair_tree(square(i, j, g), square(i, j, h))[1]
            t += step
            z += step.ravel()[cell(i, j)]
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), model["bias"])
    bins, low = binned(x, model["cuts"]), binned(x, model["coarse"])
    for j, t in enumerate(model["tables"]):
        z += t[bins[:, j]]
    for i, j, t in model["pairs"]:
        z += t[low[:, i], low[:, j]]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict:
    """Fits on at most ``sample`` labelled rows of ``docs``; only their features reach the driver."""
    chosen = F.broadcast(labelled_sample(labels, label, sample))

    def body(parts: Iterator) -> Iterator[dict]:
        for p in parts:
            yield {"doc_id": p.column("doc_id"), "label": p.column("label"), "x": [features(t) for t in p.column("text").to_pylist()]}

    found = map_texts(docs.select("doc_id", "text").join(chosen, "doc_id"), "doc_id long, label int, x array<double>", body).toArrow()
    rows = sorted(zip(found["doc_id"].to_pylist(), found["x"].to_pylist(), found["label"].to_pylist(), strict=True))
    return fit(np.array([x for _, x, _ in rows], np.float64).reshape(-1, len(FEATURES)), np.array([y for *_, y in rows], np.float64))


def score(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Null texts are scored as empty ones. Null id: hashed as the empty text. Repeated rows are scored alike.
    Only ``doc_id`` and ``text`` are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def body(parts: Iterator) -> Iterator[dict]:
        for p in parts:
            x = np.array([features(t) for t in p.column("text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield {"doc_id": p.column("doc_id"), "score": predict(shared.value, x)}

    scored = map_texts(docs.select("doc_id", "text"), "doc_id long, score double", body)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))

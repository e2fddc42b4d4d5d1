"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A text is lower-cased, all but letters and digits become blanks, and its characters (code points) give hashed n-grams
of ``ORDERS``; each counts once. Feature j is worth r_j, its log-count ratio between the labels in the training
sample, and a logistic regression with an L2 penalty is fitted on the scaled features. A score is one look-up
table added up over the distinct n-grams of the whole text.

The fit reads at most ``SAMPLE`` labelled rows, chosen by hash of the id among those that may be learnt from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rtlake.llm.common import held_out, labelled_sample, table
from rtlake.llm.texts import map_texts

ORDERS, BITS = (6, 9), 20
#: Bound on labelled rows of the fit; smallest document frequency of a feature, and standard errors that its ratio
#: must be from 0; L2 penalty; rounds.
SAMPLE, LEAST, SURE, PENALTY, ROUNDS = 4_000, 3, 2.5, 1.0, 120
_BLANK = re.compile(r"[\W_]+")


def _points(text: str | None) -> np.ndarray:
    """Code points of a text, lower-cased, with one blank for all else than letters and digits, and one at each end."""
    return np.frombuffer(f" {_BLANK.sub(' ', (text or '').lower())} ".encode("utf-32-le", "replace"), np.uint32)


def _hashes(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, its length and the hashed n-grams from each place of ``points``; each order has ``2**BITS`` codes of its own."""
    raw = points.astype(np.uint64) + np.uint64(1)
    for k, n in enumerate(ORDERS):
        h = np.zeros(max(0, len(raw) - n + 1), np.uint64)
        for i in range(n if len(h) else 0):
            h = h * np.uint64(0x100000001B3) + raw[i : len(raw) - n + 1 + i]
        yield n, ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32) + (k << BITS)


def codes(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams (int32, any order) of a whole text."""
    return np.unique(np.concatenate([h for _, h in _hashes(_points(text))]))


def margins(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """For each text, the weights of its distinct n-grams added up. Only n-grams that weigh anything are told apart."""
    points = [_points(t) for t in texts]
    ends = np.cumsum([len(p) for p in points])
    found, some = [], weights != 0
    for n, h in _hashes(np.concatenate(points) if points else np.zeros(0, np.uint32)):
        at = np.flatnonzero(some[h])
        text = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[text]  # not across two texts
        found.append(text[inside].astype(np.int64) << 32 | h[at[inside]])
    each = np.unique(np.concatenate(found))
    return np.bincount(each >> 32, weights[each & 0xFFFFFFFF].astype(np.float64), len(texts))


def fit(rows: list[tuple[int, np.ndarray]]) -> tuple[float, np.ndarray]:
    """(label, codes) rows -> bias and a weight for each code. Without both labels: the smoothed share of label 1 alone."""
    y = np.array([label for label, _ in rows], np.float64)
    size = len(ORDERS) << BITS
    weights = np.zeros(size, np.float32)
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not 0 < y.sum() < len(y):
        return prior, weights
    seen = np.zeros((2, size), np.float32)
    for label, c in rows:
        seen[label, c] += 1
    ratio = np.log((seen[1] + 1) / (y.sum() + 2)) - np.log((seen[0] + 1) / (len(y) - y.sum() + 2))
    spread = np.sqrt(1 / (seen[1] + 1) + 1 / (seen[0] + 1))
    kept = np.flatnonzero((seen.sum(0) >= LEAST) & (np.abs(ratio) >= SURE * spread))
    place = np.full(size, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    cols = [place[c] for _, c in rows]
    cols = [c[c >= 0] for c in cols]
    ends = np.cumsum([len(c) for c in cols])
    flat, r = np.concatenate(cols), ratio[kept].astype(np.float64)
    starts = np.concatenate([[0], ends[:-1]])
    some = ends > starts

    def added(w: np.ndarray, b: float) -> np.ndarray:
        out = np.full(len(y), b)
        if some.any():
            out[some] += np.add.reduceat((w * r)[flat].astype(np.float32), starts[some], dtype=np.float64)
        return out

    # Full-batch accelerated gradient with a step from the curvature along the gradient: deterministic, no library.
    lengths = ends - starts
    w, b, mw, mb, vw, vb = np.zeros(len(kept)), prior, np.zeros(len(kept)), 0.0, np.zeros(len(kept)), 0.0
    for t in range(1, ROUNDS + 1):
        g = 1 / (1 + np.exp(-np.clip(added(w, b), -30, 30))) - y
        gw = np.bincount(flat, np.repeat(g.astype(np.float32), lengths), len(kept)) * r / len(y) + PENALTY * w / len(y)
        gb = g.mean()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        step = 0.05 / (1 - 0.9**t)
        w -= step * mw / (np.sqrt(vw / (1 - 0.99**t)) + 1e-8) * np.minimum(1, np.abs(r))
        b -= step * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights[kept] = w * r
    return float(b), weights


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[float, np.ndarray]:
    """Fits on at most ``sample`` labelled rows of ``docs``; what reaches the driver is bounded by them."""
    chosen = F.broadcast(labelled_sample(labels, label, sample))

    def body(parts: Iterator) -> Iterator[dict]:
        for p in parts:
            yield {"doc_id": p.column("doc_id"), "label": p.column("label"), "codes": [codes(t).tobytes() for t in p.column("text").to_pylist()]}

    found = map_texts(docs.select("doc_id", "text").join(chosen, "doc_id"), "doc_id long, label int, codes binary", body).toArrow()
    rows = sorted(zip(found["doc_id"].to_pylist(), found["label"].to_pylist(), found["codes"].to_pylist(), strict=True))
    return fit([(label, np.frombuffer(c, np.int32)) for _, label, c in rows])


def score(docs: DataFrame, model: tuple[float, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Null and empty texts get the score of an empty text (the bias alone, near the share of label 1). Null id:
    hashed as the empty text. Repeated rows are scored alike. Only ``doc_id`` and ``text`` are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def body(parts: Iterator) -> Iterator[dict]:
        bias, weights = shared.value
        for p in parts:
            z = bias + margins(p.column("text").to_pylist(), weights)
            yield {"doc_id": p.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(z, -500, 500)))}

    scored = map_texts(docs.select("doc_id", "text"), "doc_id long, score double", body)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))

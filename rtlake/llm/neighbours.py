"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into balanced parts, and a small network learns to tell
from a vector in which parts its neighbours lie. Every vector is indexed under its likeliest part. A query goes to its
likeliest parts until they hold ``MASS`` of the probability and enough candidates; there it meets all candidates in
blocks, and inner products in double precision rank them.

Blocks bound every task: a part of any size, also one full of equal vectors, is dealt out by hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rtlake.llm.common import cut, table

K, QUERY_EVERY = 20, 20
#: Rows a part aims at, bounds on parts (the lower one as far as a part has ``LEAST_ROWS``), sample rows a part and at most,
#: neighbours in the graph, slack of a part.
PART_ROWS, MOST_PARTS, LEAST_PARTS, LEAST_ROWS, SAMPLE_PER_PART, SAMPLE, DEGREE, SLACK = 2_000, 128, 8, 50, 120, 12_000, 10, 1.1
#: Hidden units, epochs, probability that the probed parts must hold, least parts probed.
HIDDEN, EPOCHS, MASS, LEAST_PROBES = 64, 40, 0.98, 2
#: Rows of a block of candidates and of a block of queries.
BLOCK, QUERY_BLOCK = 4_096, 1_024


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v array<double>) of the vectors that take part, stored; ``row`` tells rows that repeat an id apart.

    Left out: null ids and vectors, vectors with null or non-finite components, zero vectors, and vectors of another
    length than most have (of equally common lengths the larger counts).
    """
    whole = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    )
    length = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return cut(whole.filter(F.size("v") == (length["n"] if length else 0)).withColumn("row", F.monotonically_increasing_id()))


def graph(x: np.ndarray, degree: int) -> np.ndarray:
    """For each row the ``degree`` others with the largest inner product."""
    out = np.zeros((len(x), degree), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = SLACK) -> np.ndarray:
    """A part for each row: few graph edges between parts, none larger than ``slack`` times the mean.

    Starts from k-means with bounded clusters, then moves rows to the part of most of their neighbours while it has room.
    """
    rng, room = np.random.default_rng(7), int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(12):
        own = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        centres = np.stack([x[own == p].mean(0) if (own == p).any() else x[rng.integers(len(x))] for p in range(parts)])
    fit = x @ centres.T - 0.5 * (centres**2).sum(1)
    own, size = np.full(len(x), -1), np.zeros(parts, np.int64)
    for i in np.argsort(-fit.max(1), kind="stable"):
        for p in np.argsort(-fit[i], kind="stable"):
            if size[p] < room:
                own[i], size[p] = p, size[p] + 1
                break
    a, b = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    for _ in range(15):
        votes = np.bincount(np.concatenate([a, b]) * parts + own[np.concatenate([b, a])], minlength=len(x) * parts).reshape(len(x), parts)
        gain = votes.max(1) - votes[np.arange(len(x)), own]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            p = votes[i].argmax()
            if size[p] < room:
                size[own[i]] -= 1
                own[i], size[p], moved = p, size[p] + 1, moved + 1
        if not moved:
            break
    return own


def learn(x: np.ndarray, near: np.ndarray, own: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """A network with one hidden layer from a vector to the parts of its neighbours and itself."""
    rng, scale = np.random.default_rng(11), float(np.sqrt((x**2).mean())) or 1.0
    target = np.zeros((len(x), parts), np.float32)
    for j in range(near.shape[1]):
        np.add.at(target, (np.arange(len(x)), own[near[:, j]]), 1)
    target[np.arange(len(x)), own] += near.shape[1] / 2
    target /= target.sum(1, keepdims=True)
    x = (x / scale).astype(np.float32)
    weights = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    weights = [w.astype(np.float32) for w in weights]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i, t = order[at : at + 256], t + 1
            h = np.maximum(x[i] @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - target[i]) / len(i)
            dh = (d @ weights[2].T) * (h > 0)
            for w, g, mm, vv in zip(weights, (x[i].T @ dh, dh.sum(0), h.T @ d, d.sum(0)), m, v, strict=True):
                g = g + 1e-4 * w
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                w -= 0.01 * 0.93**epoch * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    return (np.float32(scale), *weights)


def probabilities(model: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    scale, w1, b1, w2, b2 = model
    z = np.maximum((x / scale).astype(np.float32) @ w1 + b1, 0) @ w2 + b2
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(vectors: DataFrame, rows: int, part_rows: int = PART_ROWS, sample: int = SAMPLE) -> tuple[int, tuple[np.ndarray, ...] | None]:
    """(parts, network) from a sample of ``vectors`` chosen by hash of the id; one part needs no network."""
    parts = min(MOST_PARTS, max(-(-rows // part_rows), min(LEAST_PARTS, rows // LEAST_ROWS)))
    wanted = min(sample, max(2_000, SAMPLE_PER_PART * parts))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).toArrow()
    if parts < 2 or len(chosen) < 4 * parts:
        return 1, None
    x = np.array(chosen["v"].combine_chunks().flatten()).reshape(len(chosen), -1)
    near = graph(x.astype(np.float32), min(DEGREE, len(x) - 1))
    return parts, learn(x, near, balanced_parts(x, near, parts), parts)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, part_rows: int = PART_ROWS, sample: int = SAMPLE, mass: float = MASS) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score.

    ``vectors`` and ``queries``: rows as ``usable`` gives them. A query's own row is no candidate; other rows with its
    id are, and each row is a query of its own, with ranks of its own. Ties go to the smaller id. Every part is searched where there are hardly more candidates than asked for.
    """
    spark, rows = vectors.sparkSession, vectors.count()
    parts, network = fit(vectors, rows, part_rows, sample)
    shared = spark.sparkContext.broadcast(network)

    def matrix(column: pa.Array) -> np.ndarray:
        return np.array(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"))
            own = probabilities(shared.value, x).argmax(1) if shared.value is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(own, pa.int32())], names=["row", "vec_id", "v", "part"])

    index = cut(vectors.select("row", "vec_id", "v").mapInArrow(place, "row long, vec_id long, v array<double>, part int"))
    held = np.zeros(parts, np.int64)
    for r in index.groupBy("part").count().collect():
        held[r["part"]] = r["count"]
    blocks = np.maximum(1, -(-held // BLOCK))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"))
            if shared.value is None:
                to = [[0]] * len(x)
            else:
                p = probabilities(shared.value, x)
                order = np.argsort(-p, axis=1, kind="stable")
                sums, counts = np.cumsum(np.take_along_axis(p, order, 1), 1), np.cumsum(held[order], 1)
                need = np.maximum((sums < mass).sum(1), (counts < 4 * k + 1).sum(1)) + 1
                to = [o[: min(parts, max(LEAST_PROBES, n))].tolist() for o, n in zip(order, need.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(to, pa.list_(pa.int32()))], names=["query", "query_id", "v", "parts"])

    routed = cut(queries.select("row", "vec_id", "v").mapInArrow(route, "query long, query_id long, v array<double>, parts array<int>").withColumn("part", F.explode("parts")).drop("parts"))
    asked = np.zeros(parts, np.int64)
    for r in routed.groupBy("part").count().collect():
        asked[r["part"]] = r["count"]
    turns = np.maximum(1, -(-asked // QUERY_BLOCK))
    of = lambda sizes: F.element_at(F.array(*[F.lit(int(n)) for n in sizes]), F.col("part") + 1)
    spread = lambda key, sizes: F.pmod(F.xxhash64(key), of(sizes)).cast("int")
    every = lambda sizes: F.explode(F.sequence(F.lit(0), of(sizes) - 1))
    left = routed.withColumn("turn", spread("query", turns)).withColumn("block", every(blocks))
    right = index.withColumn("block", spread("row", blocks)).withColumn("turn", every(turns))

    def rank(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if len(q) and len(c):
            x, ids = np.stack(c["v"].to_numpy()), c["vec_id"].to_numpy()
            rows = c["row"].to_numpy()
            for a in range(0, len(q), 256):
                y, own, named = np.stack(q["v"].to_numpy()[a : a + 256]), q["query"].to_numpy()[a : a + 256], q["query_id"].to_numpy()[a : a + 256]
                s = y @ x.T
                s[own[:, None] == rows[None, :]] = -np.inf
                edge = np.partition(s, -k, axis=1)[:, -k] if len(x) > k else np.full(len(y), -np.inf)
                for i in range(len(y)):
                    # The product's rounding may depend on a row's place: what is near the edge is summed again in one fixed order.
                    near = np.flatnonzero((s[i] >= edge[i] - 1e-9 * max(1.0, abs(edge[i]) if np.isfinite(edge[i]) else 1.0)) & (s[i] > -np.inf))
                    exact = (x[near] * y[i]).sum(1)
                    top = np.lexsort((ids[near], -exact))[:k]
                    out["query"].append(np.full(len(top), own[i]))
                    out["query_id"].append(np.full(len(top), named[i]))
                    out["vec_id"].append(ids[near][top])
                    out["score"].append(exact[top])
        return pd.DataFrame({n: np.concatenate(v) if v else np.zeros(0, np.int64 if n != "score" else np.float64) for n, v in out.items()})

    keys = ("part", "block", "turn")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each row of ``embeddings`` whose id is divisible by 20."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter(F.col("vec_id") % QUERY_EVERY == 0))

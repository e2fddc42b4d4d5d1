"""Hard-negative mining by vantage-point trees over norm-augmented vectors.

With M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor a becomes (a, 0). Then the squared
distance is |a|^2 + M^2 - 2ax: the nearest rows have the largest inner products, and a window of scores is an annulus.

A tree built from a bounded sample deals all rows to its leaves: at each node, by the distance to the node's vantage point.
A leaf of any size, also one full of equal vectors, is dealt out by hash into blocks of bounded size, each of which holds
a tree of its own. Distances to the vantage points above a bucket, their least and greatest over its rows, bound by the
triangle inequality which scores it can hold. A query reads the buckets that its annulus meets nearest first, and stops
once it has k rows in each window that are nearer than anything the next bucket can hold.

A search goes in two rounds: first the leaf that may hold the nearest row of the annulus, then those that may still better
what was found. Bounds are rounded outwards and scores are exact integers, so results are exact.

Left out: rows with a null label, a null vector or a component that is null or not finite. Shorter vectors go on with
zeros. Each row that repeats an id is an anchor and a candidate of its own; null ids come last among ties. Scores must
fit in 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rtlake.llm.common import cut, table

#: Of the contract: anchors, rows whose label moves on, labels, grid of components, positives and negatives, window in per cent.
ANCHOR_EVERY, MOVED_EVERY, LABELS, GRID = 50, 7, 10, 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows that a leaf aims at, rows of the sample and those for each leaf, of a block, of a bucket, anchors that a task meets at once.
LEAF_ROWS, SAMPLE, SAMPLE_PER_LEAF, BLOCK, BUCKET, TURN = 8_192, 32_768, 16, 8_192, 512, 1_024
#: Stands for a null id, after all others.
LAST = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v array<double>) of the rows that take part, stored; labels moved, components floor(256 x), of one length."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & F.forall(x, lambda c: F.coalesce((c == c) & (F.abs(c) < float("inf")), F.lit(False)))
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    rows = vectors.filter(F.col("embedding").isNotNull() & fine).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("vec_id"), moved.alias("label"), F.transform(x, lambda c: F.floor(c * GRID).cast("double")).alias("v"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if sizes["least"] == sizes["most"]:
        return rows
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(sizes["most"]) - F.size("v"))))


@dataclass
class Tree:
    """Inner nodes: vantage points, radii and children (a leaf is ~number); for each leaf, its nodes from the root."""

    points: np.ndarray
    radii: np.ndarray
    children: np.ndarray
    paths: list[list[int]]

    def parts(self) -> tuple:
        """What makes it, in plain arrays: these can be broadcast to workers that can't import this module."""
        return self.points, self.radii, self.children, self.paths

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node, the first child within the radius, the second beyond."""
        at = np.full(len(x), 0 if len(self.radii) else ~0)
        while (at >= 0).any():
            for node in np.unique(at[at >= 0]):
                rows = np.flatnonzero(at == node)
                far = distances(x[rows], self.points[node : node + 1])[:, 0] > self.radii[node]
                at[rows] = self.children[node][far.astype(int)]
        return ~at


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))


def vantage_tree(x: np.ndarray, most: int) -> tuple[Tree, list[np.ndarray]]:
    """A tree over rows, halved by the median distance until a leaf has at most ``most`` rows or only equal ones; and each leaf's rows."""
    points, radii, children, paths, leaves = [], [], [], [], []

    def grow(rows: np.ndarray, path: list[int]) -> int:
        if len(rows) > most:
            d = distances(x[rows], x[rows[:1]])[:, 0]
            vantage = rows[d.argmax()]
            d = distances(x[rows], x[vantage : vantage + 1])[:, 0]
            radius = np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]
            if not (d > radius).any():
                radius = np.max(d[d < radius], initial=-1.0)
            if radius >= 0:
                node = len(radii)
                points.append(x[vantage])
                radii.append(radius)
                children.append([0, 0])
                children[node] = [grow(rows[d <= radius], [*path, node]), grow(rows[d > radius], [*path, node])]
                return node
        paths.append(path)
        leaves.append(rows)
        return ~(len(leaves) - 1)

    grow(np.arange(len(x)), [])
    return Tree(np.array(points).reshape(-1, x.shape[1]), np.array(radii), np.array(children, np.int64).reshape(-1, 2), paths), leaves


def best_scores(squares: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each query can have in each bucket.

    ``squares``: |a|^2 + M^2 of each query. ``d``: its distances to nodes; ``low``, ``high``: of each bucket, the distances to
    these nodes between which its rows lie (nan where a node isn't above the bucket).
    """
    with np.errstate(invalid="ignore"):
        near = np.fmax.reduce(np.concatenate([d[:, None, :] - high[None], low[None] - d[:, None, :], np.zeros((*d.shape[:1], len(low), 1))], 2), axis=2)
        far = np.fmin.reduce(np.concatenate([d[:, None, :] + high[None], np.full((*d.shape[:1], len(low), 1), np.inf)], 2), axis=2)
    slack = 1e-9 * squares[:, None] + 1e-6
    return (squares[:, None] - far**2) / 2 - slack, (squares[:, None] - near**2) / 2 + slack


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(square - (x**2).sum(1), 0))[:, None]], 1)


def of_anchor(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), 1))], 1)


def bounds(d: np.ndarray, tree: Tree, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of each leaf's rows to the nodes above it; ``d`` are the rows' distances to all nodes."""
    low, high = np.full((len(leaves), d.shape[1]), np.nan), np.full((len(leaves), d.shape[1]), np.nan)
    for k, (rows, path) in enumerate(zip(leaves, tree.paths, strict=True)):
        if len(rows) and path:
            low[k, path], high[k, path] = d[np.ix_(rows, path)].min(0), d[np.ix_(rows, path)].max(0)
    return low, high


def padded(low: list, high: list, least: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' ends and what a score must reach, as one row for each query; places without a window want nothing."""
    slots = max(map(len, low), default=0)
    fill = lambda lists, value: np.array([[*x, *[value] * (slots - len(x))] for x in lists], float).reshape(len(lists), slots)
    return fill(low, np.inf), fill(high, -np.inf), fill(least, np.inf)


def wanted(lows: np.ndarray, highs: np.ndarray, windows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether buckets with scores between these may hold what a query still wants; equal scores may win by their id."""
    out = np.zeros(lows.shape, bool)
    for low, high, least in zip(*(w.T[:, :, None] for w in windows), strict=True):
        out |= (low <= highs) & (lows <= high) & (least <= highs)
    return out


def packed(rows: pd.DataFrame) -> bytes:
    table_ = pa.table({"row": rows["row"].to_numpy(), "vec_id": rows["vec_id"].to_numpy(), "label": rows["label"].to_numpy(), "v": pa.array(list(rows["v"]), pa.list_(pa.float64()))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table_.schema) as out:
        out.write_table(table_)
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    got = pa.ipc.open_stream(raw).read_all().combine_chunks()
    return got["row"].to_numpy(), got["vec_id"].to_numpy(), got["label"].to_numpy(), matrix(got["v"].combine_chunks())


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), dtype=float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Index:
    """Blocks of rows by leaf, stored; the tree over the leaves with the bounds of their rows; M^2."""

    blocks: DataFrame
    tree: Tree
    low: np.ndarray
    high: np.ndarray
    held: np.ndarray
    square: float


def build(vectors: DataFrame, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, block: int = BLOCK) -> Index | None:
    """The index of ``usable`` rows; every row is in it. None if there are no rows.

    The sample that the upper tree is built from has at most ``sample`` rows, chosen by hash, ``SAMPLE_PER_LEAF`` for each
    leaf: at most 2,048 leaves. What comes back to the driver is that sample and one row of bounds for each leaf.
    """
    spark = vectors.sparkSession
    norms = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("square")).first()
    if not norms["n"]:
        return None
    square, leaves = float(norms["square"]), min(sample // SAMPLE_PER_LEAF, -(-norms["n"] // leaf_rows))
    if leaves > 1:
        chosen = vectors.orderBy(F.xxhash64("row"), "row").limit(min(sample, leaves * SAMPLE_PER_LEAF * 4)).select("v").toArrow()
        x = augmented(matrix(chosen["v"].combine_chunks()), square)
        tree, _ = vantage_tree(x, max(1, len(x) // leaves))
    else:
        tree = Tree(np.zeros((0, 1)), np.zeros(0), np.zeros((0, 2), np.int64), [[]])
    shared = spark.sparkContext.broadcast(tree.parts())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upper = Tree(*shared.value)
            x = augmented(matrix(b.column("v")), square) if b.num_rows else np.zeros((0, 1))
            leaf = upper.leaf_of(x)
            far: list = [[]] * len(leaf)
            for k in np.unique(leaf).tolist():
                if upper.paths[k]:
                    at = np.flatnonzero(leaf == k)
                    for i, d in zip(at.tolist(), distances(x[at], upper.points[upper.paths[k]]).tolist(), strict=True):
                        far[i] = d
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "vec_id", "label", "v")], pa.array(leaf, pa.int32()), pa.array(far, pa.list_(pa.float64()))], names=["row", "vec_id", "label", "v", "leaf", "far"])

    placed = cut(vectors.select("row", "vec_id", "label", "v").mapInArrow(place, "row long, vec_id long, label long, v array<double>, leaf int, far array<double>"))
    deepest = max(map(len, tree.paths))
    ends = [f(F.get("far", F.lit(k))).alias(f"{n}{k}") for k in range(deepest) for n, f in (("low", F.min), ("high", F.max))]
    low, high, held = np.full((len(tree.paths), len(tree.radii)), np.nan), np.full((len(tree.paths), len(tree.radii)), np.nan), np.zeros(len(tree.paths), np.int64)
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *ends).collect():
        path = tree.paths[r["leaf"]]
        held[r["leaf"]] = r["n"]
        low[r["leaf"], path], high[r["leaf"], path] = [r[f"low{k}"] for k in range(len(path))], [r[f"high{k}"] for k in range(len(path))]
    blocks = np.maximum(1, -(-held // block))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("row"), per_leaf(blocks)).cast("int"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"leaf": [key[0]], "block": [key[1]], "packed": [packed(rows.sort_values("row"))]})

    stored = dealt.select("leaf", "block", "row", "vec_id", "label", "v").groupBy("leaf", "block").applyInPandas(pack, "leaf int, block int, packed binary")
    return Index(cut(stored), tree, low, high, blocks, square)


def per_leaf(numbers: np.ndarray):
    """The number of a row's leaf, as a column."""
    return F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col("leaf") + 1)


FOUND = "query long, slot int, vec_id long, row long, score long"
_ASKED = ("query", "label", "v", "low", "high", "least")


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of each query in each of its windows: query, slot (the window's place), vec_id, row, score.

    ``queries``: query (its own row, which is no candidate), label, v, and the windows' ends ``low`` and ``high``, arrays of
    double. Candidates are rows of the same label, or of any other. Higher scores first, ties to the smaller id.
    """
    spark, shared = queries.sparkSession, queries.sparkSession.sparkContext.broadcast((index.tree.parts(), index.low, index.high, index.square))

    def meets(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, low, high, square = shared.value
        tree = Tree(*parts)
        return best_scores((x**2).sum(1) + square, distances(of_anchor(x), tree.points) if len(tree.radii) else np.zeros((len(x), 0)), low, high)

    def route(first: bool):
        def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                lows, highs = meets(matrix(b.column("v")))
                windows = padded(*[b.column(c).to_pylist() for c in ("low", "high", "least")])
                want = wanted(lows, highs, windows)
                reach = np.where(want, np.minimum(highs, np.where(np.isfinite(windows[1]) | (windows[1] > 0), windows[1], -np.inf).max(1, initial=-np.inf)[:, None]), -np.inf)
                if first:
                    to = [[int(x)] if w.any() else [] for x, w in zip(reach.argmax(1), want, strict=True)]
                else:
                    want[np.arange(len(want)), b.column("home").to_numpy()] = False
                    to = [np.flatnonzero(w).tolist() for w in want]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in _ASKED], pa.array(to, pa.list_(pa.int32()))], names=[*_ASKED, "leaves"])

        return body

    held = index.held
    asked_schema = "query long, label long, v array<double>, low array<double>, high array<double>, least array<double>"

    def visit(routed: DataFrame) -> DataFrame:
        asked = np.zeros(len(held), np.int64)
        for r in routed.groupBy("leaf").count().collect():
            asked[r["leaf"]] = r["count"]
        turns = np.maximum(1, -(-asked // TURN))
        left = routed.withColumn("turn", F.pmod(F.xxhash64("query"), per_leaf(turns)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), per_leaf(held) - 1)))
        right = index.blocks.withColumn("turn", F.explode(F.sequence(F.lit(0), per_leaf(turns) - 1)))
        square = index.square

        def answer(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            return within(q, *unpacked(c["packed"].iloc[0]), square, k, same) if len(q) and len(c) else pd.DataFrame({n: np.zeros(0, np.int64) for n in ("query", "slot", "vec_id", "row", "score")})

        keys = ("leaf", "block", "turn")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(answer, FOUND)

    def merged(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")

    started = queries.withColumn("least", F.transform("low", lambda _: F.lit(float("-inf")))).withColumn("home", F.lit(-1))
    leaf = lambda df: df.withColumn("leaf", F.explode("leaves")).drop("leaves")
    homes = cut(leaf(started.mapInArrow(route(True), f"{asked_schema}, leaves array<int>")))
    near = cut(merged(visit(homes)))
    if len(held) == 1:
        return near
    full = near.groupBy("query", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kths"))
    known = homes.select("query", F.col("leaf").alias("home_leaf")).join(full, "query", "left")
    raised = F.transform("low", lambda _, i: F.coalesce(F.try_element_at("kths", i).cast("double"), F.lit(float("-inf"))))
    again = queries.join(known, "query").withColumn("least", raised).select(*_ASKED, F.col("home_leaf").alias("home"))
    rest = cut(leaf(again.mapInArrow(route(False), f"{asked_schema}, leaves array<int>")))
    return merged(near.unionByName(visit(rest)))


def within(q: pd.DataFrame, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, square: float, k: int, same: bool) -> pd.DataFrame:
    """The answers of one block to queries: each reads its tree's buckets nearest first, the next 1, 2, 4, ... that may hold what it wants."""
    tree, buckets = vantage_tree(z := augmented(x, square), BUCKET)
    low, high = bounds(distances(z, tree.points) if len(tree.radii) else np.zeros((len(z), 0)), tree, buckets)
    a, query, label = np.stack(q["v"].to_numpy()), q["query"].to_numpy(), q["label"].to_numpy()
    lows, highs = best_scores((a**2).sum(1) + square, distances(of_anchor(a), tree.points) if len(tree.radii) else np.zeros((len(a), 0)), low, high)
    from_, to, least = padded(q["low"].tolist(), q["high"].tolist(), q["least"].tolist())
    order, slots, start, width = np.argsort(-highs, axis=1, kind="stable"), from_.shape[1], 0, 1
    best = np.zeros((4, 0))  # query, slot, -score and the row's place in the block
    while start < len(buckets):
        part = order[:, start : start + width]
        want = wanted(np.take_along_axis(lows, part, 1), np.take_along_axis(highs, part, 1), (from_, to, least))
        got = [best]
        for b in np.unique(part[want]).tolist():
            asking, at = np.flatnonzero(((part == b) & want).any(1)), buckets[b]
            s = a[asking] @ x[at].T
            ok = ((labels[at][None] == label[asking][:, None]) == same) & (rows[at][None] != query[asking][:, None])
            for j in range(slots):
                m = ok & (s >= np.maximum(from_[asking, j], least[asking, j])[:, None]) & (s <= to[asking, j][:, None])
                if m.any():
                    if len(at) > k:
                        m &= s >= -np.partition(np.where(m, -s, np.inf), k - 1, axis=1)[:, k - 1 : k]
                    i, c = np.nonzero(m)
                    got.append(np.stack([asking[i], np.full(len(i), j), -s[i, c], at[c]]))
        best = np.concatenate(got, 1)
        place = best[3].astype(np.int64)
        group = (best[0] * slots + best[1]).astype(np.int64)
        best = best[:, np.lexsort((rows[place], ids[place], best[2], group))]
        group = np.sort(group)
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        best, last = best[:, rank < k], best[:, rank == k - 1]
        least[last[0].astype(int), last[1].astype(int)] = np.maximum(least[last[0].astype(int), last[1].astype(int)], -last[2])
        start, width = start + width, 2 * width
    place = best[3].astype(np.int64)
    return pd.DataFrame({"query": query[best[0].astype(int)], "slot": best[1].astype(np.int64), "vec_id": ids[place], "row": rows[place], "score": -best[2].astype(np.int64)})


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, **sizes: int) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor, anchor_id, positive_id, positive_row, rank, negative_id, negative_row, positive_score, negative_score.

    ``vectors``: rows as ``usable`` gives them, ``anchors``: some of these.
    """
    index = build(vectors, **sizes)
    none = "anchor long, anchor_id long, positive_id long, positive_row long, rank int, negative_id long, negative_row long, positive_score long, negative_score long"
    if index is None:
        return vectors.sparkSession.createDataFrame([], none)
    whole = lambda x: F.array(F.lit(x))
    asked = anchors.select(F.col("row").alias("query"), "label", "v")
    near = cut(search(index, asked.withColumns({"low": whole(float("-inf")), "high": whole(float("inf"))}), positives, True))
    ranked = near.withColumn("slot", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")) - 1)
    windows = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("slot", "score"))).alias("w")).select(
        "query", F.transform("w", lambda w: F.ceil(w["score"] * low / 100).cast("double")).alias("low"), F.transform("w", lambda w: F.floor(w["score"] * high / 100).cast("double")).alias("high")
    )
    found = search(index, asked.join(windows, "query"), negatives, False)
    rank = F.row_number().over(Window.partitionBy("query", "slot").orderBy(F.desc("score"), "vec_id", "row"))
    negative = found.select("query", "slot", rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("row").alias("negative_row"), F.col("score").alias("negative_score"))
    positive = ranked.select("query", "slot", F.col("vec_id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id"))
    id_ = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return positive.join(negative, ["query", "slot"]).join(named, "query").select(F.col("query").alias("anchor"), "anchor_id", id_("positive_id"), "positive_row", "rank", id_("negative_id"), "negative_row", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of ``embeddings`` whose id is divisible by 50."""
    vectors = usable(table(spark, sf_dir, "embeddings"))
    anchors = vectors.filter((F.col("vec_id") % ANCHOR_EVERY == 0) & (F.col("vec_id") != LAST))
    return mine(vectors, anchors).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, a.label AS own, b.r AS b, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM s WHERE label = own) WHERE k <= 5),
n AS (SELECT p.a, p.k, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.a = p.a AND s.label <> p.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

"""Near-duplicate documents by bottom-k sketches.

One hash function gives each document a set of word shingles; its k least values are its sketch. Documents with one
set are collapsed first. Then, over what remains:

1. Inverted lists of a short sketch drop documents that share too few values with any other.
2. For the rest, few documents of any corpus, the lists take whole sets, rarest values first and only as many as a pair
   must share one of. In each list every member is paired with the most central member of another component alone, for
   some rounds; each round's links join components, and lists within one component are done. So a group of copies, however
   large, makes as many pairs as it has members. In lists that still span components, the lengths of two sets and the
   places of the shared value tell whether they leave room for enough more: only such pairs of two components count.
3. The union's sketch estimates each candidate; the exact Jaccard of the full sets confirms it.

The short sketch and the estimate lose a pair at the threshold only if it falls six standard deviations below its mean; all
other bounds are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rtlake.llm.common import PART_BYTES, cut, release, small, table
from rtlake.llm.texts import map_texts

#: Sizes of the sketch whose lists find overlaps and of the one that estimates pairs.
SHORT, LONG = 32, 256
#: Rounds of pairs with hubs; edges that a worker joins to components at once.
HUB_ROUNDS, JOINED = 3, 500_000
#: Of the contract: words of a shingle, least similarity in per cent.
SHINGLE, PERCENT = 3, 85
_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 14, 1 << n.bit_length())
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes (int64) of the word shingles of a whole text, A-Z lower-cased.

    Fewer words than a shingle: the whole sequence is one. No words: empty.
    """
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64)
    powers, inverse = _power_tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)])])
    words = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    width = min(shingle, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        h = _mixed(h * np.uint64(_MIX2) + words[i : len(words) - width + 1 + i])
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def least_shared(share: float, size: int) -> int:
    """Values that the sketches of a pair at similarity ``share`` have in common, but for six standard deviations."""
    return max(1, math.floor(share * size - 6 * math.sqrt(share * (1 - share) * size)))


def _needed(n: Column, size: int, percent: int) -> Column:
    """How many of its sketch's values a set of ``n`` finds in the sketch of any partner at least (of thresholds above 50 %).

    Of a partner of more than ``size`` values those beyond the sketch may be shared and don't count: fewest are left by
    the largest partner.
    """
    most = F.floor(n * 100 / percent)
    beyond = F.ceil((n + most) * percent / (100 + percent)) - F.greatest(most - size, F.lit(0))
    return F.when(n <= size, F.least(F.ceil(n * percent / 100), beyond)).otherwise(least_shared(percent / 100, size)).cast("int")


def sketches(docs: DataFrame, shingle: int, size: int = SHORT) -> DataFrame:
    """doc_id, n (set size), h1 and h2 (the set's identity), low (its least values): one row per row of ``docs``."""

    def body(parts: Iterator) -> Iterator[dict]:
        for p in parts:
            sets = [shingle_set(t, shingle) for t in p.column("text").to_pylist()]
            both = [(int(_mixed(s.astype(np.uint64)).sum(dtype=np.uint64)), int(_mixed(s.astype(np.uint64) + np.uint64(_BASE)).sum(dtype=np.uint64))) for s in sets]
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            yield {"doc_id": p.column("doc_id"), "n": [len(s) for s in sets], "h1": [signed(a) for a, _ in both], "h2": [signed(b) for _, b in both], "low": [s[:size] for s in sets]}

    return map_texts(docs.select("doc_id", "text"), "doc_id long, n long, h1 long, h2 long, low array<long>", body)


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """node, values (the sorted set): of rows (node, text)."""

    def body(parts: Iterator) -> Iterator[dict]:
        for p in parts:
            yield {"node": p.column("node"), "values": [shingle_set(t, shingle) for t in p.column("text").to_pylist()]}

    return map_texts(docs.select("node", "text"), "node long, values array<long>", body)


def _least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) that their component has a smaller one than, with the least."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        u, v = label[x], label[y]
        open_ = u != v
        if not open_.any():
            break
        x, y, u, v = x[open_], y[open_], u[open_], v[open_]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: of each piece of at most ``JOINED`` edges, each node with the least it reaches there."""

    def body(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def joined(held: list) -> pa.RecordBatch:
            a, b = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("a", "b"))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _least_of(a, b)], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= JOINED:
                yield joined(held)
                held, rows = [], 0
        if held:
            yield joined(held)

    return edges.select("a", "b").mapInArrow(body, "a long, b long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has edges to one smaller node at most, and to none if a larger one has an edge to it."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", F.lit(None).cast("long")))
    ends = ends.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max(F.col("to").isNull()).alias("centre"))
    return ends.coalesce(edges.stored.parts).filter("lo <> hi OR lo IS NOT NULL AND centre").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> node, component (its least node; nodes that are the least aren't listed), stored.

    Pieces of the edges are joined within a task; what goes across is joined by alternating large and small stars
    until all components are stars.
    """
    edges = cut(_contracted(edges))
    while not _are_stars(edges):
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        ties = large.join(low, "a")
        star = ties.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).distinct()
        before, edges = edges, cut(_contracted(star), edges)
        release(before)
    out = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), edges)
    release(edges)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose sets are similar enough: first by the union's sketch, then exactly.

    Few pairs are sent to the sets, so that only sets in pairs move; many meet them by shuffles.
    """
    ends = pairs if pairs.stored.size > sets.stored.size else small(pairs)
    left = sets.select(F.col("node").alias("a"), F.col("values").alias("x")).join(ends, "a")
    right = sets.select(F.col("node").alias("b"), F.col("values").alias("y"))
    right = right if ends is pairs else right.join(ends.select("b").distinct(), "b", "left_semi")
    both = left.join(right, "b")
    share = least_shared(percent / 100, LONG)

    def body(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                u, v = x[:LONG], y[:LONG]
                common = np.intersect1d(u, v, assume_unique=True)
                union = len(u) + len(v) - len(common)
                if union > LONG:  # of the union's least values, those in both
                    edge = np.partition(np.union1d(u, v), LONG - 1)[LONG - 1]
                    if (common <= edge).sum() < share:
                        keep.append(False)
                        continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(body, "a long, b long")


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _with_hubs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a > b: each member of a list with the most central member of another component than its own."""
    few = lists.stored.parts
    tops = lists.groupBy("value", "component").agg(F.max(F.struct("central", (-F.col("node")).alias("minus"), "n", "component")).alias("top")).coalesce(few)
    best = tops.groupBy("value").agg(F.max("top").alias("best"))
    other = tops.join(best, "value").filter("top.component <> best.component").groupBy("value").agg(F.max("top").alias("other"), F.max("best").alias("best")).coalesce(few)
    hub = F.when(F.col("component") == F.col("best.component"), F.col("other")).otherwise(F.col("best"))
    star = lists.join(other, "value").withColumn("hub", hub).filter(_fits(F.col("n"), F.col("hub.n"), percent))
    return star.select(F.greatest(F.col("node"), -F.col("hub.minus")).alias("a"), F.least(F.col("node"), -F.col("hub.minus")).alias("b")).coalesce(few).distinct()


def _with_others(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of two components in one list whose lengths and places leave room for enough shared values.

    With so many values from the shared one's place on, a set can be linked with one of at most ``reach`` values; a pair
    counts if each is within the other's reach. Lists are split by classes of length that a link spans two of at most.
    """
    reach = F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n")
    sized = lists.withColumns({"reach": reach, "class": F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")})
    less = sized.filter("reach >= n").select("value", "class", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "reach", "component")])
    more = sized.withColumn("class", F.explode(F.array("class", F.col("class") - 1))).select("value", "class", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "reach", "component")])
    order = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b"))
    pairs = less.join(more, ["value", "class"]).filter((F.col("component_a") != F.col("component_b")) & order & (F.col("n_b") <= F.col("reach_a")) & (F.col("n_a") <= F.col("reach_b")))
    return pairs.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).coalesce(lists.stored.parts).distinct()


def _joined(lists: DataFrame, links: DataFrame) -> DataFrame:
    """``lists`` under the components that ``links`` make, without lists within one component: of these no pair can add anything."""
    few, named = lists.stored.parts, components(links)
    named_lists = lists.drop("component").join(small(named), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named_lists.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("value")
    out = cut(named_lists.join(several.coalesce(few), "value"), lists)
    release(named)
    return out


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id long, text).

    Texts without words, and null texts, are linked with nothing, as are rows with a null id (whose component is
    null; they are kept). Rows with one id are one document: what any of them is linked with. Other columns aren't read.
    """
    every = cut(sketches(docs, shingle))
    some = every.filter("n > 0 AND doc_id IS NOT NULL")
    nodes = cut(some.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "low")).alias("x")).select("h1", "h2", "n", F.col("x.doc_id").alias("node"), "x.low"), every)
    # Rows that repeat an id with other texts: a node then has several sets, and their nodes are linked by the id.
    identity = F.struct("h1", "h2", "n")
    repeated = every.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(identity).alias("lo"), F.max(identity).alias("hi"))
    repeated = small(cut(repeated.filter("lo <> hi").select("doc_id"), every))
    same = cut(some.join(repeated, "doc_id", "left_semi").join(nodes, ["h1", "h2", "n"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b"), every)
    # 1. Which documents share enough values of the short sketch with any others.
    posted = nodes.select("node", "h1", "n", F.explode("low").alias("value"))
    common = small(cut(posted.groupBy("value").count().filter("count > 1").select("value"), every))
    alive = cut(posted.join(common, "value").groupBy("node", "h1", "n").count().filter(F.col("count") >= _needed(F.col("n"), SHORT, percent)).select("node", "n"), every)
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(small(cut(alive.select("node").distinct(), alive)), "node")
    sets = full_sets(texts, shingle).filter(F.size("values") > 0).withColumn("own", F.xxhash64("values"))
    sets = cut(sets.dropDuplicates(["node", "own"]))
    # 2. Lists over whole sets: a pair shares one of the rarest values, of which each set gives as many as it may miss and one more.
    posted = sets.select("node", "own", F.size("values").alias("n"), F.explode("values").alias("value"))
    often = posted.groupBy("value").agg(F.count(F.lit(1)).alias("often"))
    ranked = posted.join(often, "value").groupBy("node", "own", "n").agg(F.sort_array(F.collect_list(F.struct("often", "value"))).alias("by"), F.sum("often").alias("central"))
    prefix = F.slice("by", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    lists = ranked.select("node", "n", "central", F.posexplode(prefix).alias("place", "x")).filter("x.often > 1")
    lists = cut(lists.select("node", "n", (F.col("central") / F.col("n")).alias("central"), "place", F.col("x.value").alias("value"), F.col("node").alias("component")), sets)
    links, tried = [same], []
    left = HUB_ROUNDS
    while left >= 0:
        last, left = left == 0, left - 1
        pairs = _with_others(lists, percent) if last else _with_hubs(lists, percent)
        for earlier in tried:
            pairs = pairs.join(small(earlier), ["a", "b"], "left_anti")
        pairs = cut(pairs, lists)
        tried.append(pairs)
        links.append(cut(verified(pairs, sets, percent), sets))
        if links[-1].isEmpty():  # the same hubs would come again
            left = min(left, 0)
        elif not last:
            before, lists = lists, _joined(lists, _union(links))
            release(before)
    final = components(_union(links))
    release(sets)
    # 3. Back to every row.
    named = nodes.join(final, "node", "left").select("h1", "h2", "n", F.coalesce("component", "node").alias("component"))
    out = every.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    # A text without words has no set; where its id has other texts, it goes with them.
    ids = small(cut(final.join(repeated, F.col("node") == F.col("doc_id"), "left_semi").select(F.col("node").alias("doc_id"), F.col("component").alias("other")), final))
    out = out.join(ids, "doc_id", "left").withColumn("component", F.coalesce("component", "other", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _union(frames: list[DataFrame]) -> DataFrame:
    """Edges (a, b) of stored frames, in few tasks if they are small."""
    return reduce(DataFrame.union, frames).coalesce(max(1, sum(f.stored.parts if f.stored.size > PART_BYTES else 0 for f in frames)))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all ``documents``: three-word shingles, 85 per cent."""
    return linked(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
             ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.root, l.b FROM r JOIN l ON r.node = l.a),
k AS (SELECT root, min(node) AS least FROM r GROUP BY root)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.least AS component_id, d.doc_id = k.least AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN k ON d.doc_id = k.root
"""

"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: leaves hold runs of (length, tokens), inner nodes the sums of
both. An edit re-splits from a pre-token that it can't have changed to the first boundary that both versions share,
counts only the pre-tokens between, puts them into the leaves it touched and adds up the paths above them.

That is exact for patterns that look ahead but not back: where a match starts decides it, together with the text that
follows. ``CONTEXT`` is how far behind its own end a match of the pattern may look.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain, pairwise

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rtlake.llm.common import table
from rtlake.llm.texts import kept_by_worker, map_texts

#: Pre-tokens of a new leaf; how many times as many a leaf may hold before all are dealt again; code points behind its
#: end that a match may depend on; entries of the count cache.
LEAF, GROWTH, CONTEXT, CACHE = 64, 4, 3, 300_000
TREE = "tree struct<leaves: array<int>, lengths: array<int>, tokens: array<int>, chars: array<long>, sums: array<long>>"
#: The same lists in Arrow.
LISTS = {"leaves": pa.int32(), "lengths": pa.int32(), "tokens": pa.int32(), "chars": pa.int64(), "sums": pa.int64()}


class _Seen(dict):
    """Tokens of pre-tokens, counted when first asked for; at most ``CACHE`` are remembered."""

    def __init__(self, bpe: tiktoken.Encoding):
        self._bpe = bpe

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self._bpe._encode_single_piece(piece.encode()))
        return n


class Counter:
    """Splits texts and counts tokens of pre-tokens; ``ranks`` maps token bytes to ids."""

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        self.split = regex.compile(pattern)
        self._bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: The number of tokens of a pre-token.
        self.count = _Seen(self._bpe).__getitem__


def _dealt(lengths: list[int], tokens: list[int]) -> list[tuple[list[int], list[int]]]:
    return [(lengths[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(lengths), LEAF)]


class Tree:
    """A text's pre-tokens in leaves under a complete binary tree of sums; node i has children 2i and 2i + 1."""

    def __init__(self, leaves: list[tuple[list[int], list[int]]]):
        self.leaves = leaves or [([], [])]
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.sums = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (lengths, tokens) in enumerate(self.leaves):
            self.chars[self.width + i], self.sums[self.width + i] = sum(lengths), sum(tokens)
        for i in range(self.width - 1, 0, -1):
            self._add_up(i)

    @classmethod
    def of(cls, text: str, counter: Counter) -> Tree:
        pieces = counter.split.findall(text)
        lengths, tokens = [*map(len, pieces)], [*map(counter.count, pieces)]
        return cls(_dealt(lengths, tokens))

    def _add_up(self, i: int) -> None:
        self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point ``at`` (the last for the end), and where it starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at >= start + self.chars[i] and at < start + self.chars[i] + self.chars[i + 1]:
                start += self.chars[i]
                i += 1
            elif at >= start + self.chars[i]:  # beyond both: the last leaf with text
                step = self.chars[i + 1] > 0
                start += self.chars[i] if step else 0
                i += step
        return min(i - self.width, len(self.leaves) - 1), start

    def edit(self, text: str, at: int, cut: int, put: str, counter: Counter) -> tuple[str, int]:
        """Replaces ``cut`` code points at ``at`` by ``put``; the new text, and how much of it was split again."""
        at = min(max(0, at), len(text))
        end = min(len(text), at + max(0, cut))
        new, shift = text[:at] + put + text[end:], len(put) - (end - at)
        first, start = self.leaf_at(max(0, at - CONTEXT - 1))
        while first and start + self.chars[self.width + first] + CONTEXT > at and self._first_end(first, start) + CONTEXT > at:
            first -= 1
            start -= self.chars[self.width + first]
        kept = 0
        lengths, tokens = self.leaves[first]
        begin = start
        while kept < len(lengths) and begin + lengths[kept] + CONTEXT <= at:
            begin += lengths[kept]
            kept += 1
        # Old boundaries from here on, leaf by leaf, while the new text is split again.
        out_lengths, out_tokens = lengths[:kept], tokens[:kept]
        leaf, inner, old = first, kept, begin
        position, spent = begin, 0
        matches = counter.split.finditer(new, begin)
        while True:
            while old + shift < position or old < end:  # advance the old boundary
                while leaf < len(self.leaves) and inner >= len(self.leaves[leaf][0]):
                    leaf, inner = leaf + 1, 0
                if leaf >= len(self.leaves):
                    break
                old += self.leaves[leaf][0][inner]
                inner += 1
            if old >= end and old + shift == position and position >= at + len(put):
                break
            m = next(matches, None)
            if m is None:
                break
            out_lengths.append(len(m[0]))
            out_tokens.append(counter.count(m[0]))
            position, spent = m.end(), spent + len(m[0])
        leaf = min(leaf, len(self.leaves) - 1)
        rest_lengths, rest_tokens = self.leaves[leaf]
        out_lengths += rest_lengths[inner:]
        out_tokens += rest_tokens[inner:]
        touched = range(first, leaf + 1)
        each = -(-len(out_lengths) // len(touched))
        for k, i in enumerate(touched):
            part = (out_lengths[k * each : (k + 1) * each], out_tokens[k * each : (k + 1) * each])
            self.leaves[i] = part
            self.chars[self.width + i], self.sums[self.width + i] = sum(part[0]), sum(part[1])
        if each > GROWTH * LEAF:  # seldom enough that it costs each pre-token put in a bounded share
            self.__init__(_dealt([x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b]))
            return new, spent
        low, high = (self.width + first) // 2, (self.width + leaf) // 2
        while low:
            for i in range(low, high + 1):
                self._add_up(i)
            low, high = low // 2, high // 2
        return new, spent

    def _first_end(self, leaf: int, start: int) -> int:
        lengths = self.leaves[leaf][0]
        return start + (lengths[0] if lengths else 0)

    def row(self) -> dict:
        return {"leaves": [len(a) for a, _ in self.leaves], "lengths": [x for a, _ in self.leaves for x in a], "tokens": [x for _, b in self.leaves for x in b], "chars": self.chars, "sums": self.sums}

    @classmethod
    def from_row(cls, row: dict) -> Tree:
        tree = cls.__new__(cls)
        lengths, tokens = row["lengths"], row["tokens"]
        tree.leaves = [(lengths[a:b], tokens[a:b]) for a, b in pairwise(accumulate(row["leaves"], initial=0))]
        tree.chars, tree.sums, tree.width = list(row["chars"]), list(row["sums"]), len(row["chars"]) // 2
        return tree


def packed(trees: Sequence[Tree]) -> pa.StructArray:
    """Trees as a column. Its lists are made whole: Arrow takes rows of lists number by number."""
    rows = [t.row() for t in trees]
    lists = []
    for name, kind in LISTS.items():
        ends = pa.array([*accumulate((len(r[name]) for r in rows), initial=0)], pa.int32())
        lists.append(pa.ListArray.from_arrays(ends, pa.array([*chain.from_iterable(r[name] for r in rows)], kind)))
    return pa.StructArray.from_arrays(lists, [*LISTS])


def unpacked(column: pa.StructArray) -> Iterator[Tree]:
    """The trees of ``packed``'s column, or of a slice of one."""
    lists = []
    for name in LISTS:
        field = column.field(name)
        ends = field.offsets.to_pylist()
        flat = field.values.slice(ends[0], ends[-1] - ends[0]).to_numpy().tolist()
        lists.append([flat[a - ends[0] : b - ends[0]] for a, b in pairwise(ends)])
    for row in zip(*lists, strict=True):
        yield Tree.from_row(dict(zip(LISTS, row, strict=True)))


def _texts(column: pa.Array) -> tuple[pa.Array, list[str]]:
    """A column of texts with nulls made empty, in Arrow and in Python."""
    column = pa.compute.fill_null(column, "")
    return column, column.to_numpy(zero_copy_only=False).tolist()


def _counter(pattern: str, ranks: dict[bytes, int]) -> Counter:
    """A worker's counter of this vocabulary, kept with what it has counted."""
    return kept_by_worker(("counter", pattern, hash(frozenset(ranks.items()))), lambda: Counter(pattern, ranks))


def default_vocabulary() -> tuple[str, dict[bytes, int]]:
    """Pattern and ranks of a public byte-level BPE."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return public_tokenizers.PATTERN, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def build(docs: DataFrame, vocabulary: tuple[str, dict[bytes, int]] | None = None) -> DataFrame:
    """doc_id, text, n_tokens and the tree: one row per row of ``docs``. Null text: as the empty text, no tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or default_vocabulary())

    def body(parts: Iterator) -> Iterator[dict]:
        counter = None
        for p in parts:
            counter = counter or _counter(*shared.value)
            column, texts = _texts(p.column("text"))
            trees = [Tree.of(t, counter) for t in texts]
            yield {"doc_id": p.column("doc_id"), "text": column, "n_tokens": [t.tokens for t in trees], "tree": packed(trees)}

    return map_texts(docs.select("doc_id", "text"), f"doc_id long, text string, n_tokens long, {TREE}", body)


def update(trees: DataFrame, edits: Column, vocabulary: tuple[str, dict[bytes, int]] | None = None) -> DataFrame:
    """``build``'s rows with edits applied in order: doc_id, text, n_tokens, tree, before (tokens), reencoded (code points).

    ``edits`` is array<struct<at: int, cut: int, put: string>>; positions are code points of the text as edited so
    far and are clipped to it; null edits and null ``put`` change nothing and put nothing.
    """
    shared = trees.sparkSession.sparkContext.broadcast(vocabulary or default_vocabulary())

    def body(parts: Iterator) -> Iterator[dict]:
        counter = None
        for p in parts:
            counter = counter or _counter(*shared.value)
            trees = []
            out: dict = {k: [] for k in ("text", "n_tokens", "reencoded")}
            for text, tree, changes in zip(_texts(p.column("text"))[1], unpacked(p.column("tree")), p.column("edits").to_pylist(), strict=True):
                total = 0
                for e in changes or ():
                    if e is not None:
                        text, n = tree.edit(text, e["at"] or 0, e["cut"] or 0, e["put"] or "", counter)
                        total += n
                trees.append(tree)
                for k, v in zip(out, (text, tree.tokens, total), strict=True):
                    out[k].append(v)
            yield out | {"doc_id": p.column("doc_id"), "before": p.column("n_tokens"), "tree": packed(trees)}

    return map_texts(trees.withColumn("edits", edits), f"doc_id long, text string, before long, n_tokens long, {TREE}, reencoded long", body)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, then of its text after three edits: 10 code points cut at a quarter, a word put in the middle, the end replaced."""
    n = F.length("text")
    edit = lambda at, cut, put: F.struct(at.cast("int").alias("at"), F.lit(cut).alias("cut"), F.lit(put).alias("put"))
    edits = F.array(edit(F.floor(n / 4), 10, ""), edit(F.floor(n / 2), 0, " edited"), edit(F.greatest(n - 8, F.lit(0)), 5, "the end."))
    out = update(build(table(spark, sf_dir, "documents")), edits)
    return out.select("doc_id", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("edited_tokens"), F.col("reencoded").alias("reencoded_chars"), F.sha2("text", 256).alias("edited_sha256"))

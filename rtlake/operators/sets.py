"""Semi and anti joins, differences, digests and plans of what to recompute."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unresolved(uses: DataFrame, declared: DataFrame, use: str, name: str) -> DataFrame:
    """Distinct values of ``use`` that nothing declares."""
    return uses.select(use).distinct().join(declared.select(F.col(name).alias(use)), use, "left_anti")


def used_elsewhere(declared: DataFrame, uses: DataFrame, on: Column) -> DataFrame:
    """Rows of ``declared`` for which a use satisfies ``on``."""
    return declared.join(uses, on, "left_semi")


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Multiset difference both ways, with ``change`` 'added' or 'removed'."""
    return after.exceptAll(before).withColumn("change", F.lit("added")).unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))


def _framed(parts: Sequence[Column]) -> Column:
    return F.concat(*[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts])


def digest(df: DataFrame, keys: Sequence[str], parts: Sequence[Column], order: Sequence[str], name: str = "digest") -> DataFrame:
    """SHA-256 for each key over its rows' fields in ``order``; every field carries its length, so no two row lists share a text.

    A key's rows meet in one task as a short text each: keys are files, whose rows are bounded.
    """
    text = _framed(parts)
    rows = F.sort_array(F.collect_list(F.struct(*order, text.alias("__text"))))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["__text"]), ""), 256).alias(name))


def streamed_digest(df: DataFrame, keys: Sequence[str], parts: Sequence[Column], order: Sequence[str], name: str = "digest") -> DataFrame:
    """``digest`` for keys with any number of rows: one exchange brings them in order, and they are hashed one after another, never held at once.

    A hash of an ordered list can't be split, so a key is one task's work, of bounded memory; the sort spills.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructType

    out = StructType([*df.select(*keys).schema.fields]).add(name, StringType())
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple, state) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, state.hexdigest()), schema, strict=True)], schema=schema)

        key, state = None, None
        for b in batches:
            own = zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)
            for k, text in zip(own, b.column("__text").to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        yield row(key, state)
                    key, state = k, hashlib.sha256()
                if text is not None:
                    state.update(text.encode())
        if state is not None:
            yield row(key, state)

    rows = df.select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], _framed(parts).alias("__text"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"__o{i}" for i in range(len(order))], "__text")
    return rows.select(*keys, "__text").mapInArrow(run, out)


#: Ids, or nodes, that one node of a hash tree covers, and levels above the rows.
FAN, LEVELS = 1_024, 3


def hash_tree(df: DataFrame, keys: Sequence[str], parts: Sequence[Column], id_: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Nodes (keys, level, node, hash) of a hash tree over each key's rows: at level 1 for every ``fan`` ids, at the next for every
    ``fan`` nodes, and at last, at level ``levels`` + 1, one for the key.

    A key of any size is dealt out by ranges of ids: no group is larger than ``fan`` rows or nodes, but for rows that repeat an
    id and, at the top, keys with more than ``fan`` ** (``levels`` + 1) ids. A node's hash is that of its rows, framed as in ``digest``, or of
    its children's numbers and hashes, in order.
    """
    listed = lambda text: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(text)), lambda r: r["said"]), ""), 256).alias("hash")
    node = F.floor(F.col(id_) / fan).cast("long")
    at = df.select(*keys, F.col(id_).alias("__id"), node.alias("node"), _framed(parts).alias("said")).groupBy(*keys, "node").agg(listed(F.struct("__id", "said")))
    out = at.select(*keys, F.lit(1).alias("level"), "node", "hash")
    for level in range(2, levels + 2):
        above = F.floor(F.col("node") / fan).cast("long") if level <= levels else F.lit(0).cast("long")
        said = F.concat(F.col("node").cast("string"), F.lit(":"), F.col("hash"), F.lit(";"))
        at = at.select(*keys, above.alias("node"), F.col("node").alias("child"), said.alias("said")).groupBy(*keys, "node").agg(listed(F.struct("child", "said")))
        out = out.union(at.select(*keys, F.lit(level), "node", "hash"))
    return out


def unequal_ranges(one: DataFrame, other: DataFrame, keys: Sequence[str], fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(keys, node) of the ranges of ids, of ``fan`` each, in which two trees differ: only nodes below unequal ones are compared. Null keys equal none."""
    narrow, below = None, [*keys, "node"]
    for level in range(levels + 1, 0, -1):
        a, b = (t.filter(F.col("level") == level).select(*below, F.col("hash").alias(n)) for t, n in ((one, "a"), (other, "b")))
        if narrow is not None:
            above = F.floor(F.col("node") / fan).cast("long") if level < levels else F.lit(0).cast("long")
            a, b = (t.withColumn("above", above).join(narrow, [*keys, "above"], "left_semi").drop("above") for t in (a, b))
        differ = a.join(b, below, "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*below)
        narrow = differ.withColumnRenamed("node", "above")
    return differ


def plan(now: DataFrame, stored: DataFrame, key: str, version: str) -> DataFrame:
    """What to do with each key: compile (new or changed), keep (same version) or remove (gone)."""
    both = now.select(key, F.col(version).alias("__now")).join(stored.select(key, F.col(version).alias("__then")), key, "full")
    action = F.when(F.col("__now").isNull(), "remove").when(F.col("__then").isNull() | (F.col("__now") != F.col("__then")), "compile").otherwise("keep")
    return both.select(key, action.alias("action"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each table: its name and its number of rows, in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.union(one)
    return out


def stale(now: DataFrame, stored: DataFrame, key: str, version: str) -> DataFrame:
    """Counts of changed, missing and unknown keys, and three examples in order."""
    acts = now.select(key, F.col(version).alias("__now")).join(stored.select(key, F.col(version).alias("__then")), key, "full")
    state = F.when(F.col("__now").isNull(), "missing").when(F.col("__then").isNull(), "unknown").when(F.col("__now") != F.col("__then"), "changed")
    odd = acts.withColumn("state", state).filter("state IS NOT NULL")
    count = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(f"n_{s}")
    totals = odd.agg(count("changed"), count("missing"), count("unknown"))
    first = odd.orderBy(key).limit(3).agg(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ", ").alias("examples"))
    return totals.crossJoin(F.broadcast(first))  # two tables of one row

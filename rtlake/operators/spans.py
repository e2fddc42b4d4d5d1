"""Positions in scopes: containment, innermost scope, closest declaration before, order of units."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(line: Column, col: Column, begin: tuple[Column, Column], end: tuple[Column, Column]) -> Column:
    """Whether a scope holds a position; an end column of 0 stands for the whole end line."""
    after = (line > begin[0]) | ((line == begin[0]) & (col >= begin[1]))
    before = (line < end[0]) | ((line == end[0]) & ((end[1] == 0) | (col <= end[1])))
    return after & before


def innermost(points: DataFrame, rows: DataFrame, keys: Sequence[str], at: Column, begin: Column, end: Column, ids: Sequence[str], take: Sequence[str]) -> DataFrame:
    """For each point (by ``ids``) the innermost span that holds it, with ``take`` of its columns; points in none drop out.

    ``at`` is a point's position, ``begin`` and ``end`` are a span's: arrays of long, compared from the left, both ends
    included. Innermost is the span that began last; of those that began together the one that ends first, and of equal
    spans the one with the largest ``take``. Spans may nest to any depth, touch or cross.

    Points and spans of a key are merged, sorted and read once: a stack holds the open spans, of which an inner one never
    ends after an outer one, as one that does hides what lies below it for good. So the work is linear after the sort,
    nothing is paired, and a task holds no more than the spans open at one place, whatever a key has. Equal nulls in
    keys count as equal; points and spans without a position drop out.
    """
    keyed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    none = lambda df, names: F.lit(None).cast(df.select(F.struct(*names).alias("s")).schema["s"].dataType)
    left = points.select(*keyed, at.alias("__at"), F.lit(None).cast("array<long>").alias("__end"), F.lit(1).alias("__side"), F.struct(*ids).alias("__id"), none(rows, take).alias("__take"))
    right = rows.select(*keyed, begin.alias("__at"), end.alias("__end"), F.lit(0).alias("__side"), none(points, ids).alias("__id"), F.struct(*take).alias("__take"))
    names = [f"__k{i}" for i in range(len(keys))]
    merged = left.unionByName(right.filter(F.col("__end").isNotNull())).filter(F.col("__at").isNotNull()).withColumn("__end", F.col("__end").cast("array<long>")).withColumn("__at", F.col("__at").cast("array<long>"))
    ordered = merged.repartition(*names).sortWithinPartitions(*names, "__at", "__side", F.desc("__end"), "__take")
    types = merged.select("__id", "__take").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack = None, []
        for b in batches:
            ids_, takes = [], []
            where = list(zip(*[b.column(n).to_pylist() for n in names], strict=True)) if names else [()] * b.num_rows
            for k, place, until, side, id_, took in zip(where, *[b.column(n).to_pylist() for n in ("__at", "__end", "__side", "__id", "__take")], strict=True):
                if k != key:
                    key, stack = k, []
                if side:
                    while stack and stack[-1][0] < place:
                        stack.pop()
                    if stack:
                        ids_.append(id_)
                        takes.append(stack[-1][1])
                elif until >= place:
                    while stack and stack[-1][0] <= until:
                        stack.pop()
                    stack.append((until, took))
            yield pa.RecordBatch.from_arrays([pa.array(ids_, b.schema.field("__id").type), pa.array(takes, b.schema.field("__take").type)], names=["__id", "__take"])

    return ordered.mapInArrow(run, types).select("__id.*", "__take.*")


def latest_holding(points: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, since: str, until: str, ids: Sequence[str], take: Sequence[str]) -> DataFrame:
    """For each point the latest span that began before it, if it still holds it (``at`` <= ``until``); points in none drop out.

    For spans whose ends never fall in the order of (``since``, ``take``), so that none holds a point beyond the end of
    the latest. Points and spans are merged and read once in order, never paired.
    """
    from pyspark.sql import Window

    left = points.select(*keys, F.col(at).alias("__t"), F.lit(0).alias("__side"), F.struct(*ids).alias("__id"), F.lit(None).alias("__row"))
    right = rows.select(*keys, F.col(since).alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__id"), F.struct(*take, F.col(until).alias("__until")).alias("__row"))
    upto = Window.partitionBy(*keys).orderBy("__t", "__side", F.col("__row")).rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("__hit", F.last("__row", True).over(upto)).filter("__side = 0 AND __t <= __hit.__until")
    return found.select(*[F.col(f"__id.{c}").alias(c) for c in ids], *[F.col(f"__hit.{c}").alias(c) for c in take])


def closest_before(points: DataFrame, rows: DataFrame, keys: Sequence[str], at: str, since: str, ids: Sequence[str], take: Sequence[str]) -> DataFrame:
    """As-of lookup: for each point the last row at or before it, else the earliest row; null where the key has none.

    Points and rows are merged and read once in order, so a key's rows are never paired with all its points.
    """
    from pyspark.sql import Window

    what = F.struct(*take)
    left = points.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*ids).alias("__id"), F.lit(None).alias("__row"))
    right = rows.select(*keys, F.col(since).alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__id"), what.alias("__row"))
    merged = left.unionByName(right)
    upto = Window.partitionBy(*keys).orderBy("__t", "__side", F.col("__row")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy("__t", "__side", F.col("__row")).rowsBetween(0, Window.unboundedFollowing)
    found = merged.withColumn("__hit", F.coalesce(F.last("__row", True).over(upto), F.first("__row", True).over(after))).filter("__side = 1")
    return found.select(*keys, *[F.col(f"__id.{c}").alias(c) for c in ids], *[F.col(f"__hit.{c}").alias(c) for c in take])


def chain(scope: Column, separator: str = "::") -> Column:
    """A scope and all that enclose it, innermost first, ending with the empty scope."""
    parts = F.filter(F.split(scope, separator), lambda p: p != "")
    steps = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    return F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(steps)


def unit_order(sites: Column) -> Column:
    """Sort key of a place in a unit: include lines from the outermost, padded, so that text order is reading order and a prefix comes first."""
    return F.array_join(F.transform(sites, lambda n: F.lpad(n.cast("string"), 9, "0")), ".")

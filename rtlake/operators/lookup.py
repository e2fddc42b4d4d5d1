"""Lookups over index tables: names, prefixes, scopes, federations of libraries, first-wins choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose ``column`` is ``name``, byte for byte; the filter reaches the scan."""
    return df.filter(F.col(column) == name)


def prefix(df: DataFrame, column: str, start: str) -> DataFrame:
    """Rows whose ``column`` begins with ``start`` literally, ASCII letters in either case.

    The comparison lower-cases A-Z only, so other letters must match exactly.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fold = lambda c: F.translate(c, upper, lower)
    return df.filter(fold(F.col(column)).startswith(fold(F.lit(start))))


def in_scope(df: DataFrame, scope: str, name: str | None = None, column: str = "scope") -> DataFrame:
    """Rows of one scope, optionally of one name."""
    found = df.filter(F.col(column) == scope)
    return found if name is None else found.filter(F.col("name") == name)


def federated(main: DataFrame, *libraries: DataFrame) -> DataFrame:
    """One table over the project (lib_ord 0) and its libraries in attach order; columns that an older library lacks are null."""
    out = main.withColumn("lib_ord", F.lit(0))
    for k, lib in enumerate(libraries, 1):
        out = out.unionByName(lib.withColumn("lib_ord", F.lit(k)), allowMissingColumns=True)
    return out


def first_wins(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """Of each key's rows the first by ``order``. One key's rows needn't be sorted: Spark limits each group before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).filter("__nth = 1").drop("__nth")


def first_wins_then(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: Column) -> DataFrame:
    """First by ``order`` for each key, and only then the filter: a name hidden by the filter stays hidden."""
    return first_wins(df, keys, *order).filter(keep)


def cut_at_first_repeat(df: DataFrame, group: Sequence[str], order: str, name: str) -> DataFrame:
    """Of each group, by ``order``, the rows before the first whose ``name`` has come before."""
    seen = Window.partitionBy(*group, name).orderBy(order)
    run = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("__again", (F.row_number().over(seen) > 1).cast("int"))
    return marked.withColumn("__cut", F.max("__again").over(run)).filter("__cut = 0").drop("__again", "__cut")


def with_targets(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges joined to what they point at; unknown targets drop out."""
    return edges.join(nodes, key)


def ranked(df: DataFrame, *order: Column | str, width: int = 5) -> DataFrame:
    """Adds ``rank_text``: the place by ``order`` from 0, padded with zeros so that text order is rank order.

    The place needs one global order; the input is what a search kept, not a table.
    """
    return df.withColumn("rank_text", F.lpad((F.row_number().over(Window.orderBy(*order)) - 1).cast("string"), width, "0"))


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows by ``order``: each partition keeps k, and one task merges them."""
    return df.orderBy(*order).limit(k)

"""Immutable forms of the index's updates: each takes tables and returns the table after the change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_by_key(table: DataFrame, rows: DataFrame, keys: Sequence[str], touched: DataFrame | None = None) -> DataFrame:
    """Replaces all rows of the keys in ``touched`` (those of ``rows`` if not given); keys touched without rows vanish."""
    gone = (touched if touched is not None else rows).select(*keys).distinct()
    return table.join(gone, list(keys), "left_anti").select(*table.columns).unionByName(rows)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``rows`` replace those of equal keys; columns in ``keep`` retain the old value where there is one."""
    old = table.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep])
    merged = rows.join(old, list(keys), "left").withColumns({c: F.coalesce(f"__old_{c}", c) for c in keep})
    return table.join(rows.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(merged.select(*table.columns))


def insert_missing(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the rows whose keys are new."""
    return table.unionByName(rows.join(table.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)).select(*table.columns))


def delete(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(*table.columns)


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Deletes rows of all ``tables`` that refer to a key in ``gone``."""
    return {name: delete(t, gone, [key]) for name, t in tables.items()}


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` isn't true (null counts as not true)."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows that share a key the one written last."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])

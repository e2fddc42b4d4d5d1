"""Projects over one index: their settings, their units, and stored inputs of checks. Each change returns the table after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtlake.operators import writes

#: A file's stored hash is trusted unless its time lies within so many ns of the moment it was read (fixed value).
RACY_NS = 2_000_000_000


def info(projects: DataFrame, config: str) -> DataFrame:
    """A project's settings by its config path: one row or none."""
    return projects.filter(F.col("config") == config)


def put(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` replace those of equal keys."""
    return writes.upsert(table, rows, list(keys))


def units(members: DataFrame, files: DataFrame, config: str) -> DataFrame:
    """(path, origin) of a project's units (config, file_id, origin), by path."""
    return members.filter(F.col("config") == config).join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "origin").orderBy("path")


def without(members: DataFrame, config: str, file_id: int) -> DataFrame:
    return writes.delete_where(members, (F.col("config") == config) & (F.col("file_id") == file_id))


def shared(members: DataFrame, config: str) -> DataFrame:
    """(file_id) of a project's units that another project has too."""
    own, others = members.filter(F.col("config") == config), members.filter(F.col("config") != config)
    return own.select("file_id").distinct().join(others.select("file_id").distinct(), "file_id", "left_semi")


def put_checks(checks: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored check inputs (file_id, kind, data) after ``rows``; rows without data delete."""
    return writes.replace_by_key(checks, rows.filter(F.coalesce(F.size("data") > 0, F.lit(False))), ["file_id", "kind"], rows)


def units_with_checks(checks: DataFrame) -> DataFrame:
    return checks.select("file_id").distinct().orderBy("file_id")


def identified(files: DataFrame, identity: DataFrame) -> DataFrame:
    """``files`` (id, hash, size, mtime_ns, stat_ns) with the identity (the same columns) of those it names."""
    new = identity.select("id", *[F.col(c).alias(f"__{c}") for c in identity.columns if c != "id"], F.lit(True).alias("__new"))
    both = files.join(new, "id", "left")
    return both.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c != "id" and c in identity.columns else F.col(c) for c in files.columns])


def trusted(size: Column, mtime: Column, stored_size: Column, stored_mtime: Column, stored_stat: Column) -> Column:
    """Whether a file's stored hash holds without reading it: size and time are as stored, and it was read well after."""
    return F.coalesce((stored_size >= 0) & (size == stored_size) & (mtime == stored_mtime) & (stored_mtime + RACY_NS < stored_stat), F.lit(False))


def current_hash(now: DataFrame, stored: DataFrame) -> DataFrame:
    """``now`` (path, size, mtime_ns, text) -> path, hash, read: the stored hash where it is trusted, else that of the text; null for a file that is gone."""
    old = stored.select("path", "hash", *[F.col(c).alias(f"stored_{c}") for c in ("size", "mtime_ns", "stat_ns")])
    both = now.join(old, "path", "left")
    holds = trusted(F.col("size"), F.col("mtime_ns"), F.col("stored_size"), F.col("stored_mtime_ns"), F.col("stored_stat_ns"))
    return both.select("path", F.when(holds, F.col("hash")).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"), (~holds).alias("read"))


def changed_names(added: DataFrame, removed: DataFrame) -> DataFrame:
    """(name, how) that other units may depend on, of declarations (kind, name, scope): added ones, and what changes with those and the removed.

    A removed name and a scope whose members went count as changed; an added port changes the routine it belongs to.
    """
    tail = F.substring_index("scope", "::", -1)
    scopes = removed.filter("scope <> ''").select(tail.alias("name")).union(added.filter("kind = 'Port' AND scope <> ''").select(tail))
    return added.select("name", F.lit("added").alias("how")).union(removed.select("name").union(scopes).select("name", F.lit("changed"))).distinct()


def rechecked(checks: DataFrame, names: DataFrame, committed: DataFrame) -> DataFrame:
    """(file_id) of units whose stored inputs (file_id, kind, data array<struct<name>>) name one of ``names``, but those just committed."""
    uses = checks.select("file_id", F.explode("data").alias("x")).select("file_id", F.col("x.name").alias("name"))
    return uses.join(names.select("name").distinct(), "name", "left_semi").select("file_id").distinct().join(committed.select("file_id"), "file_id", "left_anti")


def include_notes(errors: DataFrame, sites: DataFrame, depth: int = 64) -> DataFrame:
    """Notes on the compiled file's include directives through which files with errors are read: line, col, end_col, message.

    ``errors``: (ord, file, line, message, is_include); ``sites``: (file, includer, line, col, end_col), an empty includer
    being the compiled file. Include errors come first; two are named and the rest counted.
    """
    outer = sites.filter("includer = '' AND line > 0").select("file", "line", "col", "end_col")
    inner = sites.filter("includer <> ''").select(F.col("file").alias("inner"), F.col("includer").alias("up"))
    reached, frontier = outer, outer
    for _ in range(depth):
        frontier = inner.join(frontier, F.col("up") == F.col("file")).select(F.col("inner").alias("file"), "line", "col", "end_col").join(reached.select("file"), "file", "left_anti")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    else:
        raise RuntimeError(f"includes are more than {depth} deep")
    found = errors.withColumnRenamed("line", "at").join(reached, "file")
    said = F.concat(F.substring_index("file", "/", -1), F.lit(":"), F.col("at").cast("string"), F.lit(": "), "message")
    each = found.select("line", "col", "end_col", F.struct((~F.col("is_include")).alias("late"), "ord", said.alias("said")).alias("e"))
    grouped = each.groupBy("line", "col", "end_col").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list("e")), 1, 2).alias("first"))
    head = F.concat(F.lit("errors below this line's include ("), F.col("n").cast("string"), F.lit("): "))
    rest = F.when(F.col("n") > 2, " | ...").otherwise("")
    return grouped.select("line", "col", "end_col", F.concat(head, F.array_join(F.transform("first", lambda x: x["said"]), " | "), rest).alias("message"))

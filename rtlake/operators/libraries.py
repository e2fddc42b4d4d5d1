"""Libraries: prebuilt indexes that a project attaches, and files that are read only for the types they declare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rtlake.operators import lookup

#: The newest layout that this engine reads.
SCHEMA_VERSION = 20
UNITS = ("Module", "Interface", "Program")


def type_files(symbols: DataFrame, order: DataFrame) -> DataFrame:
    """(name, file): for each type the first file by ``order`` (file, ord) that declares it at top level."""
    declared = symbols.filter(F.col("kind").isin(*UNITS) & (F.col("scope") == "")).select("name", "file")
    return lookup.first_wins(declared.join(order, "file"), ["name"], "ord").select("name", "file")


def paths(libraries: DataFrame) -> DataFrame:
    """(path, lib_ord) of files of attached libraries (lib_ord, id, path): each path once, under the first library that has it."""
    return libraries.groupBy("path").agg(F.min(F.struct("lib_ord", "id")).alias("first")).select("path", F.col("first.lib_ord").alias("lib_ord"), F.col("first.id").alias("id"))


def only_in_library(declared: DataFrame, library_paths: DataFrame, own_paths: DataFrame) -> DataFrame:
    """Of declarations (path, ord) the first in a file that a library has and the project hasn't: one row or none."""
    found = declared.join(library_paths.select("path").distinct(), "path", "left_semi").join(own_paths.select("path").distinct(), "path", "left_anti")
    return found.orderBy("ord").limit(1)


def merged_dirs(own: DataFrame, recorded: DataFrame) -> DataFrame:
    """(dir, place) of include folders: the project's (dir, ord), then those that libraries record (lib_ord, dir, ord), each once, in order."""
    every = own.select("dir", F.lit(0).alias("lib_ord"), "ord").unionByName(recorded.select("dir", (F.col("lib_ord") + 1).alias("lib_ord"), "ord"))
    first = every.groupBy("dir").agg(F.min(F.struct("lib_ord", "ord")).alias("at"))
    return first.select("dir", F.row_number().over(Window.orderBy("at", "dir")).alias("place"))  # one row a folder


def summary(files: Column, symbols: Column) -> Column:
    return F.format_string("%d files, %d symbols", files, symbols)


def problems(info: DataFrame) -> DataFrame:
    """``info`` (exists, error, schema, files, missing array<string>) with ``problems``: (code, what) of all that is wrong with a library, in fixed order."""
    one = lambda code, what: F.struct(F.lit(code).alias("code"), what.cast("string").alias("what"))
    every = [
        F.when(~F.col("exists"), one("absent", F.lit(""))), F.when(F.col("exists") & (F.col("error") != ""), one("unreadable", F.col("error"))),
        *[F.when(F.col("exists") & (F.col("error") == "") & bad, one(code, what)) for code, bad, what in (("newer", F.col("schema") > SCHEMA_VERSION, F.col("schema")), ("empty", F.col("files") == 0, F.lit("")), ("lost_dirs", F.size("missing") > 0, F.array_join("missing", ", ")))],
    ]
    return info.withColumn("problems", F.filter(F.array(*every), lambda x: x.isNotNull()))


def stale_message(changed: Column, missing: Column, total: Column, example: Column) -> Column:
    """One line on a library whose files are no longer those that it was built of; empty if all are."""
    first = F.coalesce(F.concat(F.lit("; first: "), example), F.lit(""))
    return F.when(changed + missing > 0, F.concat(F.format_string("out of date: %d edited, %d missing, of %d", changed, missing, total), first)).otherwise("")


def of_version(tables: dict[str, DataFrame], built_by: str, version: str) -> dict[str, DataFrame]:
    """The tables, or empty ones if another version built them: then every file is built again."""
    return tables if built_by == version else {name: t.filter(F.lit(False)) for name, t in tables.items()}


def client_paths(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """``files`` (path) with ``client``: the path as the client named it, by the longest known folder (canonical, client) above it.

    A path has few folders above it, so these are looked up by equality; files of their own name win.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = files.select("path", F.explode(above).alias("canonical")).join(aliases, "canonical")
    found = found.groupBy("path").agg(F.max_by(F.struct("canonical", "client"), F.length("canonical")).alias("best"))
    named = F.concat(F.col("best.client"), F.substring("path", F.length("best.canonical") + 1, F.length("path")))
    return files.join(found, "path", "left").withColumn("client", F.coalesce(named, "path")).drop("best")


def attached(*libraries: DataFrame) -> DataFrame:
    """Files (id, path) of libraries in attach order, as ``paths`` reads them."""
    return reduce(DataFrame.unionByName, [lib.select("id", "path").withColumn("lib_ord", F.lit(k)) for k, lib in enumerate(libraries)])

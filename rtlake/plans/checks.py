"""Checks across units, whole or for some units alone, and which units an edit elsewhere makes worth checking again.

A check's subjects (instances, imports, calls, type references) are rows of one unit; what they are held against are
names that any unit may declare. ``uses`` inverts that: name -> units whose checks look it up. After an edit, the names
whose declarations differ are looked up there, and only those units' subjects are read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtlake.operators import closure, lookup

Index = dict[str, DataFrame]
#: Severities of diagnostics (fixed values of the protocol).
ERROR, WARNING, INFORMATION = 1, 2, 3
UNITS = ("Module", "Interface", "Program", "Checker")
TYPES = ("Class", "Typedef", "Interface", "TypeParameter", "Covergroup", "Checker", "Module", "Program")
#: Units up to which a filter names them, so that it reaches the scan of a table sorted by unit; more are joined.
NAMED = 500
COLUMNS = ("unit", "file", "line", "col", "end_col", "severity", "source", "subject", "message")


def chosen(keys: DataFrame | None, column: str = "unit") -> Callable[[DataFrame], DataFrame]:
    """A function that keeps a table's rows of ``keys`` (one column): all without keys."""
    if keys is None:
        return lambda table: table
    few = [r[0] for r in keys.limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        return lambda table: table.filter(F.col(column).isin(few))
    return lambda table: table.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")


def path(scope: str = "scope", name: str = "name") -> Column:
    return F.concat_ws("::", F.nullif(F.col(scope), F.lit("")), F.col(name))


def _diagnostic(rows: DataFrame, severity: Column | int, source: str, subject: str, message: Column) -> DataFrame:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    col = F.col("col") if "col" in rows.columns else F.lit(0)
    return rows.select("unit", "file", "line", col.alias("col"), F.lit(0).alias("end_col"), severity.alias("severity"), F.lit(source).alias("source"), F.col(subject).alias("subject"), message.alias("message"))


def check_instances(index: Index, of: Callable[[DataFrame], DataFrame] = chosen(None)) -> DataFrame:
    """Instances of design units that nothing declares: errors, or warnings inside conditional generates."""
    declared = index["symbols"].filter(F.col("kind").isin(*UNITS)).select(F.col("name").alias("type_name"))
    missing = of(index["instantiations"]).join(declared, "type_name", "left_anti")
    return _diagnostic(missing, F.when(F.col("conditional"), WARNING).otherwise(ERROR), "instances", "type_name", F.concat(F.lit("unknown design unit "), "type_name"))


def check_imports(index: Index, of: Callable[[DataFrame], DataFrame] = chosen(None)) -> DataFrame:
    """Imports of unknown packages, and of names that a package doesn't provide, itself or by export."""
    packages = index["symbols"].filter("kind = 'Package'").select(F.col("name").alias("pkg_name")).distinct()
    asked = of(index["imports"]).filter("pkg_name <> '*'")
    unknown = asked.join(packages, "pkg_name", "left_anti")
    named = asked.filter("item <> '*'").join(packages, "pkg_name", "left_semi")
    exports = index["imports"].filter("is_export").select(F.col("scope").alias("package"), F.col("pkg_name").alias("source"), "item")
    own = index["symbols"].filter("scope <> '' AND instr(scope, '::') = 0").select(F.col("scope").alias("package"), "name").distinct()
    given = closure.provided(exports, own, named.select(F.col("pkg_name").alias("package")).distinct()).select(F.col("package").alias("pkg_name"), F.col("name").alias("item"))
    lacking = named.join(given, ["pkg_name", "item"], "left_anti")
    first = _diagnostic(unknown, ERROR, "imports", "pkg_name", F.concat(F.lit("unknown package "), "pkg_name"))
    return first.union(_diagnostic(lacking, ERROR, "imports", "item", F.concat(F.lit("package "), "pkg_name", F.lit(" doesn't provide "), "item")))


def check_calls(index: Index, of: Callable[[DataFrame], DataFrame] = chosen(None)) -> DataFrame:
    """Calls, by names that one routine has, which leave out an argument without a default."""
    calls = of(index["calls"])
    routines = index["symbols"].filter(F.col("kind").isin("Function", "Task")).select(F.col("name").alias("callee"), path().alias("inner")).join(calls.select("callee").distinct(), "callee", "left_semi")
    single = routines.groupBy("callee").agg(F.min("inner").alias("inner"), F.countDistinct("inner").alias("n")).filter("n = 1").drop("n")
    ports = index["symbols"].filter("kind = 'Parameter'").select(F.col("scope").alias("inner"), "name", F.contains("detail", F.lit("\x1f")).alias("has_default"), (F.col("line") * 10_000 + F.col("col")).alias("nth"))
    cut = lookup.cut_at_first_repeat(ports.join(single.select("inner"), "inner", "left_semi"), ["inner"], "nth", "name")
    listed = cut.groupBy("inner").agg(F.sort_array(F.collect_list(F.struct("nth", "name", "has_default"))).alias("ports"))
    both = calls.join(single, "callee").join(listed, "inner")
    named = F.transform(F.filter("args", lambda a: a["kind"] == "named"), lambda a: a["name"])

    def lacks(p: Column, i: Column) -> Column:
        slot = F.get("args", i)
        return ~p["has_default"] & ~(F.coalesce(slot["kind"] == "positional", F.lit(False)) | F.array_contains(named, p["name"]))

    missing = both.withColumn("missing", F.transform(F.filter("ports", lacks), lambda p: p["name"])).filter(F.size("missing") > 0)
    return _diagnostic(missing, ERROR, "calls", "callee", F.concat(F.lit("call of "), "callee", F.lit(" lacks "), F.array_join("missing", ", ")))


def check_types(index: Index, of: Callable[[DataFrame], DataFrame] = chosen(None)) -> DataFrame:
    """References to types that nothing declares."""
    declared = index["symbols"].filter(F.col("kind").isin(*TYPES)).select("name").distinct()
    return _diagnostic(of(index["type_refs"]).join(declared, "name", "left_anti"), WARNING, "types", "name", F.concat(F.lit("unknown type "), "name"))


def check_includes(index: Index, of: Callable[[DataFrame], DataFrame] = chosen(None)) -> DataFrame:
    """Files that more than one file includes (information). The row belongs to the included file, which stands for the unit."""
    often = of(index["include_sites"]).groupBy("file").agg(F.countDistinct("includer").alias("n")).filter("n > 1")
    return _diagnostic(often.withColumns({"line": F.lit(1), "unit": F.col("file")}), INFORMATION, "includes", "file", F.concat(F.lit("included by "), F.col("n").cast("string"), F.lit(" files")))


def problems(index: Index, units: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """All checks' diagnostics with their unit, or those of the subjects of ``units`` and of included ``files`` alone."""
    of, among = chosen(units), chosen(files, "file")
    return check_instances(index, of).union(check_imports(index, of)).union(check_calls(index, of)).union(check_types(index, of)).union(check_includes(index, among))


def uses(index: Index) -> DataFrame:
    """(name, unit): the names that a unit's checks look up."""
    parts = [index["instantiations"].select(F.col("type_name").alias("name"), "unit"), index["calls"].select(F.col("callee").alias("name"), "unit"), index["type_refs"].select("name", "unit"), index["imports"].select(F.col("pkg_name").alias("name"), "unit")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def changed_names(old: Index, new: Index, files: DataFrame, units: DataFrame) -> DataFrame:
    """(name) of what is declared otherwise in ``files`` than before, of the routines and packages that it belongs to, and of
    packages that hand on, in any number of steps, names of those.

    A port's place among its routine's counts as part of it. ``units``: those whose exports may differ.
    """
    in_files, of_units = chosen(files, "file"), chosen(units)

    def described(index: Index) -> DataFrame:
        ports = F.col("kind").isin("Port", "Parameter")
        place = F.when(ports, F.col("line") * 10_000 + F.col("col"))
        rows = in_files(index["symbols"]).select("file", "kind", "name", "scope", "detail", place.alias("place"))
        listed = rows.filter(place_known := F.col("place").isNotNull()).groupBy("file", "scope").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "name", "detail"))), lambda p: F.concat_ws("\x1e", p["name"], p["detail"])), "\x1d").alias("detail"))
        return rows.filter(~place_known).drop("place").union(listed.select("file", F.lit("ports").alias("kind"), F.lit("").alias("name"), "scope", "detail"))

    def exported(index: Index) -> DataFrame:
        return of_units(index["imports"]).filter("is_export").select(F.col("scope").alias("name"), "pkg_name", "item")

    before, after = described(old), described(new)
    differ = before.exceptAll(after).union(after.exceptAll(before))
    gave, gives = exported(old), exported(new)
    names = differ.select("name").union(differ.select(F.substring_index("scope", "::", -1))).union(differ.select(F.substring_index("scope", "::", 1))).union(gave.exceptAll(gives).union(gives.exceptAll(gave)).select("name"))
    names = closure.cut(names.filter("name <> ''").distinct())
    hands_on = lambda index: index["imports"].filter("is_export AND item = '*'").select(F.col("pkg_name").alias("src"), F.col("scope").alias("dst"))
    return closure.reach(hands_on(old).union(hands_on(new)), names.select(F.col("name").alias("root"))).select(F.col("node").alias("name")).distinct()


def merged(old: DataFrame, fresh: DataFrame, units: DataFrame, files: DataFrame) -> DataFrame:
    """``old`` diagnostics after ``fresh`` ones, which replace those of ``units``, and of ``files`` what says who includes them."""
    about_files = F.col("source") == "includes"
    kept = old.filter(~about_files).join(units.select("unit").distinct(), "unit", "left_anti")
    rest = old.filter(about_files).join(files.select(F.col("file").alias("unit")).distinct(), "unit", "left_anti")
    return kept.select(*COLUMNS).union(rest.select(*COLUMNS)).union(fresh.select(*COLUMNS))

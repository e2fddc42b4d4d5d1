"""Questions about an index: definitions, references, symbols, completion, signatures, checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtlake.functions import text as T
from rtlake.functions.code import occurrences
from rtlake.functions.names import is_forward
from rtlake.operators import closure, lookup, spans, subsequences
from rtlake.plans.checks import UNITS, chosen, problems
from rtlake.plans.index import shown

Index = dict[str, DataFrame]
ROUTINES = ("Function", "Task", "Constructor")
HIDDEN = ("Block", "Constructor")


def declares(kind: Column) -> Column:
    """Whether rows of this kind declare something that other files can name."""
    return kind.isin("Module", "Interface", "Program", "Package", "Class", "Function", "Task", "Typedef", "Checker", "Parameter", "Covergroup")


def best(rows: DataFrame, file: str) -> DataFrame:
    """Of rows with one name the best: in the same file and no forward, then declarations, then any that is no forward, then the first."""
    forward = is_forward(F.col("kind"), F.col("detail"))
    rank = F.when((F.col("file") == file) & ~forward, 0).when(declares(F.col("kind")) & ~forward, 1).when(~forward, 2).otherwise(3)
    return lookup.first_wins(rows, ["name"], rank, "file", "line", "col")


def by_name(index: Index, name: str) -> DataFrame:
    return lookup.exact(index["symbols"], "name", name).orderBy("file", "line")


def scope_at(index: Index, file: str, line: int, col: int) -> DataFrame:
    """The innermost scope that holds a position: one row or none."""
    own = index["symbols"].filter((F.col("file") == file) & (F.col("end_line") > 0))
    at = F.lit(line), F.lit(col)
    held = own.filter(spans.contains(*at, (F.col("line"), F.col("col")), (F.col("end_line"), F.col("end_col"))))
    path = F.when(F.col("scope") == "", F.col("name")).otherwise(F.concat_ws("::", "scope", "name"))
    return held.withColumn("path", path).orderBy(F.desc(F.length("path")), F.desc("line"), F.desc("col")).limit(1).select("path", "kind")


def chain_of(index: Index, file: str, line: int, col: int) -> list[str]:
    """Scopes around a position, innermost first, the empty one last."""
    found = scope_at(index, file, line, col).first()
    path = found["path"] if found else ""
    parts = path.split("::") if path else []
    return ["::".join(parts[:n]) for n in range(len(parts), -1, -1)]


def ancestors(index: Index, name: str) -> DataFrame:
    """(name, depth, scope, file) of a class and those it extends, nearest first; typedef aliases are followed, cycles cut."""
    classes = index["symbols"].filter("kind = 'Class'").select(F.col("name").alias("node"), F.nullif(T.scope_tail(F.col("detail")), F.lit("")).alias("parent"))
    alias = index["symbols"].filter("kind = 'Typedef'").filter(~is_forward(F.col("kind"), F.col("detail"))).select(F.col("name").alias("node"), T.scope_tail(F.col("detail")).alias("parent"))
    start = index["symbols"].sparkSession.createDataFrame([(name,)], "root string")
    found = closure.ancestors(classes.union(alias), start).select(F.col("node").alias("name"), "depth")
    return found.join(index["symbols"].filter("kind = 'Class'").select("name", "scope", "file"), "name")


def members(index: Index, name: str) -> DataFrame:
    """Members of a class over its chain: the nearest of a name wins, and then the ancestors' local ones are hidden."""
    chain = ancestors(index, name).select(F.concat_ws("::", F.nullif("scope", F.lit("")), "name").alias("scope"), "depth")
    rows = index["symbols"].join(F.broadcast(chain), "scope").filter(~F.col("kind").isin(*HIDDEN))
    return lookup.first_wins_then(rows, ["name"], ["depth", "line", "col"], (F.col("access") != "local") | (F.col("depth") == 0))


def visible(index: Index, file: str, line: int, col: int) -> DataFrame:
    """What a position sees: its own scopes, the enclosing class's chain, imports, and other files' top level, nearest first."""
    scopes = chain_of(index, file, line, col)
    symbols, spark = index["symbols"], index["symbols"].sparkSession
    levels = spark.createDataFrame([(s, i) for i, s in enumerate(scopes)], "scope string, level int")
    own = symbols.filter(F.col("file") == file).join(F.broadcast(levels), "scope")
    later = own["kind"].isin("Variable", "Net", "Parameter", "Genvar", "Typedef") & (F.col("line") > line) & (F.col("scope") != "")
    arms = [own.filter(~later).withColumn("arm", F.lit(0))]
    wanted = index["imports"].filter((F.col("file") == file) & F.col("scope").isin(scopes) & ~F.col("is_export")).select("pkg_name", "item").distinct()
    packages = wanted.select(F.col("pkg_name").alias("root"))
    exports = index["imports"].filter("is_export").select(F.col("scope").alias("src"), F.col("pkg_name").alias("dst"))
    reached = closure.reach(exports, packages).select(F.col("root").alias("pkg_name"), F.col("node").alias("scope"))
    given = symbols.join(reached.join(wanted, "pkg_name"), "scope").filter("item = '*' OR item = name").drop("pkg_name", "item")
    arms.append(given.withColumn("level", F.lit(len(scopes))).withColumn("arm", F.lit(1)).select(*arms[0].columns))
    top = symbols.filter((F.col("file") != file) & (F.col("scope") == "")).withColumn("level", F.lit(len(scopes))).withColumn("arm", F.lit(2))
    arms.append(top.select(*arms[0].columns))
    classes = [r["name"] for r in symbols.filter((F.col("kind") == "Class") & F.concat_ws("::", F.nullif("scope", F.lit("")), "name").isin(scopes)).select("name").collect()]
    for name in classes:
        arms.append(members(index, name).withColumn("level", F.lit(len(scopes) - 1)).withColumn("arm", F.lit(1)).select(*arms[0].columns))
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return out


def definition(index: Index, file: str, line: int, col: int, name: str, qualifier: str = "") -> DataFrame:
    """Declaration of a name at a position, with ``exact``: whether scope rules found it or only its name did."""
    if qualifier:
        rows = index["symbols"].filter((F.col("name") == name) & ((F.col("scope") == qualifier) | F.col("scope").endswith("::" + qualifier)))
        rows = rows.withColumns({"arm": F.lit(0), "level": F.lit(0)})
    else:
        rows = visible(index, file, line, col).filter(F.col("name") == name)
    forward = is_forward(F.col("kind"), F.col("detail")).cast("int")
    found = lookup.first_wins(rows, ["name"], forward, "arm", "level", "file", "line", "col").withColumn("exact", F.lit(True))
    rest = best(by_name(index, name), file).withColumn("exact", F.lit(False))
    return found.select(*rest.columns).union(rest.join(found.select("name"), "name", "left_anti"))


def macro(index: Index, name: str, file: str, line: int) -> DataFrame:
    """A macro by proximity: the last definition before the place in its file, else another file's, else the first after."""
    rows = lookup.exact(index["macros"], "name", name)
    before = (F.col("file") == file) & (F.col("line") <= line)
    rank = F.when(before, 0).when(F.col("file") != file, 1).otherwise(2)
    return lookup.first_wins(rows, ["name"], rank, F.when(before, -F.col("line")).otherwise(F.col("line")), "file")


def references(index: Index, files: DataFrame, name: str) -> DataFrame:
    """(file, line, col, declaration) of a name's occurrences outside comments and strings.

    Only files in which the index has seen the name are opened: few paths are a filter that reaches the scan of texts.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, line, col) for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True) for _, line, col in occurrences(t, name)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=["file", "line", "col"])

    holds = chosen(lookup.exact(index["words"], "name", name).select("path"), "path")
    found = holds(files).select("path", "text").mapInArrow(find, "file string, line int, col int")
    declared = lookup.exact(index["symbols"], "name", name).select("file", "line", "col", F.lit(True).alias("__d")).distinct()
    return found.join(declared, ["file", "line", "col"], "left").select("file", "line", "col", F.coalesce("__d", F.lit(False)).alias("declaration"))


def rename(index: Index, files: DataFrame, old: str, new: str, library_files: tuple[str, ...] = ()) -> DataFrame:
    """Edits (file, line, col, end_col, text) that rename; refuses bad names, ``new`` and what a library declares."""
    import re

    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*", new) or old == "new":
        raise ValueError(f"can't rename {old} to {new}")
    if library_files and lookup.exact(index["symbols"], "name", old).filter(F.col("file").isin(*library_files)).limit(1).count():
        raise ValueError(f"{old} is declared in a library")
    return references(index, files, old).select("file", "line", "col", (F.col("col") + len(old)).alias("end_col"), F.lit(new).alias("text"))


def document_symbols(index: Index, file: str) -> DataFrame:
    rows = index["symbols"].filter((F.col("file") == file) & (F.col("kind") != "Block"))
    return rows.filter(~is_forward(F.col("kind"), F.col("detail"))).select("name", "kind", "detail", "line", "col", F.greatest("line", "end_line").alias("end_line"), "end_col", "scope")


def workspace_symbols(index: Index, start: str) -> DataFrame:
    """Symbols and macros by literal prefix; a leading backtick asks for macros alone."""
    macros = lookup.prefix(index["macros"], "name", start.lstrip("`")).select(F.lit("Macro").alias("kind"), "name", "file", "line", "col", F.lit("").alias("container"))
    if start.startswith("`"):
        return macros
    rows = lookup.prefix(index["symbols"].filter(~F.col("kind").isin("Block")), "name", start)
    return rows.select("kind", "name", "file", "line", "col", T.display_scope(F.col("scope")).alias("container")).union(macros)


def fuzzy_symbols(index: Index, pattern: str, most: int = 100) -> DataFrame:
    """Symbols whose names hold ``pattern`` as a subsequence: those of the ``most`` best names, best first, with a rank text.

    The names come from the list of the pattern's rarest pair of characters alone; few names are a filter that reaches the scan.
    """
    rows = shown(index["symbols"])
    best = lookup.top(subsequences.search(rows, index["grams"], index["gram_counts"], pattern), most, F.desc("score"), "name")
    rows = chosen(best.select("name"), "name")(rows).join(best, "name")
    rows = rows.select("kind", "name", "file", "line", "col", T.display_scope(F.col("scope")).alias("container"), "score")
    return lookup.ranked(rows, F.desc("score"), "name", "file", "line", "col")


def hover(index: Index, file: str, line: int, col: int, name: str, qualifier: str = "") -> DataFrame:
    found = definition(index, file, line, col, name, qualifier)
    return found.select("kind", "name", F.replace("detail", F.lit("\x1f"), F.lit(" = ")).alias("detail"), T.doc_markdown(F.col("doc")).alias("doc"), T.display_scope(F.col("scope")).alias("scope"), "exact")


def completion(index: Index, file: str, line: int, col: int, pattern: str = "", receiver_type: str | None = None, most: int | None = None) -> DataFrame:
    """Candidates at a position: of a name and kind the nearest, scored, best first, with a rank text; all of them, or the best ``most``."""
    rows = members(index, receiver_type).withColumns({"arm": F.lit(0), "level": F.col("depth")}) if receiver_type else visible(index, file, line, col)
    rows = rows.filter(~F.col("kind").isin(*HIDDEN))
    scored = rows.withColumn("score", T.fuzzy_score(F.col("name"), F.lit(pattern))).filter("score IS NOT NULL")  # by name, so before the exchange
    scored = lookup.first_wins(scored, ["name", "kind"], "arm", "level", is_forward(F.col("kind"), F.col("detail")).cast("int"), "file", "line", "col")
    kept = lookup.top(scored, most, F.desc("score"), "name") if most else scored
    return lookup.ranked(kept, F.desc("score"), "name").select("name", "kind", "detail", "score", "rank_text", "file", "line")


def signature(index: Index, callee: str, qualifier: str = "") -> DataFrame:
    """(name, scope, label, parameters) of routines or units with a name: parameters in order, cut at the first repeated name."""
    kinds = (*ROUTINES, *UNITS, "Class")
    owner = index["symbols"].filter((F.col("name") == callee) & F.col("kind").isin(*kinds))
    owner = owner.filter(F.col("scope").endswith(qualifier)) if qualifier else owner
    owner = owner.select("name", "scope", "file", "detail", F.concat_ws("::", F.nullif("scope", F.lit("")), "name").alias("inner"))
    ports = index["symbols"].filter(F.col("kind").isin("Port", "Parameter")).select(F.col("scope").alias("inner"), "file", F.col("name").alias("port"), F.col("detail").alias("port_detail"), (F.col("line") * 10_000 + F.col("col")).alias("nth"))
    cut = lookup.cut_at_first_repeat(ports, ["inner", "file"], "nth", "port")
    label = F.concat_ws(" ", F.nullif(F.split_part("port_detail", F.lit("\x1f"), F.lit(1)), F.lit("")), "port")
    listed = cut.groupBy("inner", "file").agg(F.sort_array(F.collect_list(F.struct("nth", label.alias("label")))).alias("ports"))
    both = owner.join(listed, ["inner", "file"], "left").withColumn("parameters", F.coalesce(F.transform("ports", lambda p: p["label"]), F.array().cast("array<string>")))
    return both.select("name", "scope", "file", F.concat("name", F.lit("("), F.array_join("parameters", ", "), F.lit(")")).alias("label"), "parameters")


def checks(index: Index) -> DataFrame:
    """All checks' diagnostics in one table."""
    return problems(index).drop("unit")

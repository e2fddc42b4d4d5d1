"""Builds an index of source units as immutable tables, and refreshes only what changed."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rtlake.functions import text as T
from rtlake.functions.code import NAME, blanked, mapped_column
from rtlake.functions.names import is_forward
from rtlake.operators import closure, sets, subsequences, writes
from rtlake.plans import checks, declare, preprocess
from rtlake.plans.checks import ERROR

#: Tables of an index and the DDL of their rows; each also has ``unit``.
TABLES = {
    "symbols": declare.ROW,
    "imports": declare.IMPORT,
    "instantiations": declare.INSTANCE,
    "calls": declare.CALL,
    "type_refs": declare.TYPE_REF,
    "macros": "name string, body string, line int, col int, file string, is_function_like boolean, params array<struct<name: string, `default`: string>>, doc string",
    "include_sites": "file string, includer string, line int, col int, end_col int",
    "directives": "name string, from_file string, resolved string",
    "metadata": "kind string, value string, file string, line int",
    "diagnostics": "file string, line int, col int, end_col int, severity int, source string, subject string, message string",
}
#: What an index holds besides: nested rows of each unit, of which the tables are made; files and what a scan found in them;
#: which files a unit reads; fingerprints; diagnostics of checks across units, and the names that these look up.
#: ``words`` says in which files a name stands at all, ranged by name; ``grams`` which names of symbols hold which characters in
#: order, ranged by gram, and ``gram_counts`` how many do.
KEPT = ("compiled", "files", "contents", "units", "problems", "uses", "words", "grams", "gram_counts")
_NESTED = "unit string, " + ", ".join(f"{name} array<struct<{re.sub(r'(^|, )(\w+) (?=string|int|boolean|array)', r'\1\2: ', ddl)}>>" for name, ddl in TABLES.items())


@dataclass(frozen=True)
class Config:
    include_dirs: Sequence[str] = ()
    defines: dict[str, str] = field(default_factory=dict)
    preincludes: Sequence[str] = ()

    def key(self) -> str:
        """A text that differs whenever the settings do."""
        parts = [*self.include_dirs, "|", *[x for kv in sorted(self.defines.items()) for x in kv], "|", *self.preincludes]
        return "".join(f"{len(p)}:{p}" for p in parts)


def compiled(unit: str, files: dict[str, str], config: Config) -> dict:
    """All rows of one unit, at the places of their own files."""
    out = preprocess.Preprocessor(files, config.include_dirs, config.defines, config.preincludes).run(unit)
    lines = out["lines"]
    found = declare.declared("\n".join(x["text"] for x in lines), unit)
    starts = [[(s["output_col"], s["delta"]) for s in x["shifts"]] for x in lines]

    def placed(row: dict) -> dict:
        k = min(max(row["line"], 1), len(lines)) - 1
        row = row | {"file": lines[k]["file"], "line": lines[k]["line"]}
        for c in ("col", "pkg_col"):
            if c in row:
                row[c] = mapped_column(starts[k], row[c])
        if row.get("end_line"):
            e = min(row["end_line"], len(lines)) - 1
            row["end_line"] = lines[e]["line"]
        return row

    diagnostics = [e | {"end_col": 0, "severity": ERROR, "source": "preprocess", "subject": ""} for e in out["errors"]]
    diagnostics += [placed(e) | {"end_col": 0, "severity": ERROR, "source": "parse", "subject": ""} for e in found.errors]
    tables = {"symbols": found.rows, "imports": found.imports, "instantiations": found.instances, "calls": found.calls, "type_refs": found.type_refs}
    return {"unit": unit, "macros": out["macros"], "include_sites": out["sites"], "directives": out["directives"], "metadata": out["metadata"], "diagnostics": diagnostics} | {k: [placed(r) for r in v] for k, v in tables.items()}


_INCLUDE = re.compile(r'`include\s*(?:"([^"\n]*)"|<([^>\n]*)>|(`))')
_DEFINED = re.compile(r"`define\s[^\n]*(?:\\\n[^\n]*)*")


_DECLARES = re.compile(r"(?<![\w$])(?:macromodule|module|interface|program|package|class)\s+(?:automatic\s+|static\s+)?([A-Za-z_][\w$]*)")
_NAMES = re.compile(r"(?<![\w$])(?:import|extends|implements)\s+([A-Za-z_][\w$]*)|([A-Za-z_][\w$]*)\s*::")
SCAN = ["path", "hash", "size", "wanted", "computed", "offered", "declares", "names", "identifiers"]
#: Stands in the include graph for whatever macros may name.
_ANY = "`"


def scanned(files: DataFrame) -> DataFrame:
    """(path, hash, size, wanted, computed, offered, declares, names, identifiers) of files (path, text), by a scan of words alone.

    ``wanted``: base names that its includes name; ``computed``: whether one includes what a macro stands for; ``offered``: base
    names in its macros' bodies, which such an include may mean. ``declares``: names of units, packages and classes;
    ``names``: what it imports, extends or qualifies by; ``identifiers``: all names outside comments and strings.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = lambda name: name.replace("\\", "/").rpartition("/")[2]
        for b in batches:
            wanted, computed, offered, declares, said, words = [], [], [], [], [], []
            for text in b.column("text").to_pylist():
                found = _INCLUDE.findall(text or "")
                wanted.append(sorted({base(q or a) for q, a, m in found if not m}))
                computed.append(any(m for _, _, m in found))
                offered.append(sorted({base(x) for d in _DEFINED.findall(text or "") for pair in re.findall(r'"([^"\n]*)"|<([^>\n]*)>', d) for x in pair if x}))
                plain = blanked(text or "")
                declares.append(sorted(set(_DECLARES.findall(plain))))
                said.append(sorted({x for pair in _NAMES.findall(plain) for x in pair if x}))
                words.append(sorted(set(NAME.findall(plain))))
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("hash"), b.column("size"), pa.array(wanted, strings), pa.array(computed, pa.bool_()), *[pa.array(x, strings) for x in (offered, declares, said, words)]], names=SCAN)

    hashed = files.select("path", T.content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("size"), "text")
    return hashed.mapInArrow(scan, "path string, hash string, size long, wanted array<string>, computed boolean, offered array<string>, declares array<string>, names array<string>, identifiers array<string>")


def words_of(scans: DataFrame) -> DataFrame:
    """(name, path): the files that a search for a name must open."""
    return scans.select(F.explode("identifiers").alias("name"), "path")


def shown(symbols: DataFrame) -> DataFrame:
    """Symbols that a search by name lists: neither blocks nor forward declarations."""
    return symbols.filter((F.col("kind") != "Block") & ~is_forward(F.col("kind"), F.col("detail")))


def needed(units: DataFrame, scans: DataFrame, config: Config) -> DataFrame:
    """(unit, path): the files that a unit may read, itself included; a superset, as includes count by their base names.

    Reachability over the include graph, for all units at once. Texts take no part in it.
    """
    places = scans.select("path", T.base_name(F.col("path")).alias("base"))
    given = [x.rpartition("/")[2] for v in config.defines.values() for x in re.findall(r'"([^"]*)"', v)]
    named = lambda xs: F.explode(F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>"))
    offers = scans.select(F.explode("offered").alias("base")).union(units.sparkSession.range(1).select(named(given).alias("base"))).distinct()
    by_name = scans.select(F.col("path").alias("src"), F.explode("wanted").alias("base")).join(places, "base").select("src", F.col("path").alias("dst"))
    by_macro = scans.filter("computed").select(F.col("path").alias("src"), F.lit(_ANY).alias("dst")).union(offers.join(places, "base").select(F.lit(_ANY), "path"))
    edges = closure.cut(by_name.union(by_macro).filter("src <> dst").distinct())
    always = units.select("unit", named([p.rpartition("/")[2] for p in config.preincludes]).alias("base")).join(places, "base").select("unit", "path")
    first = units.select("unit", F.col("unit").alias("path")).union(always)
    if edges.isEmpty():
        return first.distinct()
    reached = closure.reach(edges, first.select(F.col("path").alias("root")).distinct()).select(F.col("root").alias("path"), "node")
    return first.join(reached, "path").select("unit", F.col("node").alias("path")).filter(F.col("path") != _ANY).distinct()


def sent(units: DataFrame, files: DataFrame, scans: DataFrame, config: Config) -> DataFrame:
    """(unit, path, text) of the files that each unit may read."""
    return needed(units, scans, config).join(files.select("path", "text"), "path", "left").select("unit", "path", "text")


def compile_units(units: DataFrame, files: DataFrame, scans: DataFrame, config: Config) -> DataFrame:
    """One nested row for each unit of ``units`` (column ``unit``). Each unit is sent the files that it may read, and no other."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_NESTED))
    names = {f.name: [x.name for x in f.type.value_type] for f in schema if f.name != "unit"}

    def run(group: pa.Table) -> pa.Table:
        unit = group["unit"][0].as_py()
        texts = {p: t for p, t in zip(group["path"].to_pylist(), group["text"].to_pylist(), strict=True) if t is not None}
        row = compiled(unit, texts, config)
        return pa.Table.from_pylist([{"unit": unit} | {n: [{c: r.get(c) for c in cols} for r in row[n]] for n, cols in names.items()}], schema=schema)

    return sent(units, files, scans, config).groupBy("unit").applyInArrow(run, _NESTED)


def tables_of(compiled_units: DataFrame) -> dict[str, DataFrame]:
    """Flat tables; rows of a file that several units include come from its own unit or else from the first of these.

    ``contents`` says which files each unit has rows of, and which of them it gives.
    """
    placed = compiled_units.select("unit", F.explode(F.array_union(F.array_union(F.array("unit"), "symbols.file"), "include_sites.file")).alias("file")).distinct()
    giver = F.row_number().over(Window.partitionBy("file").orderBy(F.col("unit") != F.col("file"), "unit")) == 1
    out = {"contents": placed.withColumn("gives", giver)}
    owners = out["contents"].filter("gives").select("unit", "file")
    for name in TABLES:
        flat = compiled_units.select("unit", F.explode(name).alias("r")).select("unit", "r.*")
        if name in ("symbols", "imports", "instantiations", "calls", "type_refs"):
            flat = flat.join(owners, ["unit", "file"], "left_semi")
        out[name] = flat.dropDuplicates() if name in ("diagnostics", "metadata") else flat
    return out


def settled(rows: DataFrame, files: DataFrame, scans: DataFrame, libraries: DataFrame, config: Config, limit: int = 64) -> tuple[DataFrame, DataFrame]:
    """(compiled rows, all units) after waves of library files: each compiles, in one job, the files that declare what the last one
    names and nothing declares, until no such name is left that a library has.

    ``libraries``: (path, ord); of several files that declare a name the first by ord and path counts. Only what the last wave
    names is looked up, so a wave's work follows its own size.
    """
    offers = libraries.join(scans.select("path", F.explode("declares").alias("name")), "path")
    offers = closure.cut(offers.groupBy("name").agg(F.min(F.struct("ord", "path")).alias("at")).select("name", F.col("at.path").alias("unit")))
    done, last = closure.cut(rows.select("unit")), rows
    for _ in range(limit):
        parents = F.transform(F.filter("symbols", lambda x: x["kind"] == "Class"), lambda x: T.scope_tail(x["detail"]))
        parts = (F.col("imports.pkg_name"), F.col("type_refs.name"), parents)
        uses = last.select(F.explode(reduce(F.array_union, parts, F.col("instantiations.type_name"))).alias("name")).distinct()
        known = rows.select(F.explode(F.transform(F.filter("symbols", lambda x: (x["scope"] == "") | x["kind"].isin("Class", "Typedef", "TypeParameter")), lambda x: x["name"])).alias("name"))
        more = closure.cut(uses.join(known.distinct(), "name", "left_anti").join(offers, "name").select("unit").distinct().join(done, "unit", "left_anti"))
        if more.isEmpty():
            return rows, done
        last = closure.cut(compile_units(more, files, scans, config))
        rows, done = closure.cut(rows.union(last)), closure.cut(done.union(more))
    raise RuntimeError(f"no fixpoint after {limit} waves")


def build(files: DataFrame, units: DataFrame, config: Config, folder: str | None = None, libraries: DataFrame | None = None) -> dict[str, DataFrame]:
    """The index of ``units`` over ``files`` (path, text): ``TABLES`` and what ``KEPT`` names.

    With a ``folder`` the tables are written there as Parquet, symbols clustered by name, and read again. With ``libraries``
    (path, ord; files of ``files``) those that declare what the units name and nothing declares are units too.
    """
    scans = closure.cut(scanned(files))
    rows = closure.cut(compile_units(units, files, scans, config))
    if libraries is not None:
        rows, units = settled(rows, files, scans, libraries, config)
    out = tables_of(rows) | {"compiled": rows, "files": scans}
    out["units"] = fingerprints(units, out["include_sites"], scans, config)
    out["problems"], out["uses"], out["words"] = checks.problems(out), checks.uses(out), words_of(scans)
    out["grams"] = subsequences.postings(shown(out["symbols"]))
    out["gram_counts"] = subsequences.counts(out["grams"])
    return write(out, folder) if folder else out


def _store(spark: SparkSession, path: str):
    """A path of Hadoop's and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str, ready: bool = True) -> list[int]:
    """Numbers of the versions in a folder, in order: those that are whole, or all."""
    at, store = _store(spark, folder)
    found = [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []
    numbers = sorted(int(n[1:]) for n in found if re.fullmatch(r"v\d+", n))
    return [n for n in numbers if not ready or store.exists(_store(spark, f"{folder}/v{n}/_READY")[0])]


class Conflict(RuntimeError):
    """Another writer made a version after the one that this work started from."""


def _made(store, at) -> bool:
    """Creates an empty file that isn't there yet; of several writers one alone does."""
    try:
        store.create(at, False).close()
    except Py4JJavaError as e:
        if store.exists(at):
            return False
        raise e
    return True


def write(tables: dict[str, DataFrame], folder: str, base: int | None = None) -> dict[str, DataFrame]:
    """Writes the tables as Parquet; symbols are ranged by name, so that name lookups skip most row groups.

    They make a new version, which counts once its last table is there, so no reader sees a part of one. The version before
    it stays for those who read it; older ones go, and so do parts that no writer claims.

    Writers don't wait for each other. Each claims a number of its own, and commits by creating the one mark that says what
    follows ``base``, the version its work started from (by default the last one now). If another has done so, the work
    isn't lost in silence: its version goes and ``Conflict`` is raised, so that it may start again from the new one.
    """
    spark = next(iter(tables.values())).sparkSession
    base = max(versions(spark, folder), default=0) if base is None else base
    version = max(versions(spark, folder, ready=False), default=0) + 1
    while not _made((claim := _store(spark, f"{folder}/v{version}/_CLAIM"))[1], claim[0]):
        version += 1
    for name, df in tables.items():
        by = "name" if name in ("symbols", "uses", "words") else "gram" if name == "grams" else "unit" if "unit" in df.columns else None
        df = df.repartitionByRange(by).sortWithinPartitions(by) if by else df
        df.write.option("parquet.bloom.filter.enabled#name", by == "name").parquet(f"{folder}/v{version}/{name}")
    after, store = _store(spark, f"{folder}/after-{base}")
    if not _made(store, after):
        store.delete(_store(spark, f"{folder}/v{version}")[0], True)
        raise Conflict(f"{folder}: another version follows {base}")
    _made(store, _store(spark, f"{folder}/v{version}/_READY")[0])
    whole = versions(spark, folder)
    for n in versions(spark, folder, ready=False):
        claimed = n not in whole and store.exists(_store(spark, f"{folder}/v{n}/_CLAIM")[0])
        if n not in whole[-2:] and not claimed:
            store.delete(_store(spark, f"{folder}/v{n}")[0], True)
    return read(spark, folder, tables)


def read(spark: SparkSession, folder: str, names: Sequence[str] = (*TABLES, *KEPT)) -> dict[str, DataFrame]:
    """The tables of the last whole version."""
    whole = versions(spark, folder)
    if not whole:
        raise FileNotFoundError(f"no index in {folder}")
    return {n: spark.read.parquet(f"{folder}/v{whole[-1]}/{n}") for n in names}


def fingerprints(units: DataFrame, sites: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """(unit, fingerprint): the settings, the unit's own hash and those of all files it includes, in order of path."""
    parts = units.select("unit", F.col("unit").alias("path")).union(sites.join(units.select("unit"), "unit", "left_semi").select("unit", F.col("file").alias("path"))).distinct()
    hashed = parts.join(files.select("path", "hash"), "path")
    return sets.digest(hashed, ["unit"], [F.lit(config.key()), F.col("path"), F.col("hash")], ["path"], "fingerprint")


def refresh(index: dict[str, DataFrame], files: DataFrame, units: DataFrame, config: Config) -> tuple[dict[str, DataFrame], DataFrame]:
    """The index over changed files, and what was done to each unit: compile, keep or remove.

    A unit is kept if its settings, its own text and every file that it included are as they were, and no file that it
    looked for in vain has appeared. Diagnostics of checks follow other units' edits: units that look up a name which is
    declared otherwise now are checked again, they and the compiled ones alone.
    """
    known = index["files"].select("path", "hash", *SCAN[3:])
    hashes = files.select("path", T.content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    same = hashes.join(known, ["path", "hash"]).select(*SCAN)
    scans = closure.cut(same.union(scanned(files.join(same.select("path"), "path", "left_anti"))))
    now = fingerprints(units, index["include_sites"], scans, config)
    looked = index["directives"].filter("resolved = ''").select("unit", T.base_name(F.col("name")).alias("base"))
    appeared = looked.join(scans.select(T.base_name(F.col("path")).alias("base")), "base", "left_semi").select("unit").distinct()
    now = now.join(appeared.withColumn("again", F.lit("!")), "unit", "left").select("unit", F.concat("fingerprint", F.coalesce("again", F.lit(""))).alias("fingerprint"))
    todo = closure.cut(sets.plan(now, index["units"], "unit", "fingerprint"))
    changed, gone = todo.filter("action = 'compile'").select("unit"), todo.filter("action <> 'keep'").select("unit")
    fresh = closure.cut(compile_units(changed, files, scans, config))
    rows = closure.cut(writes.replace_by_key(index["compiled"], fresh, ["unit"], gone))
    out = tables_of(rows) | {"compiled": rows, "files": scans}
    out["units"] = writes.replace_by_key(index["units"], fingerprints(changed, out["include_sites"], scans, config), ["unit"], gone)
    touched = closure.cut(index["contents"].join(gone, "unit", "left_semi").select("file").union(out["contents"].join(gone, "unit", "left_semi").select("file")).distinct())
    names = checks.changed_names(index, out, touched, gone)
    users = index["uses"].join(names, "name", "left_semi").select("unit")
    givers = [x["contents"].filter("gives").join(touched, "file", "left_semi").select("unit") for x in (index, out)]
    again = closure.cut(users.union(gone).union(givers[0]).union(givers[1]).distinct())
    out["problems"] = checks.merged(index["problems"], checks.problems(out, again, touched), again, touched)
    out["uses"] = writes.replace_by_key(index["uses"], checks.uses({n: out[n].join(again, "unit", "left_semi") for n in ("instantiations", "calls", "type_refs", "imports")}), ["unit"], again)
    out["words"] = words_of(scans)
    out["grams"] = subsequences.updated(index["grams"], shown(out["symbols"]))
    out["gram_counts"] = subsequences.counts(out["grams"])
    return out, todo

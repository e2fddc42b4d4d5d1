"""The source pipeline on trees that are made from the driver's tables, so that its work grows with them.

A region is a package: a base class, a routine, and for each of its nations a class that extends the base. A supplier is a
unit: it includes one of seven headers, imports its region's package, and has a handle of its nation's class. Every
tenth instantiates a unit that nothing declares, and every tenth leaves out an argument.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtlake.functions.code import blanked
from rtlake.plans import index, preprocess, requests, resolve, signatures
from rtlake.plans.registry import Tables, query

HEADERS = 7
#: What is made for one application and folder is made once; its tables lie in the checkpoint folder.
_made: dict[tuple[str, str], tuple] = {}


def tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(path, text) of the tree's files, and its units."""
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    id_ = lambda c: F.col(c).cast("string")
    heads = say("package r", id_("r_regionkey"), ";\n  class base;\n    int id;\n    function int get(int step, int by = 1);\n      return id + step * by;\n    endfunction\n  endclass\n  function int pick", id_("r_regionkey"), "(int a); return a; endfunction\n")
    leaf = say("  class n", id_("n_nationkey"), " extends base;\n    base peer;\n    function int get(int step, int by = 1); return super.get(step); endfunction\n  endclass\n")
    leaves = t.nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", leaf.alias("text")))), lambda x: x["text"]), "").alias("leaves"))
    packages = t.region.join(leaves, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(say("/g/r", id_("r_regionkey"), ".sv").alias("path"), say(heads, F.coalesce("leaves", F.lit("")), "endpackage\n").alias("text"))
    key, of = F.col("s_suppkey"), t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    value = F.when(key % 10 == 5, say("pick", id_("n_regionkey"), "()")).otherwise("h.get(1)")
    inner = F.when(key % 10 == 0, say("lost", id_("s_suppkey"))).otherwise(say("s", (key - 1).cast("string")))
    units = of.select(
        say("/g/s", id_("s_suppkey"), ".sv").alias("path"),
        say("`include \"cfg", (key % HEADERS).cast("string"), ".svh\"\nmodule s", id_("s_suppkey"), "(input logic clk);\n  import r", id_("n_regionkey"), "::*;\n  n", id_("s_nationkey"), " h;\n  logic [`W:0] v;\n  initial h.peer.id = ", value, ";\n  ", inner, " u (.clk(clk));\nendmodule\n").alias("text"),
    )
    headers = t.supplier.select((key % HEADERS).alias("k")).distinct().select(say("/g/cfg", id_("k"), ".svh").alias("path"), say("`define W ", (F.col("k") + 1).cast("string"), " // wide one\n`define PAD(x) ((x) + `W)\n").alias("text"))
    files = packages.union(units).union(headers)
    return files, files.filter("path NOT LIKE '%.svh'").select(F.col("path").alias("unit"))


def built(t: Tables) -> tuple[index.Index, resolve.Model, DataFrame, DataFrame]:
    """The tree's index, its model, files and units."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _made:
        files, units = (x for x in tree(t))
        made = index.build(files, units, index.Config())
        _made[key] = made, resolve.Model(made), files, units
    return _made[key]


_S = "s AS (SELECT s_suppkey AS k, '/g/s' || s_suppkey || '.sv' AS file, 's' || s_suppkey AS me, s_nationkey AS n, n_regionkey AS r, '/g/r' || n_regionkey || '.sv' AS rfile FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_N = "n AS (SELECT n_nationkey AS n, n_regionkey AS r, '/g/r' || n_regionkey || '.sv' AS file, 5 + 4 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS l0 FROM nation)"
_INNER = "CASE WHEN k % 10 = 0 THEN 'lost' || k ELSE 's' || (k - 1) END"


@query(
    "source_symbols",
    f"""WITH {_S}, {_N}, r AS (SELECT r_regionkey AS r, '/g/r' || r_regionkey || '.sv' AS file, 'r' || r_regionkey AS p FROM region)
        SELECT 'Package' AS kind, p AS name, file, 1 AS line, 8 AS col, '' AS scope FROM r UNION ALL SELECT 'Class', 'base', file, 2, 8, p FROM r UNION ALL SELECT 'Variable', 'id', file, 3, 8, p || '::base' FROM r
        UNION ALL SELECT 'Function', 'get', file, 4, 17, p || '::base' FROM r UNION ALL SELECT 'Parameter', 'step', file, 4, 25, p || '::base::get' FROM r UNION ALL SELECT 'Parameter', 'by', file, 4, 35, p || '::base::get' FROM r
        UNION ALL SELECT 'Function', 'pick' || r, file, 8, 15, p FROM r UNION ALL SELECT 'Parameter', 'a', file, 8, 24 + length(CAST(r AS VARCHAR)), p || '::pick' || r FROM r
        UNION ALL SELECT 'Class', 'n' || n, file, l0, 8, 'r' || r FROM n UNION ALL SELECT 'Variable', 'peer', file, l0 + 1, 9, 'r' || r || '::n' || n FROM n UNION ALL SELECT 'Function', 'get', file, l0 + 2, 17, 'r' || r || '::n' || n FROM n
        UNION ALL SELECT 'Parameter', 'step', file, l0 + 2, 25, 'r' || r || '::n' || n || '::get' FROM n UNION ALL SELECT 'Parameter', 'by', file, l0 + 2, 35, 'r' || r || '::n' || n || '::get' FROM n
        UNION ALL SELECT 'Module', me, file, 2, 7, '' FROM s UNION ALL SELECT 'Port', 'clk', file, 2, 20 + length(me), me FROM s UNION ALL SELECT 'Variable', 'h', file, 4, 4 + length(CAST(n AS VARCHAR)), me FROM s
        UNION ALL SELECT 'Variable', 'v', file, 5, 15, me FROM s UNION ALL SELECT 'Instance', 'u', file, 7, 3 + length({_INNER}), me FROM s""",
)
def source_symbols(t: Tables) -> DataFrame:
    return built(t)[0]["symbols"].select("kind", "name", "file", "line", "col", "scope")


@query("source_preprocess", f"WITH {_S} SELECT file AS unit, file, 5 AS line, '  logic [' || (k % {HEADERS} + 1) || ':0] v;' AS text FROM s")
def source_preprocess(t: Tables) -> DataFrame:
    """The line of every unit in which a header's macro is expanded."""
    made, _, files, units = built(t)
    sent = index.sent(units.filter("unit LIKE '/g/s%'"), files, made["files"], index.Config())
    lines = preprocess.preprocessed(sent).select("unit", F.explode("lines").alias("x")).select("unit", "x.file", "x.line", "x.text")
    return lines.filter("file = unit AND line = 5")


_PROBLEMS = f"""SELECT 'instances' AS source, 'lost' || k AS subject, 1 AS severity, file, 7 AS line FROM s WHERE k % 10 = 0 UNION ALL SELECT 'calls', 'pick' || r, 1, file, 6 FROM s WHERE k % 10 = 5
       UNION ALL SELECT 'includes', f, 3, f, 1 FROM (SELECT '/g/cfg' || (k % {HEADERS}) || '.svh' AS f FROM s GROUP BY 1 HAVING count(*) > 1)"""


@query("source_checks", f"WITH {_S} {_PROBLEMS}")
def source_checks(t: Tables) -> DataFrame:
    return built(t)[0]["problems"].select("source", "subject", "severity", "file", "line")


@query(
    "source_refresh",
    f"""WITH {_S}, x AS ({_PROBLEMS}) SELECT source, subject, severity, file, line FROM x WHERE subject <> 'pick0'
        UNION ALL SELECT 'types', 'n0', 2, file, 4 FROM s WHERE n = 0""",
)
def source_refresh(t: Tables) -> DataFrame:
    """Diagnostics after an edit of one package: its routine takes no argument any more, and one of its classes is renamed. Only units that use these names are checked again."""
    made, _, files, units = built(t)
    changed = F.replace(F.replace("text", F.lit("pick0(int a); return a;"), F.lit("pick0(int a = 1); return a;")), F.lit("class n0 "), F.lit("class renamed "))
    after, _ = index.refresh(made, files.withColumn("text", F.when(F.col("path") == "/g/r0.sv", changed).otherwise(F.col("text"))), units, index.Config())
    return after["problems"].select("source", "subject", "severity", "file", "line")


@query("source_references", f"WITH {_S}, {_N} SELECT file, CAST(l0 + 1 AS INT) AS line, 9 AS col, true AS declaration FROM n UNION ALL SELECT file, 6, 12, false FROM s")
def source_references(t: Tables) -> DataFrame:
    made, _, files, _ = built(t)
    return requests.references(made, files, "peer")


@query("source_members", "SELECT name, kind, depth FROM (VALUES ('peer', 'Variable', 0), ('get', 'Function', 0), ('id', 'Variable', 1)) v(name, kind, depth), nation WHERE n_nationkey = 3")
def source_members(t: Tables) -> DataFrame:
    return requests.members(built(t)[0], "n3").select("name", "kind", "depth")


@query("source_definition", f"WITH {_S}, {_N} SELECT s.file, 'n' || s.n AS name, n.file AS d_file, CAST(n.l0 AS INT) AS d_line FROM s JOIN n ON s.n = n.n")
def source_definition(t: Tables) -> DataFrame:
    """The class that every unit's handle is of, through the package that it imports."""
    _, model, files, _ = built(t)
    found = resolve.occurrences(files.filter("path LIKE '/g/s%'")).filter("line = 4 AND col = 2")
    return model.meanings(found).select("file", "name", "d_file", "d_line")


@query("source_receiver", f"WITH {_S} SELECT file, 'h.peer' AS chain, rfile AS d_file, 3 AS d_line FROM s")
def source_receiver(t: Tables) -> DataFrame:
    """What ``id`` means behind ``h.peer`` in every unit: the base's, of the region that the unit's nation belongs to."""
    _, model, files, _ = built(t)
    found = resolve.occurrences(files, ["id"]).filter(F.size("chain") > 0)
    return model.meanings(found).select("file", F.array_join(F.transform("chain", lambda x: x["name"]), ".").alias("chain"), "d_file", "d_line")


@query(
    "source_occurrences",
    f"""WITH {_S}, {_N} SELECT '/g/r0.sv' AS file, 4 AS line, 17 AS col FROM region WHERE r_regionkey = 0 UNION ALL SELECT file, CAST(l0 + 2 AS INT), unnest([17, 57]) FROM n WHERE r = 0
        UNION ALL SELECT file, 6, 24 FROM s WHERE r = 0 AND k % 10 <> 5""",
)
def source_occurrences(t: Tables) -> DataFrame:
    """Occurrences of a method of one package's base and of what overrides it there, without those of the other packages' methods of that name."""
    made, model, files, _ = built(t)
    return model.meant_occurrences(files, made["symbols"].filter("scope = 'r0::base' AND name = 'get'").select(*resolve.KEY)).drop("name")


@query("source_signature", "SELECT 'pick' || r_regionkey AS name, 'pick' || r_regionkey || '(int a)' AS label FROM region WHERE r_regionkey = 1")
def source_signature(t: Tables) -> DataFrame:
    return requests.signature(built(t)[0], "pick1").select("name", "label")


#: Lines as typed after a unit's text, the cursor at their end, and the help that is due.
TYPED = (
    ('initial $fatal("no", ', "$fatal([finish_number], format, args...)", 2), ("initial for (i = f(1, 2); ", "for (initialization; condition; step)", 1), ("assert property (", "assert property (property_spec)", 0),
    ("x = `PAD(", "`PAD(x)", 0), ("x = pick1(pick2(1), ", "pick1(int a)", None), ("s1 c (.clk(", "s1(input logic clk)", 0), ("x = y + (", None, None),
)
_value = lambda x: "NULL" if x is None else repr(x)


@query("source_help", f"SELECT typed, label, active FROM (VALUES {', '.join(f'({_value(a)}, {_value(b)}, {_value(c)})' for a, b, c in TYPED)}) v(typed, label, active) WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 1)")
def source_help(t: Tables) -> DataFrame:
    """Help in open parentheses behind a unit's text: of a system task, constructs, a macro, a routine, a unit, and none."""
    made, found = built(t)[0], []
    for typed, _, _ in TYPED:
        h = signatures.help_at(made, "/g/s1.sv", typed, len(typed))
        found.append((typed, h and h.label, h and h.active))
    return t.spark.createDataFrame(found, "typed string, label string, active int")


@query("source_blanked", f"WITH {_S} SELECT file AS path, CAST(6 + length('cfg' || (k % {HEADERS})) AS INT) AS n_blanked FROM s UNION ALL SELECT '/g/r' || r_regionkey || '.sv', 0 FROM region UNION ALL SELECT DISTINCT '/g/cfg' || (k % {HEADERS}) || '.svh', 9 FROM s")
def source_blanked(t: Tables) -> DataFrame:
    """Characters of every file that go when comments and strings are blanked; nothing else changes, and lengths stay."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            gone = [sum(x != y for x, y in zip(text, blanked(text), strict=True)) for text in texts]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(gone, pa.int32())], names=["path", "n_blanked"])

    return tree(t)[0].mapInArrow(count, "path string, n_blanked int")

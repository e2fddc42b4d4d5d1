"""Meanings of names, libraries, projects and declarations on small inputs with hand-checked rows."""

import pytest
from pyspark.sql import functions as F

from rtlake.functions import names
from rtlake.operators import libraries, projects
from rtlake.plans import index, resolve
from rtlake.plans.declare import declared
from rtlake.plans.preprocess import Preprocessor
from rtlake.streaming import schedule

FILES = {
    "/q/p.sv": """package p;
  class base;
    int id;
    function new(int start); id = start; endfunction
    virtual function int get(int step); return id + step; endfunction
  endclass
  class leaf extends base;
    base next[4];
    function new(); super.new(1); endfunction
    function int get(int step); return super.get(step); endfunction
  endclass
  typedef leaf leaf_t;
endpackage
package outer; export p::*; endpackage
interface bus;
  logic req, ack;
  modport master (output req);
endinterface
""",
    "/q/t.sv": "module t;\n  import outer::*;\n  leaf_t l;\n  bus b();\n  initial go;\nendmodule\n",
}


@pytest.fixture(scope="module")
def tree(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    built = index.build(files, files.select(F.col("path").alias("unit")), index.Config())
    return {name: spark.createDataFrame(t.toArrow(), t.schema) for name, t in built.items()}


@pytest.fixture(scope="module")
def model(tree):
    return resolve.Model(tree)


def asked(spark, *places):
    """Places (file, line, col, name, chain, call) as occurrences; a chain's part may be (name, call, depth)."""
    rows = [(f, line, col, name, [(p, False, 0) if isinstance(p, str) else p for p in chain], "", call) for f, line, col, name, chain, call in places]
    return spark.createDataFrame(rows, resolve.OCCURRENCE)


def meant(model, places):
    return {(r["file"], r["line"], r["col"], r["name"]): (r["d_file"], r["d_line"], r["d_col"], r["kind"]) for r in model.meanings(places).collect()}


def test_places_and_lineage(spark, tree, model):
    at = spark.createDataFrame([(0, "/q/p.sv", 10, 40), (1, "/q/t.sv", 5, 10), (2, "/q/t.sv", 9, 0)], "q int, file string, line int, col int")
    placed = resolve.placed(tree, at)
    assert {r["q"]: r["scope"] for r in placed.collect()} == {0: "p::leaf::get", 1: "t", 2: ""}
    assert [tuple(r) for r in model.around(placed).collect()] == [(0, "p::leaf", "p::base")]
    assert {(r["node"], r["ancestor"], r["depth"]) for r in model.lineage.collect()} == {("p::leaf", "p::leaf", 0), ("p::leaf", "p::base", 1), ("p::base", "p::base", 0)}


def test_receivers(spark, model):
    t = lambda n, chain, col, call=False: ("/q/t.sv", 5, col, n, chain, call)
    got = meant(model, asked(spark, t("id", ["l"], 0), t("ack", ["b"], 1), t("t", ["$root"], 2), t("id", ["nothing"], 3), t("id", ["l", ("next", False, 1)], 4), t("id", ["l", "next"], 5), t("get", ["l"], 6, True), t("new", ["l"], 7, True), ("/q/p.sv", 9, 30, "new", ["super"], True), ("/q/p.sv", 10, 40, "next", ["this"], False), t("new", ["b"], 8, True)))
    assert got == {
        ("/q/t.sv", 5, 0, "id"): ("/q/p.sv", 3, 8, "Variable"),  # through an export, a typedef and the parent
        ("/q/t.sv", 5, 1, "ack"): ("/q/p.sv", 16, 13, "Variable"), ("/q/t.sv", 5, 2, "t"): ("/q/t.sv", 1, 7, "Module"), ("/q/t.sv", 5, 4, "id"): ("/q/p.sv", 3, 8, "Variable"),
        ("/q/t.sv", 5, 6, "get"): ("/q/p.sv", 10, 17, "Function"), ("/q/t.sv", 5, 7, "new"): ("/q/p.sv", 9, 13, "Constructor"),
        ("/q/p.sv", 9, 30, "new"): ("/q/p.sv", 4, 13, "Constructor"), ("/q/p.sv", 10, 40, "next"): ("/q/p.sv", 8, 9, "Variable"),
    }


def test_every_identifier_of_a_tree(spark, model):
    """All identifiers at once; what each means was read off the texts by hand."""
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    got = meant(model, resolve.occurrences(files))
    said = {(f, line, n): set() for f, line, _, n in got}
    for (f, line, _, n), d in got.items():
        said[f, line, n].add(d[:2])
    assert said["/q/p.sv", 5, "id"] == {("/q/p.sv", 3)} and said["/q/p.sv", 5, "step"] == {("/q/p.sv", 5)}
    assert said["/q/p.sv", 10, "get"] == {("/q/p.sv", 10), ("/q/p.sv", 5)} and said["/q/p.sv", 9, "new"] == {("/q/p.sv", 9), ("/q/p.sv", 4)}
    assert said["/q/p.sv", 8, "base"] == {("/q/p.sv", 2)} and said["/q/p.sv", 12, "leaf"] == {("/q/p.sv", 7)}
    assert said["/q/t.sv", 3, "leaf_t"] == {("/q/p.sv", 12)} and said["/q/t.sv", 4, "bus"] == {("/q/p.sv", 15)} and ("/q/t.sv", 5, "go") not in said


def test_families(spark, tree, model):
    roots = {(r["d_name"], r["d_line"]): r["root"]["line"] for r in model.families().collect()}
    assert roots == {("get", 5): 5, ("get", 10): 5}


def test_views_show_what_they_list(spark):
    text = "interface bus; logic req, ack; modport m (output req); endinterface\nmodule t(bus.m p, bus w);\n  initial begin p.req = 1; p.ack = 1; w.ack = 0; end\nendmodule\n"
    files = spark.createDataFrame([("/v.sv", text)], "path string, text string")
    got = meant(resolve.Model(index.build(files, files.select(F.col("path").alias("unit")), index.Config())), resolve.occurrences(files))
    line = {(c, n): d[:3] for (_, row, c, n), d in got.items() if row == 3}
    assert line[18, "req"] == ("/v.sv", 1, 21) and (29, "ack") not in line and line[40, "ack"] == ("/v.sv", 1, 26)


def test_names_take_the_nearest_scope(spark):
    """Own scopes, then imports, then other files; what is declared later in a scope doesn't count; a name read in an include's context."""
    texts = {
        "/n/p.sv": "package p; int a; int b; int c; endpackage\nclass c0; int d; local int e; endclass\n",
        "/n/t.sv": "module t;\n  import p::a, p::b;\n  int a;\n  initial begin : g\n    int x; x = a + b + c + y;\n    int y;\n  end\n`include \"i.svh\"\nendmodule\n",
        "/n/i.svh": "initial a = b;\n",
        "/n/u.sv": "class c1 extends c0; function void f(); d = 1; e = 1; endfunction endclass\nmodule a; endmodule\n",
    }
    files = spark.createDataFrame(list(texts.items()), "path string, text string")
    built = index.build(files, files.filter("path LIKE '%.sv'").select(F.col("path").alias("unit")), index.Config())
    assert {r["file"]: r["scope"] for r in resolve.include_context(built).collect()} == {"/n/i.svh": "t"}
    got = meant(resolve.Model(built), resolve.occurrences(files))
    at = lambda f, line, n: {d[:2] for (file, row, _, name), d in got.items() if (file, row, name) == (f, line, n)}
    assert at("/n/t.sv", 5, "a") == {("/n/t.sv", 3)} and at("/n/t.sv", 5, "b") == {("/n/p.sv", 1)}
    assert at("/n/t.sv", 5, "c") == set() and at("/n/t.sv", 5, "y") == set() and at("/n/t.sv", 6, "y") == {("/n/t.sv", 6)}
    assert at("/n/i.svh", 1, "a") == {("/n/t.sv", 3)} and at("/n/i.svh", 1, "b") == {("/n/p.sv", 1)}
    assert at("/n/u.sv", 1, "d") == {("/n/p.sv", 2)} and at("/n/u.sv", 1, "e") == set()


def test_new_means_what_it_is_assigned_to():
    text = "x = new(1); a.b[2] = new; if (y == new) z.new();\nleaf l = new;"
    assert [(line, n, [c[0] for c in chain], call) for line, _, n, chain, _, call in resolve.asked_in(text, {"new"})] == [(1, "new", ["x"], True), (1, "new", ["a", "b"], False), (1, "new", [], False), (1, "new", ["z"], True), (2, "new", ["l"], False)]
    ((_, _, _, chain, _, _),) = resolve.asked_in("v = top.list[i+1].get(2).y[1][2].q;", {"q"})
    assert chain == [("top", False, 0), ("list", False, 1), ("get", True, 0), ("y", False, 2)]


def test_unit_primary_of_a_cycle(spark):
    sites = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "")], "file string, includer string")
    files = spark.createDataFrame([(x,) for x in "abcd"], "file string")
    assert {r["file"]: r["primary"] for r in resolve.unit_primary(sites, files).collect()} == {"a": "b", "b": "a", "c": "b", "d": "d"}


def test_macro_names():
    text = "`define W 8 // `W\n  x = `W + \"`W\";\n`ifdef W\n`include \"f\"\ny = `MAX(1, `W);\n"
    assert [n for n, _ in names.macro_names(text)] == ["W", "W", "W", "MAX", "W"]
    assert names.macro_name_at(text, text.index("`MAX")) == "MAX" and names.macro_name_at(text, 0) is None


def test_shown(spark):
    one = spark.createDataFrame([("M", True, [("a", None), ("b", "1")], "input int\x1f= 2", "x */ y")], "name string, f boolean, params array<struct<name: string, default: string>>, detail string, text string")
    row = one.select(
        names.macro_signature(F.col("name"), F.col("f"), F.col("params")).alias("sig"), names.display_detail(F.lit("Port"), F.col("detail")).alias("detail"), names.value_type(F.col("detail")).alias("type"),
        names.block_comment_end(F.col("text")).alias("end"), names.is_directive(F.lit("ifdef")).alias("d"), names.takes_macro_name(F.lit("include")).alias("t"), names.name_range(F.lit(3), F.lit(4), F.lit(2)).alias("r"),
    ).first()
    assert (row["sig"], row["detail"], row["type"], row["end"], row["d"], row["t"]) == ("`M(a, b = 1)", "input int= 2", "int", 4, True, False)
    assert (tuple(row["r"]["start"]), tuple(row["r"]["end"])) == ((2, 4), (2, 6))


def test_libraries(spark):
    info = spark.createDataFrame([(1, False, "", 0, 0, []), (2, True, "bad", 0, 0, []), (3, True, "", 21, 0, ["/x", "/y"]), (4, True, "", 20, 3, [])], "id int, exists boolean, error string, schema int, files int, missing array<string>")
    got = {r["id"]: r["problems"] for r in libraries.problems(info).collect()}
    assert {k: [tuple(p) for p in v] for k, v in got.items()} == {1: [("absent", "")], 2: [("unreadable", "bad")], 3: [("newer", "21"), ("empty", ""), ("lost_dirs", "/x, /y")], 4: []}
    said = spark.range(1).select(libraries.stale_message(F.lit(2), F.lit(1), F.lit(9), F.lit("a.sv")).alias("a"), libraries.stale_message(F.lit(0), F.lit(0), F.lit(9), F.lit(None).cast("string")).alias("b"), libraries.summary(F.lit(3), F.lit(4)).alias("c")).first()
    assert tuple(said) == ("out of date: 2 edited, 1 missing, of 9; first: a.sv", "", "3 files, 4 symbols")
    own, recorded = spark.createDataFrame([("/b", 0), ("/a", 1)], "dir string, ord int"), spark.createDataFrame([(0, "/a", 0), (0, "/c", 1), (1, "/d", 0)], "lib_ord int, dir string, ord int")
    assert [r["dir"] for r in libraries.merged_dirs(own, recorded).orderBy("place").collect()] == ["/b", "/a", "/c", "/d"]
    assert libraries.of_version({"t": own}, "1", "2")["t"].isEmpty() and libraries.of_version({"t": own}, "1", "1")["t"].count() == 2
    declared_in = spark.createDataFrame([("/own", 0), ("/lib", 1), ("/lib2", 2)], "path string, ord int")
    first = libraries.only_in_library(declared_in, spark.createDataFrame([("/own",), ("/lib",), ("/lib2",)], "path string"), spark.createDataFrame([("/own",)], "path string")).first()
    assert first["path"] == "/lib"


def test_projects(spark):
    files = spark.createDataFrame([(1, "h1", 5), (2, "h2", 6)], "id int, hash string, size int")
    new = projects.identified(files, spark.createDataFrame([(2, "h3", None)], "id int, hash string, size int"))
    assert sorted(map(tuple, new.collect())) == [(1, "h1", 5), (2, "h3", None)]
    members = spark.createDataFrame([("c", 1, "list"), ("c", 2, "dir")], "config string, file_id int, origin string")
    assert [r["file_id"] for r in projects.without(members, "c", 1).collect()] == [2]
    assert projects.put(members, spark.createDataFrame([("c", 2, "list")], members.schema), "config", "file_id").filter("origin = 'list'").count() == 2
    assert projects.info(members, "none").isEmpty()
    checks = spark.createDataFrame([(1, "calls", [("f",)]), (2, "calls", [("g",)]), (3, "calls", [("f",)])], "file_id int, kind string, data array<struct<name: string>>")
    again = projects.rechecked(checks, spark.createDataFrame([("f",)], "name string"), spark.createDataFrame([(3,)], "file_id int"))
    assert [r["file_id"] for r in again.collect()] == [1]
    assert [r["file_id"] for r in projects.units_with_checks(checks).collect()] == [1, 2, 3]


def test_include_notes(spark):
    sites = spark.createDataFrame([("/i/a", "", 3, 0, 9), ("/i/b", "/i/a", 1, 0, 9), ("/i/pre", "", 0, 0, 0)], "file string, includer string, line int, col int, end_col int")
    errors = spark.createDataFrame([(0, "/i/a", 7, "odd", False), (1, "/i/b", 8, "gone", True), (2, "/i/b", 9, "bad", False), (3, "/i/pre", 1, "x", False)], "ord int, file string, line int, message string, is_include boolean")
    (note,) = projects.include_notes(errors, sites).collect()
    assert (note["line"], note["message"]) == (3, "errors below this line's include (3): b:8: gone | a:7: odd | ...")


def test_schedules(spark):
    pending, cancels = spark.createDataFrame([("a", 1), ("b", 5)], "key string, at int"), spark.createDataFrame([("a", 2), ("b", 3)], "key string, at int")
    assert [r["key"] for r in schedule.cancelled(pending, cancels, ["key"]).collect()] == ["b"]
    loads, at = [], [1]
    snapshot = schedule.Snapshot(lambda: at[0], lambda g: loads.append(g) or g)
    assert (snapshot.tables(), snapshot.tables()) == (1, 1)
    at[0] = 2
    assert snapshot.tables() == 2 and loads == [1, 2]


def test_comments_outside_strings():
    run = Preprocessor({"/d/a.sv": '`define S "a//b" // c\n`include "x//y.svh" // z\nstring s = `S;\n', "/d/x//y.svh": ""}, ["/d"]).run("/d/a.sv")
    assert run["macros"][0]["body"] == '"a//b"'
    assert [d["name"] for d in run["directives"]] == ["x//y.svh"]
    assert any(line["text"].startswith('string s = "a//b";') for line in run["lines"])


def test_headers_without_types():
    found = declared("module n(a, b, c); input a; output [3:0] b; inout wire c; wire w; endmodule", "f")
    assert [(r["kind"], r["name"], r["detail"]) for r in found.rows] == [("Module", "n", ""), ("Port", "a", "input"), ("Port", "b", "output [3:0]"), ("Port", "c", "inout wire"), ("Net", "w", "wire")]


def test_interface_class_and_bare_calls():
    found = declared("interface class c extends a, b; endclass\nmodule t; initial begin go; p::run; end endmodule", "f")
    assert found.rows[0]["detail"] == "a"
    assert [(c["callee"], c["qualifier"], c["args"]) for c in found.calls] == [("go", "", []), ("run", "p", [])]

"""The source pipeline on small texts: preprocessing, declarations, index, requests, checks, refresh."""

import pytest
from pyspark.sql import functions as F

from rtlake.functions import code
from rtlake.functions.builtins import system_tasks
from rtlake.plans import checks, index, requests, signatures
from rtlake.plans.declare import declared
from rtlake.plans.preprocess import Preprocessor
from rtlake.sources import filelist

FILES = {
    "/p/pkg.sv": """// Shared things.
package pkg;
  typedef enum { IDLE, BUSY } state_t;
  class base;
    local int hidden;
    int shown;
    virtual function int get(input int a, int b = 2);
      return a;
    endfunction
  endclass
  class child extends base;
    int own;
    function void go(); int k; k = get(); endfunction
  endclass
endpackage
package outer; export pkg::*; endpackage
""",
    "/p/defs.svh": "`define WIDTH 8\n`define MAX(a, b = 1) ((a) > (b) ? (a) : (b))\n",
    "/p/top.sv": """`include "defs.svh"
module top import outer::*, nowhere::*; (input logic clk);
  state_t s; // state
  missing_t m;
  wire [`WIDTH-1:0] w;
  sub u1 (.clk(clk));
  if (1) begin : g
    ghost u2 ();
  end
endmodule
module sub (input logic clk); endmodule
""",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, text string")


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame([("/p/pkg.sv",), ("/p/top.sv",)], "unit string")


@pytest.fixture(scope="module")
def built(files, units, tmp_path_factory):
    return index.build(files, units, index.Config(), str(tmp_path_factory.mktemp("index")))


def names(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_preprocess():
    run = Preprocessor({"/a.sv": '`define S(x) `"x`"\n`define C(a,b=2) a``_``b\nstring s = `S(hi); int `C(q) = `__LINE__;\n`ifdef NO\nint no;\n`elsif S\nint yes;\n`endif\n`C(1,\n2) x;\n`ifdef OPEN\n'}).run("/a.sv")
    texts = [x["text"] for x in run["lines"]]
    assert texts[2] == 'string s = "hi"; int q_2 = 3;'
    assert "int yes;" in texts and "int no;" not in texts
    assert texts[8:10] == ["1_2 x;", ""]
    assert [(e["line"], e["message"]) for e in run["errors"]] == [(11, "unterminated conditional")]
    assert len(texts) == 12


def test_preprocess_bounds():
    run = Preprocessor({"/a.sv": '`include "a.sv"\n`define R `R\n`R\n`include "none.svh"'}).run("/a.sv")
    assert {m.split(":")[0].split(" `")[0] for m in (e["message"] for e in run["errors"])} >= {"include too deep", "macro", "include file not found"}


def test_declared():
    found = declared(FILES["/p/pkg.sv"], "f")
    rows = {(r["kind"], r["name"], r["scope"]) for r in found.rows}
    assert {("Package", "pkg", ""), ("EnumLiteral", "BUSY", "pkg"), ("Class", "child", "pkg"), ("Parameter", "b", "pkg::base::get"), ("Variable", "k", "pkg::child::go")} <= rows
    child = next(r for r in found.rows if r["name"] == "child")
    assert child["detail"] == "base" and child["end_line"] == 14
    assert next(r for r in found.rows if r["name"] == "pkg")["doc"] == "Shared things."
    assert next(r for r in found.rows if r["name"] == "b")["detail"] == "input int\x1f2"
    assert not found.errors
    assert declared("module a; wire x;", "f").errors


def test_typedefs():
    """Forward typedefs have the words before their name as detail; types with a body have none."""
    text = "package p; typedef class c; typedef interface class i; typedef t; typedef enum e; typedef enum {A} e; typedef enum logic [1:0] {B} f;\ntypedef struct packed {int a;} s; typedef union {int b;} u; typedef q::r v; endpackage"
    found = [(r["name"], r["detail"]) for r in declared(text, "f").rows if r["kind"] == "Typedef"]
    assert found == [("c", "class"), ("i", "interface class"), ("t", "type"), ("e", "enum"), ("e", ""), ("f", ""), ("s", ""), ("u", ""), ("v", "q::r")]


def test_code():
    text = 'int a; // a in a comment\nstring s = "a"; a.b[3].c('
    assert code.occurrences(text, "a") == [("a", 1, 4), ("a", 2, 16)]
    assert code.receiver("x = top.list[i+1].get(2).", 25) == ["top", "list", "get"]
    assert code.call_at("f(1, g(2), .n(x, ", 16) == ("f", 2, "n")
    assert code.clean_doc("/**\n * One.\n * ----\n * @tag x\n * Two.\n */") == "One.\nTwo."
    assert code.is_quiet("a // b", 5) and not code.is_quiet("a // b", 1)


def test_index(built):
    assert ("top", "/p/top.sv", 2) in names(built["symbols"].filter("kind = 'Module'"), "name", "file", "line")
    assert names(built["macros"], "name", "file") == [("MAX", "/p/defs.svh"), ("WIDTH", "/p/defs.svh")]
    assert names(built["include_sites"], "file", "includer") == [("/p/defs.svh", "/p/top.sv")]


def test_requests(built, files):
    found = requests.definition(built, "/p/top.sv", 5, 2, "state_t").first()
    assert (found["file"], found["line"], found["exact"]) == ("/p/pkg.sv", 3, True)
    assert requests.definition(built, "/p/top.sv", 5, 2, "child").first()["exact"]
    assert not requests.definition(built, "/p/pkg.sv", 1, 0, "clk").first()["exact"]
    assert names(requests.members(built, "child").filter("kind = 'Variable'"), "name") == [("own",), ("shown",)]
    assert names(requests.ancestors(built, "child"), "name", "depth") == [("base", 1), ("child", 0)]
    assert names(requests.references(built, files, "state_t"), "file", "declaration") == [("/p/pkg.sv", True), ("/p/top.sv", False)]
    assert requests.signature(built, "get").first()["label"] == "get(input int a, input int b)"
    assert ("Macro", "WIDTH") in names(requests.workspace_symbols(built, "`wid"), "kind", "name")
    assert requests.completion(built, "/p/top.sv", 5, 2, "stt").first()["name"] == "state_t"
    assert ("state_t", "Typedef") in names(requests.document_symbols(built, "/p/pkg.sv"), "name", "kind")
    assert names(requests.fuzzy_symbols(built, "stt"), "name", "kind", "rank_text") == [("state_t", "Typedef", "00000")]
    assert requests.fuzzy_symbols(built, "qq").isEmpty()
    assert len(names(requests.fuzzy_symbols(built, "", 5).select("name").distinct(), "name")) == 5
    assert requests.macro(built, "WIDTH", "/p/top.sv", 5).first()["body"] == "8"
    with pytest.raises(ValueError):
        requests.rename(built, files, "top", "1bad")
    assert requests.rename(built, files, "clk", "clock").count() == 4


def test_checks(built):
    found = names(requests.checks(built), "source", "subject", "severity")
    assert found == [("calls", "get", 1), ("imports", "nowhere", 1), ("instances", "ghost", 2), ("types", "missing_t", 2)]


def test_refresh_equals_fresh(built, files, units, spark):
    changed = files.withColumn("text", F.when(F.col("path") == "/p/defs.svh", F.concat("text", F.lit("`define MORE 1\n"))).otherwise(F.col("text")))
    again, done = index.refresh(built, changed, units, index.Config())
    assert names(done, "unit", "action") == [("/p/pkg.sv", "keep"), ("/p/top.sv", "compile")]
    fresh = index.build(changed, units, index.Config())
    for name in (*index.TABLES, "units"):
        assert again[name].exceptAll(fresh[name].select(*again[name].columns)).count() == 0, name
        assert fresh[name].select(*again[name].columns).exceptAll(again[name]).count() == 0, name


TREE = {
    "/r/h.svh": "typedef int word_t;\nclass shared; function int f(int a, int b = 1); return a; endfunction endclass\n",
    "/r/m.svh": "`include `PICK\n", "/r/late.svh": "class late; endclass\n", "/r/pick.svh": '`define PICK "late.svh"\n',
    "/r/a.sv": '`include "h.svh"\npackage a; export b::*; endpackage\nmodule ma; word_t w; gone_t g; sub s(); initial x = f(); endmodule\n',
    "/r/b.sv": '`include "h.svh"\npackage b; typedef int b_t; endpackage\nmodule sub; endmodule\n',
    "/r/c.sv": "module c; import a::b_t; import a::none; b_t t; late l; sub s(); endmodule\n",
    "/r/d.sv": '`include "pick.svh"\n`include "m.svh"\nmodule d; endmodule\n',
}


def same(got, want, names=(*index.TABLES, *index.KEPT)):
    for name in names:
        columns = sorted(want[name].columns)
        a, b = (sorted(map(repr, x[name].select(*columns).collect())) for x in (got, want))
        assert a == b, name


@pytest.fixture(scope="module")
def whole_tree(spark):
    def of(texts):
        files = spark.createDataFrame(list(texts.items()), "path string, text string")
        return files, files.filter("path LIKE '%.sv'").select(F.col("path").alias("unit"))

    return of


def test_problems_of_a_tree(before):
    built = before
    assert names(built["problems"], "unit", "source", "subject") == [
        ("/r/a.sv", "calls", "f"), ("/r/a.sv", "types", "gone_t"), ("/r/c.sv", "imports", "none"), ("/r/h.svh", "includes", "/r/h.svh"),
    ]
    assert names(built["contents"].filter("gives AND unit <> file"), "unit", "file") == [("/r/a.sv", "/r/h.svh"), ("/r/d.sv", "/r/late.svh"), ("/r/d.sv", "/r/m.svh"), ("/r/d.sv", "/r/pick.svh")]


@pytest.fixture(scope="module")
def before(spark, whole_tree):
    built = index.build(*whole_tree(TREE), index.Config())
    return {name: spark.createDataFrame(t.toArrow(), t.schema) for name, t in built.items()}


@pytest.mark.parametrize(
    "edits, again",
    [
        # a's export hands b's change on to c; the header's rows are given by a
        ({"/r/b.sv": TREE["/r/b.sv"].replace("typedef int b_t;", ""), "/r/d.sv": TREE["/r/d.sv"] + "// a comment\n"}, {"/r/a.sv", "/r/c.sv"}),
        ({"/r/b.sv": TREE["/r/b.sv"].replace("module sub;", "module other;"), "/r/late.svh": "// nothing\n", "/r/e.sv": "module e; late l; endmodule\n"}, {"/r/a.sv", "/r/c.sv"}),
        ({"/r/a.sv": None, "/r/h.svh": TREE["/r/h.svh"].replace("int a,", "int a = 0,")}, {"/r/c.sv"}),  # b gives the header's rows now
        ({"/r/d.sv": TREE["/r/d.sv"] + "// a comment\n"}, set()),
    ],
)
def test_refresh_follows_edits_elsewhere(before, whole_tree, edits, again):
    """A refreshed index, its diagnostics too, equals a fresh one; only units that look up what changed are checked again."""
    texts = {p: t for p, t in (TREE | edits).items() if t is not None}
    after, done = index.refresh(before, *whole_tree(texts), index.Config())
    same(after, index.build(*whole_tree(texts), index.Config()))
    gone = done.filter("action <> 'keep'").select("unit")
    touched = before["contents"].union(after["contents"]).join(gone, "unit", "left_semi").select("file").distinct()
    changed = checks.changed_names(before, after, touched, gone)
    users = before["uses"].join(changed, "name", "left_semi").select("unit").distinct().join(gone, "unit", "left_anti")
    assert {r["unit"] for r in users.collect()} <= again


def test_units_are_sent_what_they_may_read(whole_tree):
    files, units = whole_tree(TREE)
    sent = index.needed(units, index.scanned(files), index.Config())
    assert names(sent.filter("unit <> path"), "unit", "path") == [("/r/a.sv", "/r/h.svh"), ("/r/b.sv", "/r/h.svh"), ("/r/d.sv", "/r/late.svh"), ("/r/d.sv", "/r/m.svh"), ("/r/d.sv", "/r/pick.svh")]
    early = index.needed(units, index.scanned(files), index.Config(preincludes=("/r/m.svh",), defines={"PICK": '"x/h.svh"'}))
    assert names(early.filter("unit = '/r/c.sv'"), "path") == [("/r/c.sv",), ("/r/h.svh",), ("/r/late.svh",), ("/r/m.svh",)]


def test_filelist():
    texts = {"/p/a.f": '+define+A=1+B\n-f sub/b.f // more\n"my file.sv"\n+incdir+inc+/abs\n-y lib +libext+.v+.sv', "/p/sub/b.f": "x.sv\n-F c.f", "/p/sub/c.f": "-v one.v", "/p/cycle.f": "-f cycle.f", "/p/bad.f": "\n-unknown"}
    project = filelist.parse_filelist("/p/a.f", texts.get)
    assert project.files == ["/p/sub/x.sv", "/p/my file.sv"] and project.defines == {"A": "1", "B": ""}
    assert project.include_dirs == ["/p/inc", "/abs"] and project.library_files == ["/p/sub/one.v"] and project.lib_extensions == [".v", ".sv"]
    for bad in ("/p/cycle.f", "/p/bad.f", "/p/none.f"):
        with pytest.raises(ValueError):
            filelist.parse_filelist(bad, texts.get)
    with pytest.raises(ValueError):
        filelist.parse_manifest("m.json", '{"files": [1]}')
    assert filelist.discover("/a/b", {"/a/rtlake.f"}.__contains__) == "/a/rtlake.f"


def test_help():
    tasks = system_tasks()
    assert tasks["$fdisplayh"] == ["fd", "args..."] and tasks["$exit"] == [] and "$test$plusargs" in tasks and "$clog2h" not in tasks

    def at(text):
        return signatures.help_at({}, "/p/x.sv", text, len(text))

    assert at("foreach (a[") == signatures.Help("foreach (array[index, ...])", ("array", "index, ..."), 1)
    assert at("foreach (a").active == 0 and at("for (i = 0; i < 3; i++; ").active is None
    assert at("cover property (").label == "cover property (property_spec)" and at("cover (").label == "cover (expression)"
    assert at("randomize(a, ") == signatures.Help("randomize([variable, ...])", ("[variable, ...]",), 0)
    assert at("x = (") is None and at("no parenthesis") is None and at('"(" ') is None and at("f(1) ") is None


def test_system_task_slots():
    help_ = signatures.system_task
    assert help_("$display", "(1, 2, 3", 0, 2).active == 0  # one parameter takes them all
    assert help_("$fatal", "(1, 2", 0, 1).active == 1 and help_("$fatal", '( "s"', 0, 0).active == 1
    assert help_("$clog2", "(1, 2", 0, 1).active is None and help_("$time", "(", 0, 0).active is None and help_("$none", "(", 0, 0) is None
    assert help_("$assertoff", "(0, a, b", 0, 2).active == 1


def test_help_by_names(built):
    def at(text, file="/p/top.sv"):
        return signatures.help_at(built, file, text, len(text))

    assert at("x = get(1, ") == signatures.Help("get(input int a, input int b)", ("input int a", "input int b"), 1)
    assert at("x = get(.b(").active == 1
    assert at("x = `MAX(1, ").active == 1 and at("x = `WIDTH(") is None and at("x = `get(") is None
    assert at("x = nothing(") is None


def test_versions(spark, tmp_path):
    folder, one = str(tmp_path / "index"), spark.range(3).selectExpr("CAST(id AS STRING) AS name")
    for n in (1, 2, 3):
        kept = index.write({"symbols": one.limit(n), "units": one}, folder)
    assert kept["symbols"].count() == 3 and index.versions(spark, folder) == [2, 3]
    one.write.parquet(f"{folder}/v4/symbols")  # a writer that was lost
    assert index.read(spark, folder, ["symbols"])["symbols"].count() == 3
    again = index.write({"symbols": index.read(spark, folder, ["symbols"])["symbols"], "units": one}, folder)
    assert again["symbols"].count() == 3 and index.versions(spark, folder) == [3, 5] and index.versions(spark, folder, ready=False) == [3, 5]
    with pytest.raises(FileNotFoundError):
        index.read(spark, str(tmp_path / "none"))


def test_two_writers(spark, tmp_path):
    """Both start from one version: the first to finish commits, the other is refused and may start again."""
    folder, one = str(tmp_path / "index"), spark.range(3).selectExpr("CAST(id AS STRING) AS name")
    index.write({"symbols": one}, folder)
    index.write({"symbols": one.limit(1)}, folder, base=1)
    with pytest.raises(index.Conflict):
        index.write({"symbols": one.limit(2)}, folder, base=1)
    assert index.read(spark, folder, ["symbols"])["symbols"].count() == 1 and index.versions(spark, folder, ready=False) == [1, 2]
    assert index.write({"symbols": one.limit(2)}, folder, base=2)["symbols"].count() == 2
    store, claim = index._store(spark, f"{folder}/v9/_CLAIM")[::-1]
    store.create(claim).close()  # another writer is at work: its part stays, its number is not taken
    index.write({"symbols": one}, folder)
    assert index.versions(spark, folder, ready=False)[-2:] == [9, 10]


def test_library_files_in_waves(whole_tree):
    """A unit names one library file's module, that names another's, that one's package is a third's; what nothing names is left out."""
    texts = {
        "/l/top.sv": "module top; one u(); nothing v(); endmodule\n", "/l/lib/one.sv": '`include "x.svh"\nmodule one; two u(); endmodule\n', "/l/lib/x.svh": "typedef int x_t;\n", "/l/lib/two.sv": "module two; import three::*; endmodule\n",
        "/l/lib/three.sv": "package three; class k extends far; endclass endpackage\n", "/l/lib/far.sv": "class far; endclass\n", "/l/lib/more.sv": "module more; endmodule\n", "/l/old/two.sv": "module two; wire other; endmodule\n",
    }
    files, _ = whole_tree(texts)
    units = lambda *names: files.sparkSession.createDataFrame([(n,) for n in names], "unit string")
    lib = files.filter("path LIKE '%.sv' AND path <> '/l/top.sv'").select("path", F.col("path").contains("/old/").cast("int").alias("ord"))
    got = index.build(files, units("/l/top.sv"), index.Config(), libraries=lib)
    same(got, index.build(files, units("/l/top.sv", "/l/lib/one.sv", "/l/lib/two.sv", "/l/lib/three.sv", "/l/lib/far.sv"), index.Config()))
    assert names(got["problems"], "source", "subject") == [("instances", "nothing")]


def test_search_opens_files_that_hold_the_name(spark, whole_tree, before, tmp_path):
    files, _ = whole_tree(TREE)
    files.repartitionByRange(7, "path").sortWithinPartitions("path").write.parquet(str(tmp_path / "texts"))
    stored = spark.read.parquet(str(tmp_path / "texts"))
    every = {(f, line, col) for f, t in TREE.items() for _, line, col in code.occurrences(t, "sub")}
    found = requests.references(before, stored, "sub")
    assert {tuple(r)[:3] for r in found.collect()} == every and len(every) == 3
    plan = found._jdf.queryExecution().toString()
    assert "In(path, [" in plan.replace("PushedFilters: [", "") and "/r/d.sv" not in plan.split("PushedFilters")[1].split("\n")[0]
    assert requests.references(before, stored, "nowhere_at_all").count() == 0

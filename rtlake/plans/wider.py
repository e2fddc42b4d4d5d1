"""Queries of libraries, projects and kinds over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtlake.functions import names
from rtlake.operators import libraries, projects
from rtlake.plans import resolve
from rtlake.plans.registry import Tables, query
from rtlake.streaming import schedule


@query(
    "library_paths",
    """WITH f AS (SELECT 0 AS lib_ord, s_suppkey AS id, 'n' || s_nationkey AS path FROM supplier UNION ALL SELECT 1, c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 1, c_custkey, c_name FROM customer)
       SELECT path, min(lib_ord) AS lib_ord, min_by(id, lib_ord * 1000000000 + id) AS id FROM f GROUP BY path""",
)
def library_paths(t: Tables) -> DataFrame:
    first = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("path"))
    second = t.customer.select(F.col("c_custkey").alias("id"), F.explode(F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), "c_name")).alias("path"))
    return libraries.paths(libraries.attached(first, second))


@query("type_files", "SELECT CAST(s_nationkey AS VARCHAR) AS name, min_by(s_name, s_suppkey) AS file FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey")
def type_files(t: Tables) -> DataFrame:
    kind = F.when(F.col("s_acctbal") > 0, "Module").otherwise("Class")
    symbols = t.supplier.select(kind.alias("kind"), F.lit("").alias("scope"), F.col("s_nationkey").cast("string").alias("name"), F.col("s_name").alias("file"))
    return libraries.type_files(symbols, t.supplier.select(F.col("s_name").alias("file"), F.col("s_suppkey").alias("ord")))


@query(
    "client_paths",
    """SELECT '/r' || n_regionkey || '/' || n_name AS path, CASE WHEN n_name < 'F' THEN '/deep/' || n_name ELSE '/home/r' || n_regionkey || '/' || n_name END AS client FROM nation""",
)
def client_paths(t: Tables) -> DataFrame:
    """The longest known folder names a path; here some files have names of their own."""
    folder = F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"))
    files = t.nation.select(F.concat(folder, F.lit("/"), "n_name").alias("path"))
    own = t.nation.filter("n_name < 'F'").select(F.concat(folder, F.lit("/"), "n_name").alias("canonical"), F.concat(F.lit("/deep/"), "n_name").alias("client"))
    folders = t.region.select(F.concat(F.lit("/r"), F.col("r_regionkey").cast("string")).alias("canonical"), F.concat(F.lit("/home/r"), F.col("r_regionkey").cast("string")).alias("client"))
    return libraries.client_paths(files, own.union(folders))


@query("project_units", "SELECT c_name AS path, o_orderstatus AS origin FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def project_units(t: Tables) -> DataFrame:
    members = t.orders.select(F.col("o_orderpriority").alias("config"), F.col("o_custkey").alias("file_id"), F.col("o_orderstatus").alias("origin"))
    return projects.units(members, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path")), "1-URGENT")


@query("project_shared", "SELECT DISTINCT o_custkey AS file_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority <> '1-URGENT')")
def project_shared(t: Tables) -> DataFrame:
    return projects.shared(t.orders.select(F.col("o_orderpriority").alias("config"), F.col("o_custkey").alias("file_id")), "1-URGENT")


@query(
    "current_hash",
    """SELECT CAST(d.doc_id AS VARCHAR) AS path, CASE WHEN l.quality >= 0 AND l.toxic = d.n_chars % 2 AND d.doc_id + 2000000000 < d.doc_id + 2000000000 + l.quality THEN 'stored' ELSE sha256(d.text) END AS hash
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def current_hash(t: Tables) -> DataFrame:
    """A stored hash is trusted where size and time agree and it was read well after; here labels say so."""
    path = F.col("doc_id").cast("string").alias("path")
    now = t.documents.select(path, (F.col("n_chars") % 2).alias("size"), F.col("doc_id").alias("mtime_ns"), "text")
    stored = t.labels.select(path, F.lit("stored").alias("hash"), F.col("toxic").cast("long").alias("size"), F.col("doc_id").alias("mtime_ns"), (F.col("doc_id") + 2_000_000_000 + F.col("quality")).alias("stat_ns"))
    return projects.current_hash(now, stored).select("path", "hash")


@query(
    "changed_names",
    """WITH a AS (SELECT p_name AS name, split_part(p_type, ' ', 1) AS scope, p_size % 2 = 0 AS port FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_name AS name, split_part(p_type, ' ', 2) AS scope FROM part WHERE p_partkey % 2 = 1)
       SELECT name, 'added' AS how FROM a UNION SELECT name, 'changed' FROM r UNION SELECT scope, 'changed' FROM r WHERE scope <> '' UNION SELECT scope, 'changed' FROM a WHERE port AND scope <> ''""",
)
def changed_names(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") % 2 == 0, "Port").otherwise("Variable").alias("kind")
    scope = lambda n: F.coalesce(F.try_element_at(F.split("p_type", " "), F.lit(n)), F.lit("")).alias("scope")
    parts = [t.part.filter(F.col("p_partkey") % 2 == k).select(kind, F.col("p_name").alias("name"), scope(k + 1)) for k in (0, 1)]
    return projects.changed_names(parts[0], parts[1])


@query(
    "put_checks",
    """SELECT o_custkey AS file_id, o_orderpriority AS kind, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 AND (o_custkey, o_orderpriority) NOT IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1)
       GROUP BY o_custkey, o_orderpriority""",
)
def put_checks(t: Tables) -> DataFrame:
    """Stored inputs of half of the units; the other half's come without any, and delete."""
    keyed = lambda k: t.orders.filter(F.col("o_orderkey") % 2 == k).select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("kind"), (F.array("o_orderstatus") if k == 0 else F.array().cast("array<string>")).alias("data"))
    return projects.put_checks(keyed(0), keyed(1)).groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unit_primary",
    """WITH RECURSIVE w(file, node) AS (SELECT n_nationkey, n_nationkey FROM nation UNION ALL SELECT file, node // 3 FROM w WHERE node // 3 > 0)
       SELECT CAST(file AS VARCHAR) AS file, CAST(min(node) AS VARCHAR) AS "primary" FROM w GROUP BY file""",
)
def unit_primary(t: Tables) -> DataFrame:
    """Each file is included by the one of a third of its number; 1 and 2, and 0, are included by none."""
    files = t.nation.select(F.col("n_nationkey").cast("string").alias("file"))
    sites = t.nation.filter("n_nationkey div 3 > 0").select(F.col("n_nationkey").cast("string").alias("file"), F.expr("CAST(n_nationkey div 3 AS STRING)").alias("includer"))
    return resolve.unit_primary(sites, files)


@query(
    "problem_ranges",
    """SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS line, CAST(l_quantity AS INT) AS first_col, CASE WHEN l_suppkey > l_quantity THEN CAST(l_suppkey AS INT) ELSE CAST(l_quantity AS INT) + 1 END AS last_col,
       CASE l_returnflag WHEN 'N' THEN 'Information' WHEN 'A' THEN 'Warning' ELSE 'Error' END AS severity FROM lineitem""",
)
def problem_ranges(t: Tables) -> DataFrame:
    at = names.problem_range(F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_suppkey").cast("int"))
    level = F.when(F.col("l_returnflag") == "N", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    out = t.lineitem.select("l_orderkey", "l_linenumber", at.alias("at"), names.severity(level).alias("severity"))
    return out.select("l_orderkey", "l_linenumber", F.col("at.start.line").alias("line"), F.col("at.start.character").alias("first_col"), F.col("at.end.character").alias("last_col"), "severity")


@query("shown_kinds", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Method' WHEN 1 THEN 'Namespace' WHEN 2 THEN 'Module' ELSE 'Variable' END AS symbol, CASE p_size % 4 WHEN 0 THEN 'Function' WHEN 1 THEN 'Module' WHEN 2 THEN 'Module' ELSE 'Variable' END AS completion FROM part")
def shown_kinds(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("Task", "Block", "Checker", "Net"))), F.col("p_size") % 4 + 1)
    return t.part.select("p_partkey", names.symbol_kind(kind).alias("symbol"), names.completion_kind(kind).alias("completion"))


@query("shown_while_indexing", "SELECT event_id FROM events WHERE event_type NOT IN ('purchase', 'error')")
def shown_while_indexing(t: Tables) -> DataFrame:
    source = F.when(F.col("event_type") == "purchase", "call").when(F.col("event_type") == "error", "import").otherwise("parse")
    return schedule.shown(t.events.select("event_id", source.alias("source")), True).select("event_id")


@query(
    "saved_cascade",
    """WITH RECURSIVE w(node) AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 5 = 4 UNION SELECT w.node // 2 FROM w WHERE w.node > 0) SELECT CAST(node AS VARCHAR) AS path FROM w""",
)
def saved_cascade(t: Tables) -> DataFrame:
    """Each file is included by that of half its number."""
    path = F.col("n_nationkey").cast("string")
    includes = t.nation.filter("n_nationkey > 0").select(path.alias("included"), F.expr("CAST(n_nationkey div 2 AS STRING)").alias("includer"))
    return schedule.saved(t.nation.filter("n_nationkey % 5 = 4").select(path.alias("path")), includes)

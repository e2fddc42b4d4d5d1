"""Relational operators bound to the driver's tables (lookups, updates, sets, spans, closures, scheduling)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rtlake.functions import text as T
from rtlake.operators import closure, lookup, sets, spans, writes
from rtlake.plans.registry import Tables, query
from rtlake.streaming import schedule


@query("lookup_exact", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = 'blue bolt'")
def lookup_exact(t: Tables) -> DataFrame:
    return lookup.exact(t.part, "p_name", "blue bolt").select("p_partkey", "p_name", "p_brand")


@query("lookup_prefix", "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 're')")
def lookup_prefix(t: Tables) -> DataFrame:
    return lookup.prefix(t.part, "p_name", "Re").select("p_partkey", "p_name")


@query("lookup_scope", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#4' AND p_name = 'blue bolt'")
def lookup_scope(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("scope"))
    return lookup.in_scope(rows, "Brand#4", "blue bolt").select("p_partkey", F.col("name").alias("p_name"))


@query(
    "federated_union",
    """SELECT c_custkey, c_mktsegment, c_custkey % 3 AS lib_ord FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def federated_union(t: Tables) -> DataFrame:
    main, *libs = [t.customer.filter(F.col("c_custkey") % 3 == k).select("c_custkey", "c_mktsegment") for k in range(3)]
    return lookup.exact(lookup.federated(main, *libs), "c_mktsegment", "BUILDING").select("c_custkey", "c_mktsegment", F.col("lib_ord").cast("long").alias("lib_ord"))


@query("first_wins", "SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_wins(t: Tables) -> DataFrame:
    return lookup.first_wins(t.events, ["event_type", "user_id"], "ts", "event_id").select("event_type", "user_id", "event_id", "value")


@query("access_filter", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def access_filter(t: Tables) -> DataFrame:
    return lookup.first_wins_then(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_id", "event_type")


@query(
    "ports_cut",
    """WITH m AS (SELECT conv_id, turn, role, CASE WHEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) > 1 THEN 1 ELSE 0 END AS again FROM conversations)
       SELECT conv_id, turn, role FROM (SELECT *, max(again) OVER (PARTITION BY conv_id ORDER BY turn) AS cut FROM m) WHERE cut = 0""",
)
def ports_cut(t: Tables) -> DataFrame:
    return lookup.cut_at_first_repeat(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")


@query("rank_text", "SELECT p_partkey, p_retailprice, lpad(CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS VARCHAR), 5, '0') AS rank_text FROM part WHERE p_type = 'SMALL' ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def rank_text(t: Tables) -> DataFrame:
    best = lookup.top(t.part.filter("p_type = 'SMALL'").select("p_partkey", "p_retailprice"), 100, F.desc("p_retailprice"), "p_partkey")
    return lookup.ranked(best, F.desc("p_retailprice"), "p_partkey")


@query(
    "replace_by_file",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0
       UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber < 3""",
)
def replace_by_file(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    touched = rows.filter("l_orderkey % 10 = 0")
    return writes.replace_by_key(rows, touched.filter("l_linenumber < 3").withColumn("l_quantity", F.col("l_quantity") + 1), ["l_orderkey"], touched)


@query("upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) || '!' ELSE s_name END AS s_name, s_nationkey FROM supplier UNION ALL SELECT 1000000 + s_suppkey, upper(s_name) || '!', -1 FROM supplier WHERE s_suppkey < 3")
def upsert(t: Tables) -> DataFrame:
    old = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    new = old.filter("s_suppkey % 2 = 0").withColumn("s_nationkey", F.lit(-1))
    new = new.unionByName(old.filter("s_suppkey < 3").withColumns({"s_suppkey": F.col("s_suppkey") + 1_000_000, "s_nationkey": F.lit(-1)}))
    return writes.upsert(old, new.withColumn("s_name", F.concat(F.upper("s_name"), F.lit("!"))), ["s_suppkey"], keep=["s_nationkey"])


@query("insert_missing", "SELECT n_nationkey FROM nation UNION SELECT c_nationkey + 20 FROM customer")
def insert_missing(t: Tables) -> DataFrame:
    return writes.insert_missing(t.nation.select("n_nationkey"), t.customer.select((F.col("c_nationkey") + 20).alias("n_nationkey")), ["n_nationkey"])


@query("cascade_delete", "SELECT count(*) AS n_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return writes.cascade({"lineitem": t.lineitem}, gone, "l_orderkey")["lineitem"].agg(F.count(F.lit(1)).alias("n_rows"))


@query("delete_by_source", "SELECT event_type, count(*) AS n_rows FROM events WHERE NOT (event_type = 'error' AND user_id < 50) GROUP BY event_type")
def delete_by_source(t: Tables) -> DataFrame:
    return writes.delete_where(t.events, (F.col("event_type") == "error") & (F.col("user_id") < 50)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query("last_wins", "SELECT user_id, event_type, max_by(event_id, event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def last_wins(t: Tables) -> DataFrame:
    return writes.last_wins(t.events.select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("seq")), ["user_id", "event_type"], "seq").drop("seq")


@query("unresolved_anti", "SELECT DISTINCT o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def unresolved_anti(t: Tables) -> DataFrame:
    return sets.unresolved(t.orders, t.customer.filter("c_mktsegment = 'BUILDING'"), "o_custkey", "c_custkey")


@query("semi_exists", "SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09 AND l_returnflag = 'R')")
def semi_exists(t: Tables) -> DataFrame:
    uses = t.lineitem.filter("l_quantity > 49 AND l_discount > 0.09 AND l_returnflag = 'R'")
    return sets.used_elsewhere(t.supplier, uses, F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_name")


@query(
    "set_diff_names",
    """WITH a AS (SELECT p_name FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_name FROM part WHERE p_partkey % 2 = 1)
       SELECT p_name, 'added' AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT p_name, 'removed' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
)
def set_diff_names(t: Tables) -> DataFrame:
    names = t.part.select("p_name", "p_partkey")
    return sets.difference(names.filter("p_partkey % 2 = 0").select("p_name"), names.filter("p_partkey % 2 = 1").select("p_name"))


@query("digest_per_key", "SELECT user_id, sha256(string_agg(length(CAST(event_id AS VARCHAR)) || ':' || CAST(event_id AS VARCHAR) || length(event_type) || ':' || event_type, '' ORDER BY event_id)) AS digest FROM events GROUP BY user_id")
def digest_per_key(t: Tables) -> DataFrame:
    return sets.digest(t.events, ["user_id"], [F.col("event_id"), F.col("event_type")], ["event_id"])


@query(
    "fingerprint",
    """WITH l1 AS (SELECT source, doc_id // 1024 AS node, sha256(string_agg(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) || '64:' || sha256(text), '' ORDER BY doc_id)) AS hash FROM documents GROUP BY 1, 2),
       l2 AS (SELECT source, node // 1024 AS node, sha256(string_agg(node || ':' || hash || ';', '' ORDER BY l1.node)) AS hash FROM l1 GROUP BY source, l1.node // 1024),
       l3 AS (SELECT source, node // 1024 AS node, sha256(string_agg(node || ':' || hash || ';', '' ORDER BY l2.node)) AS hash FROM l2 GROUP BY source, l2.node // 1024)
       SELECT source, sha256(string_agg(node || ':' || hash || ';', '' ORDER BY node)) AS fingerprint FROM l3 GROUP BY source""",
)
def fingerprint(t: Tables) -> DataFrame:
    """The root of each source's hash tree: no task has more than a thousand of a source's documents."""
    nodes = sets.hash_tree(t.documents.select("source", "doc_id", T.content_hash(F.col("text")).alias("hash")), ["source"], [F.col("doc_id"), F.col("hash")], "doc_id")
    return nodes.filter(F.col("level") == sets.LEVELS + 1).select("source", F.col("hash").alias("fingerprint"))


@query("fingerprint_ordered", "SELECT source, sha256(string_agg(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) || '64:' || sha256(text), '' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def fingerprint_ordered(t: Tables) -> DataFrame:
    return sets.streamed_digest(t.documents.select("source", "doc_id", T.content_hash(F.col("text")).alias("hash")), ["source"], [F.col("doc_id"), F.col("hash")], ["doc_id"], "fingerprint")


@query("plan_hit_miss", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'remove' WHEN l.doc_id IS NULL OR d.v <> l.v THEN 'compile' ELSE 'keep' END AS action FROM (SELECT doc_id, n_chars % 2 AS v FROM documents) d FULL JOIN (SELECT doc_id, quality AS v FROM labels) l ON d.doc_id = l.doc_id")
def plan_hit_miss(t: Tables) -> DataFrame:
    now = t.documents.select("doc_id", (F.col("n_chars") % 2).alias("v"))
    return sets.plan(now, t.labels.select("doc_id", F.col("quality").cast("long").alias("v")), "doc_id", "v")


@query(
    "staleness",
    """WITH x AS (SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.doc_id IS NULL THEN 'unknown' WHEN d.v <> l.v THEN 'changed' END AS s
               FROM (SELECT doc_id, n_chars % 2 AS v FROM documents) d FULL JOIN (SELECT doc_id, quality AS v FROM labels) l ON d.doc_id = l.doc_id)
       SELECT count(*) FILTER (WHERE s = 'changed') AS n_changed, count(*) FILTER (WHERE s = 'missing') AS n_missing, count(*) FILTER (WHERE s = 'unknown') AS n_unknown,
              (SELECT string_agg(i, ', ' ORDER BY i) FROM (SELECT CAST(id AS VARCHAR) AS i FROM x WHERE s IS NOT NULL ORDER BY id LIMIT 3)) AS examples FROM x""",
)
def staleness(t: Tables) -> DataFrame:
    now = t.documents.select("doc_id", (F.col("n_chars") % 2).alias("v"))
    return sets.stale(now, t.labels.select("doc_id", F.col("quality").cast("long").alias("v")), "doc_id", "v")


_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages")


@query("count_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in _NAMES))
def count_tables(t: Tables) -> DataFrame:
    return sets.counts({n: getattr(t, n) for n in _NAMES})


_LEVELS = ("month", "day", "hour")
_NESTED = "SELECT user_id, 0 AS level, min(ts) AS b, max(ts) AS e FROM events WHERE event_type <> 'error' GROUP BY user_id" + "".join(
    f" UNION ALL SELECT user_id, {k}, min(ts), max(ts) FROM events WHERE event_type <> 'error' GROUP BY user_id, date_trunc('{u}', ts)" for k, u in enumerate(_LEVELS, 1)
)


@query(
    "scope_innermost",
    f"""WITH s AS ({_NESTED}), p AS (SELECT user_id, event_id, ts FROM events)
        SELECT p.event_id, arg_max(s.level, (s.b, -epoch_us(s.e), s.level)) AS level, max_by(s.b, (s.b, -epoch_us(s.e), s.level)) AS since
        FROM p JOIN s ON p.user_id = s.user_id AND s.b <= p.ts AND p.ts <= s.e GROUP BY p.event_id""",
)
def scope_innermost(t: Tables) -> DataFrame:
    """Each event in the innermost of its user's nested spans: all of the user's time, its months, days and hours, from the first to the last event there that is no error."""
    fine = t.events.filter("event_type <> 'error'")
    levels = [fine.groupBy("user_id").agg(F.min("ts").alias("since"), F.max("ts").alias("until")).withColumn("level", F.lit(0))]
    levels += [fine.groupBy("user_id", F.date_trunc(u, "ts").alias("u")).agg(F.min("ts").alias("since"), F.max("ts").alias("until")).withColumn("level", F.lit(k)).drop("u") for k, u in enumerate(_LEVELS, 1)]
    nested = reduce(DataFrame.unionByName, levels)
    place = lambda c: F.array(F.unix_micros(F.col(c).cast("timestamp")))
    return spans.innermost(t.events.select("user_id", "event_id", "ts"), nested, ["user_id"], place("ts"), place("since"), place("until"), ["event_id"], ["level", "since"])


_SPANS = "SELECT user_id, event_id AS span_id, ts AS b, coalesce(lead(ts, 5) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2100-01-01') AS e FROM events"


@query(
    "scope_latest",
    f"""WITH s AS ({_SPANS}), p AS (SELECT user_id, event_id, ts FROM events)
        SELECT p.event_id, arg_max(s.span_id, (s.b, s.span_id)) AS span_id FROM p JOIN s ON p.user_id = s.user_id AND s.b < p.ts AND p.ts <= s.e GROUP BY p.event_id""",
)
def scope_latest(t: Tables) -> DataFrame:
    """Each event in the latest span of its user that holds it: spans reach from an event to the fifth after it."""
    later = F.lead("ts", 5).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    far = F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00"))
    s = t.events.select("user_id", F.col("event_id").alias("span_id"), F.col("ts").alias("b"), F.coalesce(later, far).alias("e"))
    p = t.events.select("user_id", "event_id", "ts")
    return spans.latest_holding(p, s, ["user_id"], "ts", "b", "e", ["event_id"], ["span_id"])


@query(
    "asof_closest",
    """WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error')
       SELECT p.user_id, p.event_id, coalesce((SELECT max_by(c.event_id, (c.ts, c.event_id)) FROM c WHERE c.user_id = p.user_id AND c.ts <= p.ts),
                                              (SELECT min_by(c.event_id, (c.ts, c.event_id)) FROM c WHERE c.user_id = p.user_id)) AS signup_id FROM p""",
)
def asof_closest(t: Tables) -> DataFrame:
    points = t.events.filter("event_type = 'error'").select("user_id", "ts", "event_id")
    rows = t.events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("signup_id"))
    return spans.closest_before(points, rows, ["user_id"], "ts", "since", ["event_id"], ["signup_id"])


@query(
    "macro_proximity",
    """SELECT conv_id, coalesce(max(turn) FILTER (WHERE role = 'assistant' AND turn < 3), min(turn) FILTER (WHERE role = 'assistant')) AS turn FROM conversations GROUP BY conv_id""",
)
def macro_proximity(t: Tables) -> DataFrame:
    """Last definition before a position, else the first one after it."""
    is_it = F.col("role") == "assistant"
    return t.conversations.groupBy("conv_id").agg(F.coalesce(F.max(F.when(is_it & (F.col("turn") < 3), F.col("turn"))), F.min(F.when(is_it, F.col("turn")))).alias("turn"))


@query(
    "scope_chain",
    """WITH c AS (SELECT n_nationkey, r_name || '::' || n_name AS scope FROM nation JOIN region ON n_regionkey = r_regionkey)
       SELECT n_nationkey, unnest([scope, split_part(scope, '::', 1), '']) AS ancestor, unnest([0, 1, 2]) AS depth FROM c""",
)
def scope_chain(t: Tables) -> DataFrame:
    scopes = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("r_name", F.lit("::"), "n_name").alias("scope"))
    return scopes.select("n_nationkey", F.posexplode(spans.chain(F.col("scope"))).alias("depth", "ancestor"))


@query(
    "visible_set",
    """WITH c AS (SELECT c_custkey AS id, c_nationkey AS k, 'own' AS arm, 0 AS o FROM customer WHERE c_nationkey = 3),
            s AS (SELECT s_suppkey, s_nationkey, 'package', 1 FROM supplier WHERE s_nationkey IN (3, 4)),
            n AS (SELECT n_nationkey, n_nationkey, 'top', 2 FROM nation WHERE n_regionkey = 1),
            r AS (SELECT r_regionkey, r_regionkey, 'import', 3 FROM region WHERE r_regionkey < 2)
       SELECT id, min(o) AS first_arm, min_by(arm, o) AS arm FROM (SELECT * FROM c UNION ALL SELECT * FROM s UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r) GROUP BY id""",
)
def visible_set(t: Tables) -> DataFrame:
    """Four arms in order of precedence; of equal names the nearest arm wins."""
    arm = lambda df, key, name, k: df.select(F.col(key).cast("long").alias("id"), F.lit(name).alias("arm"), F.lit(k).alias("first_arm"))
    arms = [
        arm(t.customer.filter("c_nationkey = 3"), "c_custkey", "own", 0),
        arm(t.supplier.filter("s_nationkey IN (3, 4)"), "s_suppkey", "package", 1),
        arm(t.nation.filter("n_regionkey = 1"), "n_nationkey", "top", 2),
        arm(t.region.filter("r_regionkey < 2"), "r_regionkey", "import", 3),
    ]
    every = arms[0].unionByName(arms[1]).unionByName(arms[2]).unionByName(arms[3])
    return every.groupBy("id").agg(F.min("first_arm").alias("first_arm"), F.min_by("arm", "first_arm").alias("arm"))


@query(
    "closure_walk",
    """WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0),
       w(root, node) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT w.root, e.dst FROM w JOIN e ON w.node = e.src)
       SELECT DISTINCT root, node FROM w""",
)
def closure_walk(t: Tables) -> DataFrame:
    """Every part with what stands above it: of one parent each, so by doubling."""
    parents = t.part.filter("p_partkey > 0").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 2").alias("parent"))
    above = closure.lineage(parents).select(F.col("node").alias("root"), F.col("ancestor").alias("node"))
    roots = t.part.select(F.col("p_partkey").alias("root"))
    return above.join(roots, "root", "left_semi").union(roots.select("root", F.col("root").alias("node"))).distinct()


@query(
    "closure_cycle",
    """WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS src, (s_nationkey * 7 + 3) % 25 AS dst FROM supplier),
       w(root, node) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT w.root, e.dst FROM w JOIN e ON w.node = e.src)
       SELECT root, count(DISTINCT node) AS n_reached FROM w GROUP BY root""",
)
def closure_cycle(t: Tables) -> DataFrame:
    edges = t.supplier.select(F.col("s_nationkey").alias("src"), ((F.col("s_nationkey") * 7 + 3) % 25).alias("dst"))
    return closure.reach(edges, t.nation.select(F.col("n_nationkey").alias("root"))).groupBy("root").agg(F.count("node").alias("n_reached"))


@query(
    "export_closure",
    """WITH RECURSIVE x AS (SELECT n_nationkey AS p, (n_nationkey * 3 + 1) % 25 AS q FROM nation WHERE n_nationkey % 2 = 0),
       w(root, node) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT w.root, x.q FROM w JOIN x ON w.node = x.p)
       SELECT DISTINCT w.root AS package, s.s_name AS name FROM w JOIN supplier s ON s.s_nationkey = w.node
       UNION SELECT DISTINCT w.root, 'single' || w.node FROM w WHERE w.node % 5 = 0""",
)
def export_closure(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    whole = t.nation.filter("n_nationkey % 2 = 0").select(n.alias("package"), ((n * 3 + 1) % 25).alias("source"), F.lit("*").alias("item"))
    single = t.nation.filter("n_nationkey % 5 = 0").select(n.alias("package"), n.alias("source"), F.concat(F.lit("single"), n.cast("string")).alias("item"))
    own = t.supplier.select(F.col("s_nationkey").alias("package"), F.col("s_name").alias("name"))
    return closure.provided(whole.unionByName(single), own, t.nation.select(n.alias("package")))


@query(
    "occurrences_family",
    r"""SELECT d.doc_id, w.word, count(*) AS n FROM documents d, (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_$]*')) AS word FROM documents) w
        WHERE d.doc_id = w.doc_id AND w.word IN ('the', 'and', 'of') GROUP BY d.doc_id, w.word""",
)
def occurrences_family(t: Tables) -> DataFrame:
    family = t.spark.createDataFrame([("the",), ("and",), ("of",)], "word string")
    found = t.documents.select("doc_id", F.explode(T.words(F.col("text"))).alias("word"))
    return found.join(F.broadcast(family), "word", "left_semi").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "queue_merge",
    """SELECT user_id, event_type, min(CASE WHEN value > 50 THEN 0 ELSE 1 END) AS rank, max(event_id) AS last_id, min(event_id) AS seq, bool_or(value > 90) AS forced, bool_and(value > 1) AS quiet
       FROM events GROUP BY user_id, event_type""",
)
def queue_merge(t: Tables) -> DataFrame:
    jobs = t.events.select("user_id", "event_type", "event_id", F.when(F.col("value") > 50, 0).otherwise(1).alias("rank"), (F.col("value") > 90).alias("forced"), (F.col("value") > 1).alias("quiet"))
    return schedule.merged(jobs, ["user_id", "event_type"], "event_id").withColumnRenamed("last", "last_id")


@query(
    "debounce_session",
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 300 SECOND THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
       SELECT user_id, max(event_id) AS event_id, count(*) AS n_events FROM s GROUP BY user_id, n""",
)
def debounce_session(t: Tables) -> DataFrame:
    return schedule.debounced(t.events, ["user_id"], "ts", 300, ["event_id"])


@query(
    "run_order",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id) AS turn FROM events",
)
def run_order(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    jobs = t.events.withColumn("rank", kind)
    return jobs.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("rank", "event_id")).cast("long").alias("turn"))


@query("reverse_edge", "SELECT DISTINCT l_suppkey AS file, l_orderkey AS includer FROM lineitem WHERE l_suppkey = 7")
def reverse_edge(t: Tables) -> DataFrame:
    return lookup.exact(t.lineitem, "l_suppkey", 7).select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("includer")).distinct()


@query(
    "sites_join",
    """SELECT o.o_orderkey, c.c_name, n.n_name, l.l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE l.l_quantity = 50""",
)
def sites_join(t: Tables) -> DataFrame:
    small = t.lineitem.filter("l_quantity = 50").select("l_orderkey", "l_linenumber")
    both = small.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = both.join(t.customer.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return named.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "l_linenumber")


@query("in_or_member", "SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderkey = 1 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)) AND o_orderkey <> 10")
def in_or_member(t: Tables) -> DataFrame:
    """A unit's own rows or those of what it includes, but one."""
    member = t.customer.filter("c_nationkey = 5").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("member")).distinct()
    joined = t.orders.select("o_orderkey", "o_custkey").join(member, "o_custkey", "left")
    return joined.filter("(o_orderkey = 1 OR member) AND o_orderkey <> 10").select("o_orderkey", "o_custkey")

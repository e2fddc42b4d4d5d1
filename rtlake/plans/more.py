"""Further relational operators bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtlake.operators import lookup, sets, spans, writes
from rtlake.plans.registry import Tables, query
from rtlake.streaming import schedule


@query("rows_of_key", "SELECT event_id, ts, event_type FROM events WHERE user_id = 7")
def rows_of_key(t: Tables) -> DataFrame:
    return lookup.exact(t.events, "user_id", 7).select("event_id", "ts", "event_type").orderBy("ts", "event_id")


@query("federated_degraded", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, 0 AS lib_ord FROM supplier UNION ALL SELECT n_nationkey, n_name, NULL, 1 FROM nation")
def federated_degraded(t: Tables) -> DataFrame:
    """A library of an older layout lacks a column, which is then null."""
    main = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    old = t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return lookup.federated(main, old)


@query("first_schema", "SELECT user_id, min(event_id % 3) AS lib_ord, min_by(event_id, (event_id % 3, event_id)) AS event_id FROM events GROUP BY user_id")
def first_schema(t: Tables) -> DataFrame:
    """Of several schemas the first that has a key, and there its first row."""
    rows = t.events.select("user_id", (F.col("event_id") % 3).alias("lib_ord"), "event_id")
    return lookup.first_wins(rows, ["user_id"], "lib_ord", "event_id")


@query("unique_names", "SELECT p_name || p_brand AS full_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name || p_brand HAVING count(*) = 1 OR count(DISTINCT p_type) = 1")
def unique_names(t: Tables) -> DataFrame:
    """Names that mean one thing wherever they are declared: the fallback of resolution by name alone."""
    by = t.part.groupBy(F.concat("p_name", "p_brand").alias("full_name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("types"), F.min("p_partkey").alias("p_partkey"))
    return by.filter("n = 1 OR types = 1").select("full_name", "p_partkey")


@query("top_level", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def top_level(t: Tables) -> DataFrame:
    """Units that nothing instantiates."""
    return writes.delete(t.customer.select("c_custkey"), t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    "reanchor",
    "SELECT e.event_id, e.user_id, o.o_orderkey AS anchor FROM events e JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) o ON e.user_id = o.o_custkey WHERE e.event_type = 'error'",
)
def reanchor(t: Tables) -> DataFrame:
    """Diagnostics move to the first current use of their subject; those without one go."""
    anchors = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderkey").alias("anchor"))
    return lookup.with_targets(t.events.filter("event_type = 'error'").select("event_id", "user_id"), anchors, "user_id")


@query(
    "changed_digests",
    """WITH d AS (SELECT user_id, sha256(string_agg(length(CAST(event_id AS VARCHAR)) || ':' || CAST(event_id AS VARCHAR), '' ORDER BY event_id)) AS digest, sha256(string_agg(length(CAST(event_id AS VARCHAR)) || ':' || CAST(event_id AS VARCHAR), '' ORDER BY event_id) FILTER (WHERE event_id % 1000 <> 0)) AS later FROM events GROUP BY user_id)
       SELECT user_id FROM d WHERE digest <> later""",
)
def changed_digests(t: Tables) -> DataFrame:
    """What to publish: keys whose digest before and after differs."""
    before = sets.digest(t.events, ["user_id"], [F.col("event_id")], ["event_id"])
    after = sets.digest(t.events.filter("event_id % 1000 <> 0"), ["user_id"], [F.col("event_id")], ["event_id"], "later")
    return before.join(after, "user_id").filter("digest <> later").select("user_id")


@query("changed_scopes", "SELECT DISTINCT split_part(n, ' ', 2) AS tail FROM (SELECT p_name AS n FROM part WHERE p_partkey % 2 = 0 EXCEPT ALL SELECT p_name FROM part WHERE p_partkey % 2 = 1)")
def changed_scopes(t: Tables) -> DataFrame:
    """Names that went, and the tail of the scope they were in."""
    a, b = (t.part.filter(F.col("p_partkey") % 2 == k).select("p_name") for k in (0, 1))
    return sets.difference(a, b).filter("change = 'removed'").select(F.substring_index("p_name", " ", -1).alias("tail")).distinct()


@query("watched_bursts", "WITH g AS (SELECT event_type, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) < INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM g) SELECT event_type, max(event_id) AS event_id, count(*) AS n_events FROM s GROUP BY event_type, n")
def watched_bursts(t: Tables) -> DataFrame:
    return schedule.bursts(t.events, ["event_type"], "ts", 1800, ["event_id"])


@query(
    "load_order",
    """SELECT CAST(s_suppkey AS VARCHAR) AS path, CASE WHEN s_suppkey % 4 IN (2, 3) AND s_suppkey - s_suppkey % 4 + 4 IN (SELECT s_suppkey FROM supplier) THEN 0 WHEN s_suppkey % 4 = 0 THEN 1
       WHEN s_nationkey IN (SELECT s_nationkey + 1 FROM supplier WHERE s_suppkey % 4 = 0) THEN 2 ELSE 3 END AS rank FROM supplier""",
)
def load_order(t: Tables) -> DataFrame:
    """Includers of open documents first, then these, then declarers of what they name, then the rest. Every fourth file is open, the two before it
    include it one through the other; a file declares its nation, and names the one before it."""
    path, key = F.col("s_suppkey").cast("string"), F.col("s_suppkey")
    files = t.supplier.select(path.alias("path"))
    includes = t.supplier.filter("s_suppkey % 4 IN (2, 3)").select(path.alias("includer"), (key + 1).cast("string").alias("included"))
    opened, names = t.supplier.filter("s_suppkey % 4 = 0").select(path.alias("path")), F.col("s_nationkey")
    return schedule.load_order(files, opened, includes, t.supplier.select(path.alias("path"), names.alias("name")), t.supplier.select(path.alias("path"), (names + 1).alias("name")))


@query("open_wins", "SELECT d.doc_id AS path, coalesce(c.text, d.text) AS text FROM documents d LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) c ON d.doc_id = c.conv_id")
def open_wins(t: Tables) -> DataFrame:
    """The open buffer of a path wins over its text on disk."""
    opened = t.conversations.filter("turn = 0").select(F.col("conv_id").alias("path"), "text", F.lit(True).alias("open"))
    known = opened.join(t.documents.select(F.col("doc_id").alias("path")), "path", "left_semi")
    return schedule.effective_text(t.documents.select(F.col("doc_id").alias("path"), "text"), known)


@query(
    "scope_contains",
    """SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n_inside FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       WHERE (l_linenumber > 2 OR (l_linenumber = 2 AND l_quantity >= 10)) AND (l_linenumber < 5 OR (l_linenumber = 5 AND l_quantity <= 30)) GROUP BY o_orderkey""",
)
def scope_contains(t: Tables) -> DataFrame:
    """Positions (line number, quantity) in a span from (2, 10) to (5, 30)."""
    inside = spans.contains(F.col("l_linenumber"), F.col("l_quantity"), (F.lit(2), F.lit(10)), (F.lit(5), F.lit(30)))
    both = t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity"), "o_orderkey")
    return both.filter(inside).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_inside"))


@query(
    "queue_due",
    """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN value > 50 THEN 0 ELSE 1 END AS rank, value > 90 AS forced, value > 1 AS quiet, event_type = 'error' AS cancel FROM events),
       g AS (SELECT *, CASE WHEN cancel OR coalesce(lag(cancel) OVER w, true) OR lag(ts) OVER w + INTERVAL 7200 SECOND <= ts THEN 1 ELSE 0 END AS fresh, lead(cancel) OVER w AS c, lead(ts) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
       r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
       SELECT user_id, max(ts) + INTERVAL 7200 SECOND AS due, min(rank) AS rank, min(event_id) AS seq, max(event_id) AS last, bool_or(forced) AS forced, bool_and(quiet) AS quiet, count(*) AS n_pushes
       FROM r WHERE NOT cancel GROUP BY user_id, run HAVING NOT bool_or(coalesce(c AND nxt < ts + INTERVAL 7200 SECOND, false))""",
)
def queue_due(t: Tables) -> DataFrame:
    """Jobs of a queue: events push work for their user, errors cancel what waits, and two quiet hours make it due."""
    work = t.events.select("user_id", "ts", F.col("event_id").alias("seq"), F.when(F.col("value") > 50, 0).otherwise(1).alias("rank"), (F.col("value") > 90).alias("forced"), (F.col("value") > 1).alias("quiet"), (F.col("event_type") == "error").alias("cancel"))
    return schedule.queued(work, ["user_id"], 7200)

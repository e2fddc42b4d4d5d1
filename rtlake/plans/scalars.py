"""Scalar functions bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtlake.functions import text as T
from rtlake.operators import spans, subsequences
from rtlake.plans.registry import Tables, query


@query("ident_occurrences", "SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_$]*')) AS word FROM documents) GROUP BY word HAVING count(*) > 3")
def ident_occurrences(t: Tables) -> DataFrame:
    """Each word's count and documents: words are counted by document first, so a common word meets no task as single rows."""
    by_doc = t.documents.select("doc_id", F.explode(T.words(F.col("text"))).alias("word")).groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs")).filter("n > 3")


@query("line_index", "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS line_text FROM documents")
def line_index(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line_text")).select("doc_id", (F.col("n") + 1).cast("long").alias("line"), "line_text")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("display_scope", "SELECT page_id, array_to_string(list_filter(string_split(split_part(regexp_replace(url, '^\\w+://', ''), '?', 1), '/'), lambda p: NOT regexp_matches(p, '^[0-9]')), '::') AS shown FROM pages")
def display_scope(t: Tables) -> DataFrame:
    """Address segments as a scope whose numbered ones are unnamed."""
    path = F.split_part(F.regexp_replace("url", r"^\w+://", ""), F.lit("?"), F.lit(1))
    scope = F.array_join(F.transform(F.split(path, "/"), lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("@"), p)).otherwise(p)), "::")
    return t.pages.select("page_id", T.display_scope(scope).alias("shown"))


@query("scope_tail", "SELECT n_nationkey, regexp_extract(s, '([^:]*)$', 1) AS tail, CASE WHEN contains(s, '::') THEN regexp_extract(s, '^(.*)::', 1) ELSE '' END AS parent FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'top::' || n_regionkey || '::' || n_name END AS s FROM nation)")
def scope_tail(t: Tables) -> DataFrame:
    scope = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("top::"), F.col("n_regionkey").cast("string"), F.lit("::"), "n_name"))
    return t.nation.select("n_nationkey", T.scope_tail(scope).alias("tail"), T.scope_parent(scope).alias("parent"))


@query("view_members", "SELECT event_id, string_split(m, ', ')[1] AS first_member, len(string_split(m, ', ')) AS n_members FROM (SELECT event_id, event_type || ', ' || props || ', ' || CAST(user_id AS VARCHAR) AS m FROM events)")
def view_members(t: Tables) -> DataFrame:
    members = T.split_keep(F.concat_ws(", ", "event_type", "props", F.col("user_id").cast("string")), ", ")
    return t.events.select("event_id", F.element_at(members, 1).alias("first_member"), F.size(members).cast("long").alias("n_members"))


@query("type_layers", "SELECT p_partkey, string_split(d, ':')[1] AS first_layer, CASE WHEN len(string_split(d, ':')) > 1 THEN array_to_string(string_split(d, ':')[2:], ':') ELSE '' END AS rest FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name ELSE p_type || ':' || p_name || CASE p_size % 3 WHEN 1 THEN '' ELSE ':' || p_brand END END AS d FROM part)")
def type_layers(t: Tables) -> DataFrame:
    m = F.col("p_size") % 3
    detail = F.when(m == 0, F.col("p_name")).otherwise(F.concat("p_type", F.lit(":"), "p_name", F.when(m == 1, F.lit("")).otherwise(F.concat(F.lit(":"), "p_brand"))))
    return t.part.select("p_partkey", F.element_at(T.type_layers(detail), 1).alias("first_layer"), T.peel(detail, 1).alias("rest"))


@query("keyword_mask", "SELECT event_id, event_type FROM events JOIN (VALUES ('view', 1), ('click', 3), ('error', 4), ('purchase', 6), ('signup', 2)) k(w, mask) ON event_type = w WHERE mask & 2 <> 0")
def keyword_mask(t: Tables) -> DataFrame:
    """Rows whose keyword is legal in a context: one bit of its mask."""
    masks = t.spark.createDataFrame([("view", 1), ("click", 3), ("error", 4), ("purchase", 6), ("signup", 2)], "event_type string, mask int")
    return t.events.join(F.broadcast(masks), "event_type").filter(F.col("mask").bitwiseAND(2) != 0).select("event_id", "event_type")


@query("base_name", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages")
def base_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.base_name(F.col("url")).alias("base"))


@query("escape_like", r"SELECT event_id, replace(replace(replace(props || '%_' || event_type, '\', '\\'), '%', '\%'), '_', '\_') AS pattern FROM events")
def escape_like(t: Tables) -> DataFrame:
    return t.events.select("event_id", T.escape_like(F.concat("props", F.lit("%_"), "event_type")).alias("pattern"))


@query("offset_to_line", "SELECT doc_id, len(b) - len(replace(b, chr(10), '')) AS line, len(string_split(b, chr(10))[-1]) AS char FROM (SELECT doc_id, left(text, CAST(n_chars // 2 AS BIGINT)) AS b FROM documents)")
def offset_to_line(t: Tables) -> DataFrame:
    place = T.line_of(F.col("text"), F.expr("CAST(n_chars div 2 AS INT)"))
    return t.documents.select("doc_id", place["line"].cast("long").alias("line"), place["char"].cast("long").alias("char"))


@query("line_to_offset", "SELECT doc_id, CASE WHEN len(l) > 2 THEN len(l[1]) + len(l[2]) + 2 + least(4, len(l[3])) END AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def line_to_offset(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.offset_of(F.col("text"), F.lit(2), F.lit(4)).cast("long").alias("place"))


@query("word_before", "SELECT doc_id, regexp_extract(left(text, CAST(n_chars // 2 AS BIGINT)), '([A-Za-z_$][A-Za-z0-9_$]*)$', 1) AS word FROM documents")
def word_before(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.word_before(F.col("text"), F.expr("CAST(n_chars div 2 AS INT)")).alias("word"))


@query("trim_blank", r"SELECT conv_id, turn, regexp_replace(regexp_replace(chr(9) || ' ' || role || ' x ' || chr(9), '^[ \t]+', ''), '[ \t]+$', '') AS trimmed FROM conversations")
def trim_blank(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.trim_blank(F.concat(F.lit("\t "), "role", F.lit(" x \t"))).alias("trimmed"))


@query("identifier_test", "SELECT p_partkey, regexp_full_match(n, '[A-Za-z_][A-Za-z0-9_$]*') AS valid FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE replace(p_name, ' ', '_') END AS n FROM part)")
def identifier_test(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    return t.part.select("p_partkey", T.is_identifier(name).alias("valid"))


@query("config_fields", "SELECT o_orderkey, length(o_orderpriority) || ':' || o_orderpriority || length(o_orderstatus) || ':' || o_orderstatus AS fields FROM orders")
def config_fields(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.concat(T.field(F.col("o_orderpriority")), T.field(F.col("o_orderstatus"))).alias("fields"))


@query("unit_order", "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '.' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS place FROM orders")
def unit_order(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", spans.unit_order(F.array("o_custkey", "o_orderkey")).alias("place"))


#: The greedy match of names and patterns (relation q: id, name, pattern), a character of the name a step.
FUZZY_SQL = r"""
, s(id, name, pattern, i, hits, place, score) AS (
  SELECT id, name, pattern, 1, 0, 0, 0 FROM q
  UNION ALL
  SELECT id, name, pattern, i + 1, hits + hit, CASE WHEN hit = 1 THEN i ELSE place END,
         score + CASE WHEN hit = 1 THEN 10 - (i - place - 1) + CASE WHEN hits > 0 AND i = place + 1 THEN 15 ELSE 0 END + begins + CASE WHEN substr(name, i, 1) = substr(pattern, hits + 1, 1) THEN 3 ELSE 0 END ELSE 0 END
  FROM (SELECT *, CASE WHEN hits < length(pattern) AND lower(substr(name, i, 1)) = lower(substr(pattern, hits + 1, 1)) THEN 1 ELSE 0 END AS hit,
               CASE WHEN i = 1 OR substr(name, i - 1, 1) IN ('_', '-', '.', ':') OR (regexp_matches(substr(name, i, 1), '[A-Z]') AND regexp_matches(substr(name, i - 1, 1), '[a-z0-9]')) THEN 12 ELSE 0 END AS begins
        FROM s WHERE i <= length(name)) t)
"""
FUZZY_END = "score - strlen(name) // 10 AS INT) AS score FROM s WHERE i = length(name) + 1 AND hits = length(pattern)"


@query("fuzzy_rank", f"WITH RECURSIVE q AS (SELECT p_partkey AS id, p_name AS name, 'rwd' AS pattern FROM part){FUZZY_SQL}SELECT id AS p_partkey, name AS p_name, CAST({FUZZY_END}")
def fuzzy_rank(t: Tables) -> DataFrame:
    """Names that match a pattern as a subsequence, with their score."""
    return t.part.select("p_partkey", "p_name", T.fuzzy_score(F.col("p_name"), F.lit("rwd")).alias("score")).filter("score IS NOT NULL")


@query(
    "fuzzy_matches",
    "WITH RECURSIVE p AS (SELECT DISTINCT lower(substr(n_name, 1, 3)) AS pattern FROM nation), n AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part), q AS (SELECT 0 AS id, name, pattern FROM p, n WHERE name ILIKE '%' || substr(pattern, 1, 1) || '%' || substr(pattern, 2, 1) || '%' || substr(pattern, 3, 1) || '%')"
    f"{FUZZY_SQL}SELECT pattern, name, CAST({FUZZY_END}",
)
def fuzzy_matches(t: Tables) -> DataFrame:
    """All names that hold any of many patterns: each pattern meets the names of its rarest pair of characters alone."""
    patterns = t.nation.select(F.lower(F.substring("n_name", 1, 3)).alias("pattern"))
    posted = subsequences.postings(t.part.select(F.concat("p_name", F.lit(" "), "p_brand").alias("name")), patterns=patterns)
    return subsequences.matches(patterns, posted, subsequences.counts(posted))

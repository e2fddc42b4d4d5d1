"""Line dedup by a deletion-neighbourhood join (native).

Lines are sequences of words. Of lines with equal words, in any document, the earliest stays; so it does among lines of
``LEAST`` words or more that one edit (a word put in, taken out or replaced) turns into each other. "Earliest" is by
doc_id and line number, nulls first, and decides line by line: a line goes if an equal or neighbouring one comes
earlier, whether or not that one stays.

Distinct lines are found by 128 bits of hash. A lossless filter then leaves only those that share a half with
another: an edit spares the first or the last half of the shorter line. These emit, hashed, every variant with one word
deleted and every variant with a gap where a word may be missing, each with its place; lines with equal variants are
neighbours. The least line of each variant is found by a partial aggregate, its edit distance to each other line with
that variant is verified on the words, and the later one goes. No pairs within a group are made.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rtlake.llm.common import WORD, cut, let, small, table

#: Words from which lines may differ by an edit: one of five keeps a similarity of 0.8.
LEAST = 5
#: Halves of a line that near ones may share: each column's key, in the order of their bits.
HALVES = ("head", "tail", "less_head", "less_tail")


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def _halves(words: Column, n: Column) -> dict[str, Column]:
    """Keys of a line's halves, for partners at most as long (m = n - 1) and at least as long (m = n); null for short lines."""

    def key(name: str, m: Column, head: bool) -> Column:
        h = F.floor(m / 2).cast("int")
        return F.xxhash64(F.lit(name), m, F.slice(words, F.lit(1), h) if head else F.slice(words, -h, h))

    return {
        "head": F.when(n >= LEAST, key("p", n, True)), "tail": F.when(n >= LEAST, key("s", n, False)),
        "less_head": F.when(n > LEAST, key("p", n - 1, True)), "less_tail": F.when(n > LEAST, key("s", n - 1, False)),
    }


def _keyed() -> Column:
    """The columns of ``_halves`` as an array of key and bit."""
    return F.filter(F.array(*[F.struct(F.col(name).alias("key"), F.lit(1 << i).alias("bit")) for i, name in enumerate(HALVES)]), lambda x: x["key"].isNotNull())


def _shared(n: Column) -> Column:
    """The halves of a line of ``n`` words whose bits are set in ``shared``: m, and whether it is the first half."""
    every = [F.struct((n - i // 2).alias("m"), F.lit(i % 2 == 0).alias("head"), F.lit(1 << i).alias("bit")) for i in range(len(HALVES))]
    return F.filter(F.array(*every), lambda x: F.col("shared").bitwiseAND(x["bit"]) > 0)


def _place(doc_id: Column, line: Column, version: Column) -> Column:
    """One number in the order of doc_id (null first) and line; among rows with one id, by a hash of the text. Flat, so that hash aggregates keep it."""
    doc = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(Decimal(-(10**19))))
    rest = line.cast("long") * 100_000_000 + F.pmod(version, F.lit(100_000_000))
    return (doc * F.lit(Decimal(10**18)) + rest.cast("decimal(19,0)")).cast("decimal(38,0)")


def _chained(words: Column) -> Column:
    """Hashes of the first 0, 1, ... words: each is the last one's, with the next word mixed in."""
    return F.aggregate(words, F.array(F.lit(42).cast("long")), lambda h, w: F.array_append(h, F.xxhash64(F.element_at(h, -1), w)))


def _variants(words: Column, shared: Column) -> Column:
    """Distinct hashed variants of a line for each of ``shared``: the words m of a shorter line, and whether its first half is shared."""

    def of(n: Column, heads: Column, tails: Column) -> Column:
        key = lambda length, i, tail: F.xxhash64(length, i, F.get(heads, i), F.get(tails, tail))

        def one(s: Column) -> Column:
            h = F.floor(s["m"] / 2).cast("int")
            low, high = F.when(s["head"], h).otherwise(0), F.when(s["head"], n).otherwise(h)  # the edit's place, from 0
            gone = F.transform(F.sequence(low, F.least(high, n - 1)), lambda i: key(n, i, n - i - 1))
            gaps = F.transform(F.sequence(low, high), lambda i: key(n + 1, i, n - i))
            return F.when(s["m"] == n, F.concat(gone, gaps)).otherwise(gone)

        return F.array_distinct(F.flatten(F.transform(shared, one)))

    return let(_chained(words), lambda heads: let(_chained(F.reverse(words)), lambda tails: of(F.size(heads) - 1, heads, tails)))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether at most one word put in, taken out or replaced turns ``a`` into ``b``: one place, and the same on both sides of it."""
    n, k = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), k), lambda i: F.element_at(a, i) == F.element_at(b, i))
    place = lambda s: F.coalesce(F.nullif(F.array_position(s, F.lit(False)), F.lit(0)), k + 1).cast("int")
    tail = lambda i: F.slice(F.when(F.size(a) >= F.size(b), a).otherwise(b), i + 1, n) == F.slice(F.when(F.size(a) >= F.size(b), b).otherwise(a), F.when(F.size(a) == F.size(b), i + 1).otherwise(i), n)
    return (n - k <= 1) & let(same, lambda s: let(place(s), tail))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), line (from 0), raw (its text)."""
    return docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))


def kept_lines(docs: DataFrame) -> DataFrame:
    """doc_id, version, kept (array of line numbers): of documents in which a line with words stays."""
    worded = _lines(docs).filter(F.col("raw").rlike(WORD)).select("doc_id", "version", "line", words_of(F.col("raw")).alias("words"))
    n = F.size("words")
    hashed = worded.select(
        "doc_id", "version", _place(F.col("doc_id"), F.col("line"), F.col("version")).alias("place"),
        F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("2"), "words").alias("h2"), *[c.alias(name) for name, c in _halves(F.col("words"), n).items()],
    )
    same = [F.first(c).alias(c) for c in HALVES]  # functions of the words
    distinct = hashed.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.min_by("doc_id", "place").alias("doc_id"), F.min_by("version", "place").alias("version"), *same).drop("h1", "h2")
    distinct = cut(distinct)
    halved = distinct.select("place", "doc_id", "version", F.explode(_keyed()).alias("half")).select("place", "doc_id", "version", "half.*")
    keys = halved.groupBy("key").count().filter("count > 1").select("key")
    near = cut(halved.join(small(keys), "key").groupBy("place", "doc_id", "version").agg(F.bit_or("bit").alias("shared")))
    # Their words: only documents that hold such lines are split again.
    holders = small(near.select(F.col("doc_id").alias("holder"), F.col("version").alias("its")).distinct())
    held = docs.join(holders, docs["doc_id"].eqNullSafe(F.col("holder")) & (F.xxhash64(docs["text"]) == F.col("its")), "left_semi")
    every = _lines(held).select(_place(F.col("doc_id"), F.col("line"), F.col("version")).alias("place"), "version", "raw")
    near = every.join(small(near).select("place", "version", "shared"), ["place", "version"]).dropDuplicates(["place", "version"])
    near = cut(near.select("place", words_of(F.col("raw")).alias("words"), "shared"))
    emitted = near.select("place", F.explode(_variants(F.col("words"), _shared(F.size("words")))).alias("key"))
    first = emitted.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    pairs = emitted.join(small(first), "key").filter(F.col("first") < F.col("place")).select("place", "first").distinct()
    own = near.select(F.col("place").alias("p"), "words")
    pairs = pairs.join(own.withColumnRenamed("words", "a"), F.col("place") == F.col("p")).drop("p")
    pairs = pairs.join(own.withColumnRenamed("words", "b"), F.col("first") == F.col("p")).drop("p")
    gone = pairs.filter(_one_edit(F.col("a"), F.col("b"))).select(F.col("place").alias("gone")).distinct()
    stay = distinct.select("place", "doc_id", "version").join(gone, F.col("place") == F.col("gone"), "left_anti")
    line = F.expr("CAST(CAST(pmod(place, 1000000000000000000BD) AS BIGINT) DIV 100000000 AS INT)")
    return stay.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(line)).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay, n_lines and n_kept (null for a null text): one row per row.

    Blank lines stay. Null text stays null. Null ids come first in order. Rows with one id and one text are one
    document and keep the same lines. Other columns pass through, whatever their names; the two new ones replace
    columns of their names.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("version"))
    kept = kept_lines(docs.select("doc_id", "text")).select(F.struct("doc_id", "version").alias("__key"), F.col("kept").alias("__kept"))
    rows = docs.withColumn("__own", key)
    rows = rows.join(kept, rows["__own"].eqNullSafe(kept["__key"]), "left")
    blank = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), -1).otherwise(i)), lambda i: i >= 0)
    stay = lambda lines: F.sort_array(F.concat(F.coalesce(F.col("__kept"), F.array().cast("array<int>")), blank(lines)))
    built = let(F.split("text", "\n"), lambda lines: let(stay(lines), lambda s: F.struct(F.array_join(F.transform(s, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(lines).alias("n"), F.size(s).alias("k"))))
    whole = F.when(F.size("__kept") == F.size(F.split("text", "\n")), F.struct(F.col("text"), F.size("__kept").alias("n"), F.size("__kept").alias("k"))).otherwise(built)
    out = rows.withColumn("__built", F.when(F.col("text").isNotNull(), whole))
    new = {"text": F.col("__built.text"), "n_lines": F.col("__built.n").cast("long"), "n_kept": F.col("__built.k").cast("long")}
    return out.withColumns(new).drop("__own", "__key", "__kept", "__built")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without lines that repeat an earlier one or are one word's edit from it.

    Edits are of words: a character edit in one word of a line is caught, in two words it isn't; lines under five words
    go only if they are repeated exactly.
    """
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
w AS (SELECT doc_id, line, raw, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS words FROM l),
d AS (SELECT words, len(words) AS n, min({'d': doc_id, 'l': line}) AS place FROM w WHERE len(words) > 0 GROUP BY words),
i AS (SELECT d.*, unnest(generate_series(0, n)) AS i FROM d WHERE n >= 5),
v AS (SELECT place, n AS len, i, words[1:i] || words[i + 2:] AS rest FROM i WHERE i < n
      UNION ALL SELECT place, n + 1, i, words FROM i),
f AS (SELECT len, i, rest, min(place) AS least FROM v GROUP BY len, i, rest HAVING count(*) > 1),
gone AS (SELECT DISTINCT v.place FROM v JOIN f ON v.len = f.len AND v.i = f.i AND v.rest = f.rest WHERE f.least < v.place),
stay AS (SELECT place.d AS doc_id, place.l AS line FROM d WHERE place NOT IN (SELECT place FROM gone)),
k AS (SELECT w.doc_id, w.line, w.raw, len(w.words) = 0 OR s.line IS NOT NULL AS kept FROM w LEFT JOIN stay s ON w.doc_id = s.doc_id AND w.line = s.line)
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE kept), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE kept) AS n_kept
FROM k GROUP BY doc_id
"""

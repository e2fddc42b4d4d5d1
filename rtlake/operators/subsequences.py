"""Search for names that hold a pattern as a subsequence, by an inverted index of character pairs.

A name holds the pair ``ab`` if an ``a`` stands anywhere before a ``b``, in either case. Whatever holds a pattern as a subsequence
holds each pair that the pattern holds, so the list of the pattern's rarest pair loses nothing; what is in it is scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtlake.functions import text as T


def _folded(text: str) -> Column:
    """The characters of a text in small letters; none of an empty one."""
    each = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.filter(F.transform(each, lambda i: F.lower(F.substring(F.col(text), i, F.lit(1)))), lambda c: c != "")


def _with_grams(df: DataFrame, column: str, letters: DataFrame | None = None) -> DataFrame:
    """``df`` with ``grams``: the distinct characters of a text and pairs of them in order; none of a null or empty text.

    The first and last place of each character tell which pairs there are: as many as distinct characters, squared, at most.
    Given ``letters`` (one row: __letters array), only grams of these characters are made.
    """
    distinct = F.array_distinct("__chars") if letters is None else F.array_intersect("__chars", "__letters")
    back = F.reverse("__chars")
    ends = F.transform(distinct, lambda c: F.struct(c.alias("c"), F.array_position("__chars", c).alias("first"), (F.size("__chars") + 1 - F.array_position(back, c)).alias("last")))
    pairs = F.flatten(F.transform("__ends", lambda a: F.transform(F.filter("__ends", lambda b: a["first"] < b["last"]), lambda b: F.concat(a["c"], b["c"]))))
    out = df if letters is None else df.crossJoin(F.broadcast(letters))
    out = out.withColumn("__chars", _folded(column)).withColumn("__ends", ends)
    grams = F.array_distinct(F.concat(F.transform("__ends", lambda e: e["c"]), pairs))
    return out.withColumn("grams", F.coalesce(grams, F.array().cast("array<string>"))).drop("__chars", "__ends", "__letters")


def _listed(texts: DataFrame, column: str, letters: DataFrame | None = None) -> DataFrame:
    """(gram, ``column``) of the distinct texts that are neither null nor empty; a null gram of a text that holds none of ``letters``.

    An outer explode: from a plain one Spark infers that ``grams`` has elements, and asks that of every row before the distinct, with
    all that grams are made of written out again at each of its places.
    """
    distinct = texts.filter(F.col(column) != "").distinct()
    return _with_grams(distinct, column, letters).select(F.explode_outer("grams").alias("gram"), column)


def asked(patterns: DataFrame) -> DataFrame:
    """(gram, pattern) of the distinct patterns of ``patterns`` (pattern string) that are neither null nor empty."""
    return _listed(patterns.select("pattern"), "pattern")


def postings(names: DataFrame, column: str = "name", patterns: DataFrame | None = None) -> DataFrame:
    """(gram, name) of the distinct names; given ``patterns`` (pattern string), the lists that these ask for and no others."""
    texts = names.select(F.col(column).alias("name"))
    if patterns is None:
        return _listed(texts, "name")
    letters = patterns.select(F.explode_outer(_folded("pattern")).alias("c")).agg(F.collect_set("c").alias("__letters"))  # at most an alphabet
    return _listed(texts, "name", letters).join(asked(patterns).select("gram").distinct(), "gram", "left_semi")


def counts(posted: DataFrame) -> DataFrame:
    """(gram, n): how many names hold each gram; as many rows as the alphabet has pairs, whatever the names."""
    return posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def updated(posted: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """Postings of ``names``, given those of an earlier state: lists are made for new names alone."""
    now = names.select(F.col(column).alias("name")).filter("name <> ''").distinct()
    new = now.join(posted.select("name").distinct(), "name", "left_anti")
    return posted.join(now, "name", "left_semi").select("gram", "name").union(postings(new))


def candidates(posted: DataFrame, held: DataFrame, pattern: str) -> DataFrame:
    """(name) of the list of the pattern's rarest gram (``held``: ``counts``); no rows if a gram of it is in no name.

    The gram is a filter that reaches the scan of the postings. The pattern may not be empty: that is in every name.
    """
    if not pattern:
        raise ValueError("an empty pattern is in every name")
    spark = posted.sparkSession
    wanted = _with_grams(spark.sql("SELECT 1").select(F.lit(pattern).alias("pattern")), "pattern").first()["grams"]
    found = sorted((r["n"], r["gram"]) for r in held.filter(F.col("gram").isin(*wanted)).collect())
    if len(found) < len(wanted):
        return posted.select("name").limit(0)
    return posted.filter(F.col("gram") == found[0][1]).select("name")


def search(names: DataFrame, posted: DataFrame, held: DataFrame, pattern: str) -> DataFrame:
    """(name, score) of the distinct names that hold ``pattern``; only candidates are scored, all names for an empty one."""
    some = candidates(posted, held, pattern) if pattern else names.select("name").distinct()
    return some.withColumn("score", T.fuzzy_score(F.col("name"), F.lit(pattern))).filter("score IS NOT NULL")


def matches(patterns: DataFrame, posted: DataFrame, held: DataFrame) -> DataFrame:
    """(pattern, name, score) for each distinct pattern of ``patterns`` (pattern string) and each name that holds it.

    An equi-join of each pattern's rarest gram with the postings: no pattern meets names outside that list. Null and empty
    patterns match nothing. ``posted`` and ``held`` have the grams of these patterns at least.
    """
    by = asked(patterns).join(held, "gram", "left").groupBy("pattern").agg(F.min(F.struct("n", "gram")).alias("rarest"), F.bool_and(F.col("n").isNotNull()).alias("whole"))
    lists = by.filter("whole").select("pattern", F.col("rarest.gram").alias("gram"))
    return lists.join(posted, "gram").select("pattern", "name", T.fuzzy_score(F.col("name"), F.col("pattern")).alias("score")).filter("score IS NOT NULL")

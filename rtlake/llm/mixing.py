"""Mixing sources to target weights (native).

Hash-threshold histograms: each document has a 60-bit hash of its id. Words are summed by source and by the
hash's first 12 bits; a running sum finds, for each source, the bucket in which its budget ends; only that
bucket is split by the next 12 bits, and so a third time. A document is taken if its hash lies below the
threshold so found: no sort of documents, one compact table read four times.

Thresholds nest: a larger budget takes a superset. A target beyond a source's size takes every document
floor(target / size) times and the rest by threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rtlake.llm.common import WORD, cut, small, table

#: Weights by rank of the source's name, repeating; most copies of a source (fixed by the contract).
WEIGHTS = (5, 2, 1)
MOST = 3
#: Bits of the hash, and those that each level of the histogram reads.
BITS, LEVELS = 60, (12, 12, 12)


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text: the same in every engine and run."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: shares by weight, at most ``most`` sizes each, the excess reshared.

    Closed form of the repeated resharing: with sources ordered by cap / weight, the capped ones are a prefix,
    and every other gets one level times its weight. One row per source, so the windows are small.
    """
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    all_rows = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ranked) - 1) % len(weights) + 1).cast("double")
    level = (F.col("total") - F.col("capped")) / F.col("open_weight")
    return (
        sizes.withColumns({"weight": w, "cap": F.col("source_size").cast("double") * most})
        .withColumns({"ratio": F.col("cap") / F.col("weight"), "total": F.sum(F.col("source_size").cast("double")).over(all_rows)})
        .withColumns(
            {
                "capped": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
                "open_weight": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
            }
        )
        .withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("ratio", level.alias("l")))).over(all_rows)["l"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))))
        .select("source", "source_size", "target")
    )


def _key(source: Column) -> Column:
    """A source as a key that isn't null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def thresholds(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size, hash) of documents -> key, source_size, target, whole, threshold, stored: one row per source.

    A source's documents are taken ``whole`` times, and once more if the hash's first bits are at most ``threshold``.
    """
    at = [sum(LEVELS[: i + 1]) for i in range(len(LEVELS))]
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.least(F.coalesce(F.floor(F.col("target") / F.col("source_size")), F.lit(0)), F.lit(most)).cast("long")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long"))
    plan = cut(plan.withColumns({"key": _key(F.col("source")), "left": F.col("target") - F.col("whole") * F.col("source_size"), "prefix": F.lit(0).cast("long")}))
    base = base.withColumn("key", _key(F.col("source")))
    edge = cut(plan.select("key", "left", "prefix"))  # the cell in which the budget ends, and what of it is left there
    for level, bits in enumerate(at):
        above = bits - LEVELS[level]
        cells = (
            base.join(small(edge), "key")
            .filter(F.shiftright("hash", BITS - above) == F.col("prefix") if above else F.lit(True))
            .groupBy("key", F.shiftright("hash", BITS - bits).alias("cell"))
            .agg(F.sum("size").alias("cell_size"), F.first("left").alias("left"))
            .withColumn("upto", F.sum("cell_size").over(Window.partitionBy("key").orderBy("cell")))
        )
        first = cells.filter(F.col("upto") > F.col("left")).groupBy("key").agg(F.min(F.struct("cell", "cell_size", "upto", "left")).alias("f"))
        edge = cut(first.select("key", (F.col("f.left") - F.col("f.upto") + F.col("f.cell_size")).alias("left"), F.col("f.cell").alias("prefix"), F.col("f.cell_size").alias("cell_size")))
    below = edge.select("key", F.when(2 * F.col("left") >= F.col("cell_size"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))
    return cut(plan.select("key", "source_size", "target", "whole").join(below, "key", "left"))


def _copies(doc_hash: Column, most: int) -> Column:
    """How often a document is taken, from the columns of ``thresholds``; rows without words in a source at its cap are held to ``most`` too."""
    once = (F.shiftright(doc_hash, BITS - sum(LEVELS)) <= F.col("threshold")).cast("long")
    return F.least(F.col("whole") + F.coalesce(once, F.lit(0)), F.lit(most).cast("long"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("hash"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Documents -> doc_id, source, size, source_size, target, copies (long, at most ``most``), taken (long): one row per row of ``docs``.

    Null text: size 0. Null source: a source of its own, last in order. Null id: hashed as the empty text.
    Rows with one id share a hash and so a decision. Empty table: no rows. Other columns are not read.
    """
    base = cut(_sized(docs))
    both = base.withColumn("key", _key(F.col("source"))).join(small(thresholds(base, weights, most)), "key")
    both = both.withColumn("copies", _copies(F.col("hash"), most))
    return both.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as ``mix`` takes it.

    The decision follows from a row's source and id alone, so texts stay where they are: only thresholds are sent.
    """
    plan = thresholds(cut(_sized(docs)), weights, most)
    plan = small(cut(plan.select(*[F.col(c).alias(f"__mix_{c}") for c in plan.columns])))
    once = F.coalesce((F.shiftright(hash60(docs["doc_id"]), BITS - sum(LEVELS)) <= F.col("__mix_threshold")).cast("long"), F.lit(0))
    copies = F.least(F.col("__mix_whole") + once, F.lit(most).cast("long"))
    both = docs.join(plan, _key(docs["source"]) == F.col("__mix_key")).withColumn("__mix_copies", copies).filter(F.col("__mix_copies") > 0)
    return both.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), "__mix_copies")).alias("__mix_nth")).drop("__mix_nth")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``: how many words of each are taken."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) >> 24 AS cell
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight,
      3.0 * source_size::DOUBLE AS cap, sum(source_size::DOUBLE) OVER () AS total FROM src),
r AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
lv AS (SELECT min_by(lev, cap / weight) AS lev FROM r WHERE lev <= cap / weight),
plan AS (SELECT source, source_size, least(cap, coalesce((SELECT lev FROM lv), 0) * weight) AS target FROM r),
p2 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM plan),
cells AS (SELECT source, cell, sum(size) AS cell_size FROM base GROUP BY source, cell),
run AS (SELECT c.*, p.target - p.whole * p.source_size AS budget, sum(c.cell_size) OVER (PARTITION BY c.source ORDER BY c.cell) AS upto
        FROM cells c JOIN p2 p ON c.source IS NOT DISTINCT FROM p.source),
edge AS (SELECT source, min_by(CASE WHEN 2 * (budget - upto + cell_size) >= cell_size THEN cell ELSE cell - 1 END, cell) AS threshold
         FROM run WHERE upto > budget GROUP BY source)
SELECT b.doc_id, b.size, p.source_size, p.target,
       CAST(b.size * (p.whole + CASE WHEN b.cell <= e.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM base b JOIN p2 p ON b.source IS NOT DISTINCT FROM p.source LEFT JOIN edge e ON b.source IS NOT DISTINCT FROM e.source
"""

"""Document fingerprints by threshold-scaled sketches (native).

A document's sketch keeps every hash of its five-word shingles below a fixed fraction of the hash range. The fractions are
nested: all, 1/2, 1/4, 1/8, 1/16. A text takes the densest of which it has at most ``BOUND`` hashes, and the sparsest,
``SPARSEST``, if it has more in each: so a long text is always sampled at one rate, and a short one is complete. Two sketches are
compared at the sparser of their fractions, where both keep every hash: intersections estimate containment whatever the
sizes, and the sketch of a union is the union of sketches there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rtlake.llm.common import WORD, let, table

#: Words of a shingle; hashes that a fraction may keep before the next sparser one is taken.
SHINGLE, BOUND = 5, 128
#: Bits of a hash that are kept, and the sparsest fraction (one in so many, a power of two).
BITS, SPARSEST = 32, 16
#: What the hashes of the fractions are below, from the densest on.
LIMITS = [(1 << BITS) >> level for level in range(SPARSEST.bit_length())]
_LOW = -(1 << 63)


def sketch(text: Column, shingle: int = SHINGLE, bound: int = BOUND) -> Column:
    """struct<limit: long, hashes: array<long>>: all distinct hashes below ``limit``, in order.

    Fewer words than a shingle: the whole sequence is one. No words or a null text: no hashes, complete. Words are hashed once
    and shingles from their words' hashes.
    """

    def of(words: Column) -> Column:
        n = F.size(words)
        at = F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0)))
        one = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(words, i + k) for k in range(shingle)]), 64 - BITS)
        return F.when(n > 0, F.sort_array(F.array_distinct(F.transform(at, one)))).otherwise(F.array().cast("array<long>"))

    def kept(hashes: Column) -> Column:
        beyond = F.get(hashes, F.lit(bound))  # null if all fit
        limit = F.coalesce(F.when(beyond.isNull(), F.lit(LIMITS[0])), *[F.when(beyond >= x, F.lit(x)) for x in LIMITS[1:]], F.lit(LIMITS[-1]))
        return let(limit, lambda e: F.struct(e.alias("limit"), F.filter(hashes, lambda h: h < e).alias("hashes")))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return let(let(F.transform(words, lambda w: F.xxhash64(w)), of), kept)


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller of two sketched sets in the other, 0 to 1; of equal sketches 1, of an empty and another 0."""
    within = lambda limit: (F.filter(a["hashes"], lambda h: h < limit), F.filter(b["hashes"], lambda h: h < limit))

    def ratio(limit: Column) -> Column:
        x, y = within(limit)
        less = F.least(F.size(x), F.size(y))
        return F.when(less > 0, F.size(F.array_intersect(x, y)) / less).otherwise(0.0)

    return F.when(a["hashes"] == b["hashes"], 1.0).otherwise(let(F.least(a["limit"], b["limit"]), ratio)).cast("double")


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two sketched sets."""
    limit = F.least(a["limit"], b["limit"])
    return F.struct(limit.alias("limit"), F.filter(F.array_sort(F.array_union(a["hashes"], b["hashes"])), lambda h: h < limit).alias("hashes"))


def as_text(s: Column) -> Column:
    """A sketch as text: the fraction (one in so many), a colon, and the hashes' four bytes each in base64 without line ends."""
    every = F.array_join(F.transform(s["hashes"], lambda h: F.lpad(F.hex(h), BITS // 4, "0")), "")
    return F.concat((F.lit(LIMITS[0]) / s["limit"]).cast("int").cast("string"), F.lit(":"), F.translate(F.base64(F.unhex(every)), "\r\n", ""))


def followed(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) with the next document's text and sketch, in descending order of doc_id, the first after the last.

    Bounds that are ids of the table cut the order into ranges; one exchange deals documents to their range, and
    the first of each range also to the range before it, as context. Null ids come last; rows with one id follow
    each other by hash and text.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col("doc_id"), F.lit(_LOW))
    rows = docs.select("doc_id", order.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts, first = rows.agg(F.percentile_approx("key", shares, 10_000).alias("cuts"), F.max("key").alias("first")).first()
    bounds = sorted({*(cuts or []), first} - {None}, reverse=True)  # the first id of each range
    if not bounds:
        return rows.select("doc_id", "text", F.lit(None).cast("string").alias("next_text"), sketch(F.col("text")).alias("sketch"), sketch(F.col("text")).alias("next_sketch")).filter(F.lit(False))
    starts = F.array(*[F.lit(b) for b in bounds])
    own = F.size(F.filter(starts, lambda b: b >= F.col("key"))) - 1
    starts_here = F.array_contains(starts, F.col("key"))
    before = F.pmod(F.col("range") - 1, F.lit(len(bounds)))
    dealt = (
        rows.withColumns({"sketch": sketch(F.col("text")), "range": own})
        .withColumn("to", F.explode(F.when(starts_here, F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("context")), F.struct(before.alias("r"), F.lit(True).alias("context")))).otherwise(F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("context"))))))
        .select("doc_id", "key", "text", "sketch", F.col("to.r").alias("range"), F.col("to.context").alias("context"))
    )
    w = Window.partitionBy("range").orderBy("context", F.desc("key"), F.xxhash64("text"), "text")
    out = dealt.withColumns({"next_text": F.lead("text").over(w), "next_sketch": F.lead("sketch").over(w)})
    return out.filter(~F.col("context")).select("doc_id", "text", "next_text", "sketch", "next_sketch")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per row of ``docs``.

    The edited text has the last third of the code points replaced by as many of the next document's first.
    A null text is an empty one. A single document follows itself. Empty table: no rows. Other columns aren't read.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = followed(docs).withColumns({"n_chars": n.cast("long"), "edited": edited}).drop("text", "next_text")
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts, and how alike they are."""
    return fingerprints(table(spark, sf_dir, "documents"))

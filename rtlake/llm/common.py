"""What the training-data operators share: tables, lineage cuts, sized broadcasts, bounded samples."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a stored side up to which it may be broadcast (beyond, the join shuffles), and of a stored table that a task reads.
BROADCAST_BYTES, PART_BYTES = 24 << 20, 2 << 20


@dataclass
class Stored:
    """Where a table was stored, how many bytes it has there, and how many tasks read it."""

    path: str
    size: int
    parts: int


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Only Spark's reader opens the path, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; one of its own only where a local session names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rtlake-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _path(spark: SparkSession, path: str):
    """A folder as Hadoop's path, and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    at, store = _path(spark, path)
    store.delete(at, True)


def cut(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and forgets its lineage.

    What it takes there decides how many tasks read it. ``like``, a stored table that is hardly smaller, bounds the tasks
    that write it: small tables make few files, however many partitions a shuffle has.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    out = (df if like is None else df.coalesce(like.stored.parts)).checkpoint(eager=True)
    rdd = out._jdf.queryExecution().logical().rdd()
    path = rdd.getCheckpointFile().get()
    at, store = _path(spark, path)
    size = store.getContentSummary(at).getLength()
    parts = max(1, -(-size // PART_BYTES))
    if parts < rdd.getNumPartitions():
        out = out.coalesce(parts)
    out.stored = Stored(path, size, min(parts, max(1, rdd.getNumPartitions())))
    return out


def release(df: DataFrame | None) -> None:
    """Deletes a stored table that nothing will read again; without this its files stay until the session's cleaner, if enabled, finds them."""
    if df is not None:
        remove(df.sparkSession, df.stored.path)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks ``df`` for broadcast if it takes at most ``most`` bytes once stored; else leaves the join to shuffle."""
    df = df if "stored" in vars(df) else cut(df)
    return F.broadcast(df) if df.stored.size <= most else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, even where the optimiser would copy it into a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of this document are kept from training: crc32 of the id as text, mod 5, is 0."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5) == 0


def labelled_sample(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` rows (doc_id, label) that may be learnt from, chosen by the hash of the id.

    Rows without an id or with a label other than 0 or 1 are left out; of several rows with one id the
    largest label counts. The bound is what makes the result safe to broadcast.
    """
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )

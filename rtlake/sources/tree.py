"""Source trees as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def files(spark: SparkSession, paths: Sequence[str], pattern: str = "*.{sv,svh,v,vh}") -> DataFrame:
    """(path, text, size, modified) of files under ``paths``; missing folders are skipped, undecodable bytes replaced."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    rows = reader.load(list(paths))
    return rows.select(F.regexp_replace("path", "^file:", "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def index_location(config_path: str, cache: str) -> str:
    """The default folder of a project's index: the cache and 16 digits of the configuration path's SHA-256."""
    import hashlib

    return f"{cache}/{hashlib.sha256(config_path.encode()).hexdigest()[:16]}"


def upgraded(table: DataFrame, ddl: str) -> DataFrame:
    """A table of an older index with the columns of the present one; those it lacks are null."""
    have = set(table.columns)
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)])

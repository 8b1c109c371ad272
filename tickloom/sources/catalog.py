"""File catalogs: which files a lake holds, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import files, symbols

PARTS = ["subject", "source", "exchange", "instrument", "time", "time_kind"]


def list_files(spark: SparkSession, root: str, subject: str | None = None) -> DataFrame:
    """``path, length, modificationTime`` of the lake's Parquet files; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(f"{root}/{subject}" if subject else root)
        .select("path", "length", "modificationTime")
    )


def parse_catalog(paths: DataFrame, subject: str | None = None) -> DataFrame:
    """Catalog rows of positional paths; paths that disagree with themselves are left out."""
    parsed = files.parse_positional_paths(paths)
    if subject:
        parsed = parsed.where(F.col("subject") == subject)
    name = files.file_id(*[F.col(c) for c in PARTS[:5]])
    return parsed.select(name.alias("file_id"), *PARTS, *paths.columns)


def hive_catalog(paths: DataFrame) -> DataFrame:
    """Catalog of a hive lake, as compaction reads it; the file id is the path."""
    return files.parse_hive_paths(paths).select(
        symbols.join_market(F.col("exchange"), F.col("instrument")).alias("market"),
        F.col("path").alias("file_id"),
        "source",
        "s",
        "e",
        "tier",
        *[F.col("modificationTime").alias("modified") for c in paths.columns if c == "modificationTime"],
    )


def find(spark: SparkSession, root: str, subject: str | None = None) -> DataFrame:
    """All files of a positional lake, ordered by file id."""
    return parse_catalog(list_files(spark, root, subject), subject).orderBy("file_id")


def merge_catalogs(data: DataFrame, write_ahead: DataFrame) -> DataFrame:
    """Both catalogs in one ordered list; at equal ids the write-ahead file comes last."""
    return (
        data.withColumn("kind", F.lit("data"))
        .unionByName(write_ahead.withColumn("kind", F.lit("wal")))
        .orderBy("file_id", "kind")
    )

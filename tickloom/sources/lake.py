"""The trade lake: Parquet under ``trades/year=/exchange=/instrument=/source=``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema
from tickloom.functions import files, symbols

ROW_GROUP_ROWS = 1_000_000


def scan(spark: SparkSession, root: str, subject: str = "trades") -> DataFrame:
    """Stored rows; ``instrument`` is in path form (``btc_eur``), so filters prune folders."""
    return spark.read.schema(schema.TRADES).parquet(f"{root}/{subject}")


def trades(spark: SparkSession, root: str) -> DataFrame:
    """All trades in the canonical shape."""
    return scan(spark, root).withColumn("instrument", symbols.from_path(F.col("instrument")))


def checked(trades: DataFrame) -> DataFrame:
    """Trades in the canonical schema; a null in a required column fails the job."""
    whole = trades.to(schema.TRADES)
    for name in schema.REQUIRED:
        column, _, part = name.partition(".")
        value = F.col(column)
        missing = value[part].isNull() if part else value.isNull()
        error = F.raise_error(F.lit(f"{name} must not be null"))
        kind = schema.TRADES[column].dataType
        whole = whole.withColumn(column, F.when(missing, error.cast(kind)).otherwise(value))
    return whole


def write(
    trades: DataFrame, root: str, subject: str = "trades", mode: str = "overwrite",
    files: int | None = None,
) -> None:
    """Write trades as ZSTD files, time-sorted inside each file.

    ``overwrite`` replaces the partitions that occur in ``trades`` and leaves the others;
    ``append`` adds files.

    Rows are range-partitioned by partition and time: a market with most of the rows is cut
    to many files, small markets share a task, and each file covers a narrow time range.
    """
    keys = [*schema.PARTITION_COLUMNS, *schema.TIME_ORDER]
    stored = checked(trades).withColumn("instrument", symbols.to_path(F.col("instrument")))
    ranged = (
        stored.repartitionByRange(files, *keys) if files else stored.repartitionByRange(*keys)
    )
    (
        ranged.sortWithinPartitions(*keys)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", ROW_GROUP_ROWS * 10)
        .partitionBy(*schema.PARTITION_COLUMNS)
        .parquet(f"{root}/{subject}")
    )


def scan_positional(
    spark: SparkSession,
    root: str,
    fields: T.StructType,
    subject: str = "trades",
    sources: Sequence[str] = ("*",),
    exchanges: Sequence[str] = ("*",),
    instruments: Sequence[str] = ("*",),
    years: Sequence[int | str] = ("*",),
) -> DataFrame:
    """Read ``subject/source/exchange/instrument/year`` folders, whose names are bare values.

    The given values go into the path pattern, so other folders are not listed. The values
    come back as columns, with the instrument in its ``/`` form.
    """

    def choice(values: Sequence[int | str]) -> str:
        names = [str(v).replace("/", "_") for v in values]
        return names[0] if len(names) == 1 else "{" + ",".join(names) + "}"

    pattern = "/".join(choice(v) for v in (sources, exchanges, instruments, years))
    part = r"/([^/]+)/([^/]+)/([^/]+)/(\d{4})/[^/]+\z"
    path = F.col("_metadata.file_path")
    return (
        spark.read.schema(fields)
        .option("recursiveFileLookup", "true")
        .parquet(f"{root}/{subject}/{pattern}")
        .select(
            "*",
            F.regexp_extract(path, part, 4).cast("int").alias("year"),
            F.regexp_extract(path, part, 2).alias("exchange"),
            symbols.from_path(F.regexp_extract(path, part, 3)).alias("instrument"),
            F.regexp_extract(path, part, 1).alias("source"),
        )
    )


def load_file(
    spark: SparkSession, root: str, fields: T.StructType, file_id: str
) -> DataFrame:
    """The rows of one file of the positional layout, by its id."""
    named = files.parse_file_ids(spark.range(1).select(F.lit(file_id).alias("file_id")))
    parts = [F.col(c) for c in ("subject", "source", "exchange", "instrument", "time")]
    found = named.select(files.positional_path(*parts).alias("path")).first()
    if found is None:
        raise ValueError(f"invalid file id: {file_id!r}")
    return spark.read.schema(fields).parquet(f"{root}/{found['path']}")

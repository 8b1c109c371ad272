"""A lake in versions: folders are written once, and a version lists the folders that count.

``trades/write_id=/year=/exchange=/instrument=/source=/bucket=`` holds the rows; a bucket is a
year, month or day. ``_versions/<id>`` is a version's catalog: one row for each folder with its
bucket, range and rows. ``_manifest`` names the versions in order, with the last write-ahead batch
that each has taken in. A reader sees one version whole, whatever is written meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema
from tickloom.functions import symbols
from tickloom.operators.compaction import bucket_of
from tickloom.sources import lake
from tickloom.streaming import ingest

FOLDER = ["write_id", *schema.PARTITION_COLUMNS, "bucket"]
UNIT = ["exchange", "instrument", "source", "unit"]
POINTER = "version string, wal_batch bigint, published timestamp"
CATALOG = T.StructType(
    [
        *[T.StructField(c, T.IntegerType() if c == "year" else T.StringType()) for c in FOLDER],
        T.StructField("unit", T.StringType()),
        T.StructField("start_ns", T.LongType()),
        T.StructField("end_ns", T.LongType()),
        T.StructField("rows", T.LongType()),
    ]
)


def current(spark: SparkSession, root: str) -> tuple[str, int] | None:
    """The newest version and the last write-ahead batch in it; None if nothing is published."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    newest = spark.read.schema(POINTER).json(f"{root}/_manifest")
    row = newest.agg(F.max_by(F.struct("version", "wal_batch"), "published").alias("last")).first()
    return (row["last"]["version"], row["last"]["wal_batch"]) if row["last"] else None


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """The current version's folders: their place, ``unit`` (the bucket they stand for), the
    half-open range ``start_ns, end_ns`` and ``rows``; ``instrument`` in its ``/`` form."""
    found = current(spark, root)
    if found is None:
        return spark.createDataFrame([], CATALOG)
    rows = spark.read.schema(CATALOG).parquet(f"{root}/_versions/{found[0]}")
    return rows.withColumn("instrument", symbols.from_path(F.col("instrument")))


def scan(spark: SparkSession, root: str, subject: str = "trades") -> DataFrame:
    """Rows of the current version, ``instrument`` in path form.

    Filters on the folder columns prune, and the join with the version's list, whose size Spark
    knows, prunes at run time.
    """
    found = current(spark, root)
    if found is None:
        return spark.createDataFrame([], schema.TRADES)
    fields = T.StructType(
        [*schema.TRADES.fields, T.StructField("write_id", T.StringType()), T.StructField("bucket", T.StringType())]
    )
    listed = spark.read.schema(CATALOG).parquet(f"{root}/_versions/{found[0]}").select(*FOLDER)
    rows = spark.read.schema(fields).parquet(f"{root}/{subject}")
    return rows.join(listed, FOLDER, "left_semi").select(*schema.TRADE_COLUMNS)


def _write(rows: DataFrame, root: str, now: Column) -> DataFrame:
    """Write rows, which are partitioned by range, to folders of their own; returns the catalog of these."""
    # In the order of the folders, so that the writer need not sort again.
    spark, write_id = rows.sparkSession, uuid.uuid4().hex
    keys = [*schema.PARTITION_COLUMNS, "bucket", *schema.TIME_ORDER]
    (
        lake.checked(rows)
        .withColumn("instrument", symbols.to_path(F.col("instrument")))
        .withColumn("bucket", bucket_of(F.col("time"), now))
        .sortWithinPartitions(*keys)
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .partitionBy(*schema.PARTITION_COLUMNS, "bucket")
        .parquet(f"{root}/trades/write_id={write_id}")
    )
    fields = T.StructType([*schema.TRADES.fields, T.StructField("bucket", T.StringType())])
    written = spark.read.schema(fields).parquet(f"{root}/trades/write_id={write_id}")
    return (
        written.groupBy(*FOLDER[1:])
        .agg(
            F.min("time_ns").alias("start_ns"),
            (F.max("time_ns") + 1).alias("end_ns"),
            F.count(F.lit(1)).alias("rows"),
        )
        .select(
            F.lit(write_id).alias("write_id"), *FOLDER[1:], F.col("bucket").alias("unit"),
            "start_ns", "end_ns", "rows",
        )
    )


def compact(spark: SparkSession, root: str, now: Column) -> str:
    """Take the new write-ahead batches into the lake and publish the next version; its id.

    A unit (a market's and source's year, month or day, seen from ``now``) is written anew only if
    new rows fall into it or it lies in several folders. The folders of all others are listed
    again as they are; one that has become a month's or year's only folder just changes its unit.
    Rows that occur twice (same market, source, time and ``seq``) are taken once, so a batch that
    was half taken in by a failed run does no harm. Old folders stay until :func:`retire`.
    """
    found = current(spark, root)
    done = found[1] if found else -1
    start = F.timestamp_micros(F.expr("start_ns div 1000"))
    listed = catalog(spark, root).withColumn("unit", bucket_of(start, now))
    fresh = ingest.read_write_ahead(spark, root).where(F.col("batch_id") > done)
    last = fresh.agg(F.max("batch_id")).first()[0]
    units = [*UNIT[:3], bucket_of(F.col("time"), now).alias("unit")]
    touched = fresh.select(*units).unionByName(
        listed.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*UNIT)
    ).distinct()
    old = listed.join(touched, UNIT, "left_semi").withColumn("instrument", symbols.to_path(F.col("instrument")))
    fields = T.StructType(
        [*schema.TRADES.fields, T.StructField("write_id", T.StringType()), T.StructField("bucket", T.StringType())]
    )
    rows = fresh.select(*schema.TRADE_COLUMNS)
    if found:
        again = spark.read.schema(fields).parquet(f"{root}/trades").join(old.select(*FOLDER), FOLDER, "left_semi")
        again = again.withColumn("instrument", symbols.from_path(F.col("instrument")))
        rows = rows.unionByName(again.select(*schema.TRADE_COLUMNS))
    # Rows that occur twice meet in the ranges that are written: one shuffle, sampled before it.
    once = ["exchange", "instrument", "source", *schema.TIME_ORDER]
    rows = rows.repartitionByRange(*once).dropDuplicates(once)
    stored = listed.withColumn("instrument", symbols.to_path(F.col("instrument")))
    kept = stored.join(old.select(*FOLDER), FOLDER, "left_anti").select(*CATALOG.fieldNames())
    version = uuid.uuid4().hex
    folders = kept.unionByName(_write(rows, root, now).select(*CATALOG.fieldNames()))
    folders.write.parquet(f"{root}/_versions/{version}")
    pointer = spark.range(1).select(
        F.lit(version).alias("version"),
        F.lit(done if last is None else last).cast("bigint").alias("wal_batch"),
        F.current_timestamp().alias("published"),
    )
    pointer.coalesce(1).write.mode("append").json(f"{root}/_manifest")
    return version


def retired(spark: SparkSession, root: str) -> DataFrame:
    """Folders on disk that the current version does not list, as paths below ``root``."""
    from tickloom.sources.catalog import list_files

    def part(name: str) -> Column:
        return F.regexp_extract("path", rf"/{name}=([^/]+)/", 1)

    names = [part(c).cast("int" if c == "year" else "string").alias(c) for c in FOLDER]
    on_disk = list_files(spark, root, "trades").select(*names).distinct()
    listed = catalog(spark, root).withColumn("instrument", symbols.to_path(F.col("instrument")))
    gone = on_disk.join(listed, FOLDER, "left_anti")
    place = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in FOLDER]
    return gone.select(F.concat_ws("/", F.lit("trades"), *place).alias("folder"))


def retire(spark: SparkSession, root: str) -> int:
    """Delete the retired folders, once no reader uses an older version; returns how many.

    The names come to the driver one by one, as deleting goes."""
    deleted = 0
    for row in retired(spark, root).toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{row['folder']}")
        deleted += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return deleted

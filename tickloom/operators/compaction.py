"""Planning and running the compaction of lake files.

A catalog row is one file: ``market, file_id`` and its half-open range ``s, e``. ``now`` is
always an argument. Files in a catalog are ordered by start, longest first, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema, session
from tickloom.functions import symbols
from tickloom.plans import blocks

ORDER = ["_s", "_long", "_id"]
FRESH_SECONDS = 300
# Catalogs are cut to blocks of about a quarter.
BLOCK_US = 90 * 86_400 * 10**6


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _ordered(catalog: DataFrame, **options) -> DataFrame:
    rows = (
        catalog.withColumn("_s", _micros("s"))
        .withColumn("_e", _micros("e"))
        .withColumn("_long", F.col("_s") - F.col("_e"))
        .withColumn("_id", F.col("file_id"))
    )
    return blocks.cut_blocks(rows, ["market"], ORDER, BLOCK_US, **options)


def shadowed_files(catalog: DataFrame, **options) -> DataFrame:
    """Add ``keep`` and ``shadow`` (the last kept file at or before it) to each file.

    A file is kept if it ends after every file before it. ``clip_start`` is where a kept
    file's new part begins, so that clipped files neither lose nor double a row.
    """
    cut = blocks.running_max_before(
        _ordered(catalog, **options), ["market"], ORDER, {"_covered": "_e"}
    )
    keep = F.col("_covered").isNull() | (F.col("_e") > F.col("_covered"))
    kept = (
        cut.withColumn("keep", keep)
        .withColumn("clip_start", F.greatest("_s", "_covered"))
        .withColumn("_kept", F.when(keep, F.struct("file_id", "s", "e")))
    )
    named = blocks.known_around(kept, ["market"], ORDER, last={"shadow": "_kept"})
    return named.select(
        *catalog.columns,
        "keep",
        F.when(F.col("keep"), F.timestamp_micros("clip_start")).alias("clip_start"),
        F.when(~F.col("keep"), F.col("shadow")).alias("shadow"),
    )


def removable_files(
    catalog: DataFrame, now: Column, fresh_seconds: int = FRESH_SECONDS, **options
) -> DataFrame:
    """Shadowed files that may go, with ``reason``: ``remove``, ``outside`` or ``fresh``.

    The catalog also has ``modified``. A file goes if its shadow covers it and is older
    than ``fresh_seconds``.
    """
    marked = shadowed_files(catalog, **options)
    shadows = catalog.select(
        "market", F.col("file_id").alias("shadow_id"), F.col("modified").alias("shadow_modified")
    )
    gone = (
        marked.where(~F.col("keep"))
        .withColumn("shadow_id", F.col("shadow.file_id"))
        .join(shadows, ["market", "shadow_id"])
    )
    age = F.unix_micros(now.cast("timestamp")) - _micros("shadow_modified")
    outside = (F.col("s") < F.col("shadow.s")) | (F.col("e") > F.col("shadow.e"))
    reason = (
        F.when(age <= fresh_seconds * 1_000_000, "fresh").when(outside, "outside").otherwise("remove")
    )
    return gone.select("market", "file_id", "shadow_id", reason.alias("reason"))


def tier_buckets(catalog: DataFrame, now: Column) -> DataFrame:
    """Add ``bucket``: the year, month or day a file belongs to, seen from ``now``.

    ``done`` tells that the file already is that unit: its range is the whole year or month,
    or a finished day under a day's name (``tier`` is 'day').
    """
    start = F.col("s").cast("timestamp")
    end = F.col("e").cast("timestamp")
    at = now.cast("timestamp")
    unit = (
        F.when(start < F.date_trunc("year", at), "year")
        .when(start < F.date_trunc("month", at), "month")
        .otherwise("day")
    )

    def whole(name: str, step: str) -> Column:
        return (F.date_trunc(name, start) == start) & (end == start + F.expr(step))

    tier = F.col("tier") if "tier" in catalog.columns else F.lit("file")
    done = (
        F.when(unit == "year", whole("year", "interval 1 year"))
        .when(unit == "month", whole("month", "interval 1 month"))
        .otherwise(
            (start < F.date_trunc("day", at)) & whole("day", "interval 1 day") & (tier == "day")
        )
    )
    return catalog.select(
        "*", unit.alias("unit"), _bucket_name(unit, start).alias("bucket"), done.alias("done")
    )


def bucket_of(time: Column, now: Column) -> Column:
    """The year, month or day that a time belongs to, seen from ``now``."""
    at = now.cast("timestamp")
    unit = (
        F.when(time < F.date_trunc("year", at), "year")
        .when(time < F.date_trunc("month", at), "month")
        .otherwise("day")
    )
    return _bucket_name(unit, time)


def _bucket_name(unit: Column, start: Column) -> Column:
    return (
        F.when(unit == "year", F.date_format(start, "yyyy"))
        .when(unit == "month", F.date_format(start, "yyyy-MM"))
        .otherwise(F.date_format(start, "yyyy-MM-dd"))
    )


def date_range(catalog: DataFrame, keys: list[str]) -> DataFrame:
    return catalog.groupBy(*keys).agg(
        F.min(F.to_date("s")).alias("first_date"), F.max(F.to_date("s")).alias("last_date")
    )


def tier_by_newest(catalog: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets relative to each key's newest date; that day stays out."""
    newest = date_range(catalog, keys).select(*keys, F.col("last_date").alias("newest"))
    day, last = F.to_date("s"), F.col("newest")
    unit = (
        F.when(F.year(day) < F.year(last), "year")
        .when(F.trunc(day, "month") < F.trunc(last, "month"), "month")
        .otherwise("day")
    )
    return (
        catalog.join(newest, keys)
        .where(day < last)
        .withColumn("bucket", _bucket_name(unit, F.col("s").cast("timestamp")))
        .drop("newest")
    )


def compaction_plan(catalog: DataFrame, now: Column, **options) -> DataFrame:
    """Kept files per bucket and what to do: ``none``, ``rename`` (one file) or ``merge``.

    A bucket's new file starts with the bucket and ends with its last input.
    """
    kept = shadowed_files(catalog, **options).where("keep").drop("shadow")
    todo = tier_buckets(kept, now).where(~F.col("done"))
    return (
        todo.groupBy("market", "bucket", "unit")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.min(F.col("s")).alias("first_start"),
            F.max(F.col("e")).alias("end"),
            F.min_by("file_id", F.struct("s", "file_id")).alias("first_file"),
        )
        .withColumn("action", F.when(F.col("files") == 1, "rename").otherwise("merge"))
    )


def merge_rows(rows: DataFrame, catalog: DataFrame, **options) -> DataFrame:
    """The rows that survive compaction: each kept file, clipped to its new part.

    A file must hold all rows of its range, as downloads do; late rows need a file of their own
    range. Write-ahead and data files merge the same way, as one catalog and one row set.
    ``rows``: canonical rows with ``market`` and the ``file_id`` they were read from. The
    catalog is joined by file, so its size does not matter.
    """
    kept = shadowed_files(catalog, **options).where("keep")
    clip = kept.select(
        "market",
        "file_id",
        F.unix_micros("clip_start").alias("_from"),
        _micros("e").alias("_to"),
    )
    at = F.unix_micros("time")
    return (
        rows.join(clip, ["market", "file_id"])
        .where((at >= F.col("_from")) & (at < F.col("_to")))
        .drop("_from", "_to")
    )


# -- running it ------------------------------------------------------------------------


def compact(
    spark: SparkSession, rows: DataFrame, catalog: DataFrame, now: Column, root: str, **options
) -> str:
    """Write the merged lake as a new version below ``root`` and return its folder.

    Inputs stay untouched. Rows are range-partitioned by bucket, market and time, so a large
    bucket becomes several files. Publish the version once its counts are checked.
    """
    survived = merge_rows(rows, catalog, **options)
    bucket = tier_buckets(survived.withColumn("s", F.col("time")).withColumn("e", F.col("time")), now)
    stored = bucket.select(
        *[c for c in schema.TRADE_COLUMNS if c != "instrument"],
        symbols.to_path(F.col("instrument")).alias("instrument"),
        "bucket",
    )
    keys = ["exchange", "instrument", "source", "bucket", *schema.TIME_ORDER]
    folder = f"{root}/version-{session.new_folder(spark, 'v').rsplit('-', 1)[1]}"
    (
        stored.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .partitionBy("year", "exchange", "instrument", "source", "bucket")
        .parquet(f"{folder}/trades")
    )
    return folder


def version_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts and price totals per market of two row sets, with ``equal``."""

    def summary(rows: DataFrame, suffix: str) -> DataFrame:
        return rows.groupBy(*schema.MARKET).agg(
            F.count(F.lit(1)).alias(f"n_{suffix}"),
            F.sum(F.col("price.int").cast("decimal(38,0)")).alias(f"units_{suffix}"),
        )

    joined = summary(before, "before").join(summary(after, "after"), schema.MARKET, "full")
    equal = F.col("n_before").eqNullSafe(F.col("n_after")) & F.col("units_before").eqNullSafe(
        F.col("units_after")
    )
    return joined.withColumn("equal", equal)


def publish(spark: SparkSession, root: str, folder: str) -> None:
    """Make ``folder`` the lake's current version: one appended manifest row."""
    spark.range(1).select(
        F.lit(folder).alias("folder"), F.current_timestamp().alias("published")
    ).coalesce(1).write.mode("append").json(f"{root}/_manifest")


def current_version(spark: SparkSession, root: str) -> str | None:
    manifest = spark.read.schema("folder string, published timestamp").json(f"{root}/_manifest")
    newest = manifest.agg(F.max_by("folder", "published").alias("folder")).first()
    return newest["folder"]

"""Bars kept beside a lake in versions, and refreshed where its trades changed.

``bars/every=/write_id=/exchange=/instrument=/unit=`` holds the subjects ``ohlc:1m``, ``ohlc:1h`` and
``ohlc:1d``; a unit is the year, month or day that the lake's current version keeps a market in.
``_bars/<id>`` lists the folders that count, each with the trade folders that its bars were made of,
and ``_bar_manifest`` names the lists in order. A unit whose trade folders are the same as before
keeps its files; of the others the finest bars are made from their trades, and coarser ones are
merged from finer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema
from tickloom.functions import symbols
from tickloom.operators import bars
from tickloom.plans.settle import settle
from tickloom.sources import versions

#: Kept subjects, each merged from the one before. Fixed values.
SUBJECTS = {"ohlc:1m": "1m", "ohlc:1h": "1h", "ohlc:1d": "1d"}

PLACE = ["exchange", "instrument", "unit"]
FOLDER = ["every", "write_id", *PLACE]
KEYS = [*schema.MARKET, "bar", "price_scale", "amount_scale"]
POINTER = "list string, version string, published timestamp"
LIST = T.StructType(
    [*[T.StructField(c, T.StringType()) for c in FOLDER], T.StructField("made_of", T.ArrayType(T.StringType()))]
)
VALUES = ["open", "high", "low", "close", "volume", "trades"]


def _newest(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_bar_manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(POINTER).json(f"{root}/_bar_manifest")
    return rows.agg(F.max_by(F.struct("list", "version"), "published").alias("last")).first()["last"]


def listed(spark: SparkSession, root: str) -> DataFrame:
    """The folders of the newest list, ``instrument`` in path form."""
    last = _newest(spark, root)
    if last is None:
        return spark.createDataFrame([], LIST)
    return spark.read.schema(LIST).parquet(f"{root}/_bars/{last['list']}")


def merged(finer: DataFrame, every: str) -> DataFrame:
    """Bars of finer bars, which hold ``unit`` besides; equal to bars of their trades."""
    start = F.window("bar", bars.WIDTHS[every])
    whole = finer.groupBy(*schema.MARKET, "unit", start.alias("_bar"), "price_scale", "amount_scale").agg(
        F.min_by("open", "bar").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bar").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trades").alias("trades"),
    )
    return whole.withColumn("bar", F.col("_bar.start")).drop("_bar")


def _trades(spark: SparkSession, root: str, folders: DataFrame) -> DataFrame:
    """The trades of listed folders, with the unit that each folder stands for."""
    fields = T.StructType(
        [*schema.TRADES.fields, T.StructField("write_id", T.StringType()), T.StructField("bucket", T.StringType())]
    )
    rows = spark.read.schema(fields).parquet(f"{root}/trades")
    return rows.join(folders.select(*versions.FOLDER, "unit"), versions.FOLDER)


def _write(rows: DataFrame, root: str, every: str, write_id: str) -> DataFrame:
    """Write bars to folders of their own, and read them back."""
    folder = f"{root}/bars/every={every}/write_id={write_id}"
    keys = [*PLACE, "bar"]
    fields = rows.select(*KEYS, *VALUES, "unit").schema
    (
        rows.select(*fields.names)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .partitionBy(*PLACE)
        .parquet(folder)
    )
    return rows.sparkSession.read.schema(fields).parquet(folder)


def refresh(spark: SparkSession, root: str) -> str | None:
    """Bring the kept bars up to the lake's current version; the new list's id, None without a version.

    What is read are the trade folders of units that differ, and the size of the job is theirs. A
    unit that is gone, since its days became a month, leaves the list with its bars. Nothing that an
    older list names is touched, so readers of it go on, and a run that failed leaves only folders
    that no list names.
    """
    version = versions.current(spark, root)
    if version is None:
        return None
    catalog = versions.catalog(spark, root).withColumn("instrument", symbols.to_path(F.col("instrument")))
    folder = F.concat_ws("/", "write_id", F.col("year").cast("string"), "source", "bucket")
    now = catalog.groupBy(*PLACE).agg(F.array_sort(F.collect_set(folder)).alias("made_of"))
    before = listed(spark, root)
    same = before.where(F.col("every") == "1m").join(now, [*PLACE, "made_of"], "left_semi")
    same = settle(same.select(*PLACE, "made_of"), "same-units")
    changed = settle(now.join(same, [*PLACE, "made_of"], "left_anti"), "changed-units")
    write_id, folders = uuid.uuid4().hex, []
    rows = _trades(spark, root, catalog.join(changed, PLACE, "left_semi"))
    found = bars.ohlc(rows, "1m", more=["unit"])
    for every in SUBJECTS.values():
        if every != "1m":
            found = merged(found, every)
        found = _write(found, root, every, write_id)
        written = found.select(*PLACE).distinct().join(changed, PLACE)
        folders.append(written.select(F.lit(every).alias("every"), F.lit(write_id).alias("write_id"), *PLACE, "made_of"))
    kept = before.join(same, [*PLACE, "made_of"], "left_semi").select(*LIST.fieldNames())
    for part in folders:
        kept = kept.unionByName(part)
    name = uuid.uuid4().hex
    kept.write.parquet(f"{root}/_bars/{name}")
    pointer = spark.range(1).select(
        F.lit(name).alias("list"), F.lit(version[0]).alias("version"), F.current_timestamp().alias("published")
    )
    pointer.coalesce(1).write.mode("append").json(f"{root}/_bar_manifest")
    return name


def read(spark: SparkSession, root: str, subject: str) -> DataFrame:
    """The kept bars of a subject, in the shape of :func:`bars.ohlc`.

    Filters on ``exchange`` prune folders; so does the join with the list, at run time.
    """
    if subject not in SUBJECTS:
        raise ValueError(f"subject must be one of {[*SUBJECTS]}: {subject!r}")
    every = SUBJECTS[subject]
    shape = spark.createDataFrame([], schema.TRADES)
    empty = bars.ohlc(shape, every).select(*KEYS, *VALUES)
    if _newest(spark, root) is None:
        return empty
    fields = T.StructType(
        [*empty.schema.fields, *[T.StructField(c, T.StringType()) for c in ("write_id", "unit")]]
    )
    rows = spark.read.schema(fields).parquet(f"{root}/bars/every={every}")
    places = listed(spark, root).where(F.col("every") == every).select("write_id", *PLACE)
    found = rows.join(places, ["write_id", *PLACE], "left_semi")
    return found.withColumn("instrument", symbols.from_path(F.col("instrument"))).select(*KEYS, *VALUES)

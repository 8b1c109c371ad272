"""Landing folder to lake: resumable, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom import schema
from tickloom.functions import timefmt
from tickloom.plans.settle import settle
from tickloom.sources import raw

CHUNK_KEYS = ["source", *schema.MARKET]


def high_watermark(catalog: DataFrame) -> DataFrame:
    """The end of each market's newest file."""
    return catalog.groupBy(*schema.MARKET).agg(F.max("end_ns").alias("since_ns"))


def after_watermark(landed: DataFrame, watermark: DataFrame) -> DataFrame:
    """Landed rows at or after their market's watermark; markets without one are all new."""
    return (
        landed.join(settle(watermark, "watermark"), schema.MARKET, "left")
        .where(F.col("time_ns") >= F.coalesce("since_ns", F.col("time_ns")))
        .drop("since_ns")
    )


def landed_stream(
    spark: SparkSession,
    path: str,
    fields: T.StructType = schema.RAW_TRADES,
    form: str = "json",
    files_per_batch: int = 1_000,
) -> DataFrame:
    """New files of a landing folder as a stream; its checkpoint remembers what was read."""
    return (
        spark.readStream.schema(fields)
        .format(form)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def append_batch(trades: DataFrame, batch_id: int, root: str) -> None:
    """Write one batch to the write-ahead area, one folder per UTC day.

    Inside a folder each market's rows lie together in time order, cut to files by range: few
    files however many markets there are, and several for a busy one. The batch's folders are
    overwritten, so a batch that failed midway is written anew as a whole.
    """
    keys = ["day", *CHUNK_KEYS, *schema.TIME_ORDER]
    (
        trades.withColumn("batch_id", F.lit(int(batch_id)).cast("bigint"))
        .withColumn("day", timefmt.day_of(F.col("time_ns")))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("batch_id", "day")
        .parquet(f"{root}/wal")
    )


def read_write_ahead(spark: SparkSession, root: str) -> DataFrame:
    fields = T.StructType(
        [
            *schema.TRADES.fields,
            T.StructField("batch_id", T.LongType()),
            T.StructField("day", T.DateType()),
        ]
    )
    return spark.read.schema(fields).parquet(f"{root}/wal")


def ingest(
    raw_stream: DataFrame,
    root: str,
    checkpoint: str,
    until_now: bool = True,
    every: str = "10 seconds",
) -> StreamingQuery:
    """Normalize a stream of raw trades and append it to the write-ahead area.

    ``until_now`` stops once all landed files are read; the next run goes on behind them.
    Rows that lack a time, a number or a name go to ``rejects`` as they landed, with the reason.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Read once for both outputs; lost blocks are computed again from the files.
        batch = batch.persist()
        try:
            append_batch(raw.accepted(raw.normalize(batch)), batch_id, root)
            raw.rejects(batch).write.mode("overwrite").parquet(f"{root}/rejects/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = raw_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if until_now else writer.trigger(processingTime=every)
    return writer.start()

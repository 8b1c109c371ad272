"""Bars over a stream of trades, with late trades set aside.

Every micro-batch adds its partial bars below ``partials``, the trades whose bar was closed
before below ``late``, and its newest time below ``times``; folders are named by the batch, so a
repeated one replaces itself. The stream keeps no state: partial bars are merged when read, and
closed bars, open bars and late trades together hold every trade.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators import bars
from tickloom.schema import MARKET, TIME_ORDER, TRADE_COLUMNS

BAR = [*MARKET, "bar", "bar_end", "price_scale", "amount_scale"]


def _watermark(spark: SparkSession, root: str, late: str, before: int | None = None) -> Column:
    """The newest time (of batches ``before`` one) less the allowed lateness, as a literal."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/times")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return F.lit(None).cast("timestamp")
    times = spark.read.schema("newest timestamp, batch_id bigint").parquet(f"{root}/times")
    if before is not None:
        times = times.where(F.col("batch_id") < before)
    closed = times.agg(F.unix_micros(F.max("newest") - F.expr(f"INTERVAL {late}"))).first()[0]
    return F.timestamp_micros(F.lit(closed).cast("bigint"))


def add_batch(trades: DataFrame, batch_id: int, root: str, every: str, late: str) -> None:
    """Add one batch of canonical trades."""
    window = F.window("time", bars.WIDTHS[every])
    rows = trades.withColumn("_bar", window).select(
        *TRADE_COLUMNS,
        F.col("_bar.start").alias("bar"),
        F.col("_bar.end").alias("bar_end"),
        F.col("price.scale").alias("price_scale"),
        F.col("amount.scale").alias("amount_scale"),
    )
    passed = F.coalesce(
        F.col("bar_end") <= _watermark(trades.sparkSession, root, late, batch_id), F.lit(False)
    )
    order = F.struct(*TIME_ORDER)
    partial = rows.where(~passed).groupBy(*BAR).agg(
        *bars.bar_aggregates(), F.min(order).alias("first"), F.max(order).alias("last")
    )
    newest = rows.agg(F.max("time").alias("newest")).where("newest IS NOT NULL")
    outputs = {"late": rows.where(passed), "partials": partial, "times": newest}
    for name, output in outputs.items():
        output.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def ingest_bars(
    trades: DataFrame, root: str, checkpoint: str, every: str, late: str = "10 minutes"
) -> StreamingQuery:
    """Add a stream's present input batch by batch."""
    if every not in bars.WIDTHS:
        raise ValueError(f"bar must be one of {[*bars.WIDTHS]}: {every!r}")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            add_batch(batch, batch_id, root, every, late)
        finally:
            batch.unpersist()

    return (
        trades.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_bars(spark: SparkSession, root: str, late: str = "10 minutes") -> DataFrame:
    """All bars so far; ``closed`` ones take no more trades."""
    parts = spark.read.parquet(f"{root}/partials")
    whole = parts.groupBy(*BAR).agg(
        F.min_by("open", "first").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trades").alias("trades"),
    )
    passed = F.col("bar_end") <= _watermark(spark, root, late)
    return whole.withColumn("closed", F.coalesce(passed, F.lit(False))).drop("bar_end")


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """The trades that came after their bar was closed, with ``bar`` and ``batch_id``."""
    return spark.read.parquet(f"{root}/late")

"""Cutting ingested batches to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import timefmt
from tickloom.plans import blocks
from tickloom.schema import MARKET

RUN_KEYS = ["subject", "source", *MARKET]
SEQ_WIDTH = 100_000


def partition_runs(records: DataFrame) -> DataFrame:
    """Chunks of consecutive rows with equal subject, source, market and UTC day.

    ``records``: ``batch_id, seq, time_ns`` and the run keys. A chunk is named by its first
    time. Batches are cut to blocks of ingest order, so a large batch is many tasks.
    """
    batch, order = ["batch_id"], ["seq"]
    rows = records.withColumn("day", timefmt.day_of(F.col("time_ns")))
    rows = rows.withColumn("_key", F.struct(*RUN_KEYS, "day"))
    cut = blocks.cut_blocks(rows, batch, order, SEQ_WIDTH, unique=True)
    seen = blocks.neighbors(cut, batch, order, back={"_before": "_key"})
    changed = seen.withColumn(
        "_new", (~F.col("_key").eqNullSafe(F.col("_before"))).cast("int")
    ).drop("_before")
    numbered = blocks.running_sum(changed, batch, order, {"run": "_new"})
    return numbered.groupBy("batch_id", "run", *RUN_KEYS, "day").agg(
        F.min_by("time_ns", "seq").alias("first_time_ns"),
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("rows"),
    )


def split_per_day(
    trades: DataFrame, keys: list[str], start_ns: Column | None = None, end_ns: Column | None = None
) -> DataFrame:
    """Rows per key and UTC day, with the day's ``[start, end)`` clipped to the batch period."""
    day = timefmt.day_of(F.col("time_ns"))
    lo = F.unix_micros(F.col("day").cast("timestamp")) * 1000
    hi = F.unix_micros(F.date_add("day", 1).cast("timestamp")) * 1000
    days = trades.groupBy(*keys, day.alias("day")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("time_ns").alias("first_ns"),
        F.max("time_ns").alias("last_ns"),
    )
    return days.withColumn("start_ns", lo if start_ns is None else F.greatest(lo, start_ns)).withColumn(
        "end_ns", hi if end_ns is None else F.least(hi, end_ns)
    )

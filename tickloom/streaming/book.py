"""Order books over a stream of level rows.

A book is kept as a table, written anew by each micro-batch: the levels set or removed since
their market's last snapshot. A snapshot drops what came before it, so the table holds the live
levels and the removals since the last snapshot, however long the stream runs. The two newest
tables stay, so a repeated batch starts from the same one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.plans.settle import dimension

LEVEL = ["market_id", "side", "price"]


def market_state(messages: DataFrame) -> DataFrame:
    """Last snapshot per market, and how many numbers its sequence misses so far."""
    return messages.groupBy("market_id").agg(
        F.max(F.when(F.col("kind") == "snapshot", F.col("seq"))).alias("snapshot_seq"),
        F.max("seq").alias("last_seq"),
        (F.max("seq") - F.min("seq") + 1 - F.count(F.lit(1))).alias("missing"),
    )


def keep_changes(state: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that changed in each micro-batch below ``path/batch_id=``.

    A batch is written whole, so a repeated one replaces itself.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        state.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, root: str) -> list[int]:
    """The batches whose tables are whole, in order; two at most are kept."""
    path, fs = _path(spark, f"{root}/done")
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit())


def add_batch(levels: DataFrame, snapshots: DataFrame, batch_id: int, root: str) -> None:
    """Add one batch of level rows and of ``market_id, seq`` of snapshots, in any order."""
    spark = levels.sparkSession
    before = [b for b in _batches(spark, root) if b < batch_id]
    levels, snapshots = levels.select(*LEVEL, "amount", "seq"), snapshots.select("market_id", "seq")
    if before:
        levels = levels.unionByName(spark.read.schema(levels.schema).parquet(f"{root}/levels/{before[-1]}"))
        old = spark.read.schema(snapshots.schema).parquet(f"{root}/snapshots/{before[-1]}")
        snapshots = snapshots.unionByName(old)
    last = snapshots.groupBy("market_id").agg(F.max("seq").alias("seq"))
    last.write.mode("overwrite").parquet(f"{root}/snapshots/{batch_id}")
    starts = dimension(last.withColumnRenamed("seq", "snapshot_seq"), "snapshots")
    newest = levels.groupBy(*LEVEL).agg(F.max_by("amount", "seq").alias("amount"), F.max("seq").alias("seq"))
    alive = newest.join(starts, "market_id", "left").where(
        F.col("snapshot_seq").isNull() | (F.col("seq") >= F.col("snapshot_seq"))
    )
    alive.drop("snapshot_seq").write.mode("overwrite").parquet(f"{root}/levels/{batch_id}")
    path, fs = _path(spark, f"{root}/done/{batch_id}")
    fs.mkdirs(path)
    for old in before[:-1]:
        for name in ("done", "levels", "snapshots"):
            path, fs = _path(spark, f"{root}/{name}/{old}")
            fs.delete(path, True)


def ingest_book(
    messages: DataFrame,
    parts: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    root: str,
    checkpoint: str,
) -> StreamingQuery:
    """Add a stream's present messages batch by batch; ``parts`` gives a batch's level rows and
    snapshots."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            add_batch(*parts(batch), batch_id, root)
        finally:
            batch.unpersist()

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_book(spark: SparkSession, root: str) -> DataFrame:
    """The current book: ``market_id, side, price, amount`` of markets that had a snapshot. It is empty,
    with prices and amounts as of parsed messages, as long as no batch was added."""
    batches = _batches(spark, root)
    if not batches:
        return spark.createDataFrame([], "market_id bigint, side string, price decimal(38,18), amount decimal(38,18)")
    newest = batches[-1]
    markets = spark.read.parquet(f"{root}/snapshots/{newest}").select("market_id")
    levels = spark.read.parquet(f"{root}/levels/{newest}").where("amount > 0")
    return levels.join(markets, "market_id", "left_semi").select(*LEVEL, "amount")

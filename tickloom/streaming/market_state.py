"""Books and sequence gaps of a message stream, kept in Spark's state store.

A micro-batch costs its own messages: only the levels and intervals that they touch are read and
written, and a restarted query goes on from its checkpoint. Messages may come late, in any order
and more than once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Parts of a market's levels, so that a busy market is many tasks; fixed for a checkpoint's life.
SHARDS = 16

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(
    rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Run a stateful stream over what has landed. It holds its states in RocksDB, on the executors'
    disks and in the checkpoint; the session's own setting stays as it was."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return (
            rows.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def keep_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch whole below ``path``; a repeated one replaces itself."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


# -- books -----------------------------------------------------------------------------


class Book(StatefulProcessor):
    """The levels of one part of a market's book.

    A map state holds (side, price) -> (amount, seq) and a value state the last snapshot and the
    greatest number seen. Removed levels stay with amount 0 until the next snapshot, so that a late
    older message cannot bring them back. A snapshot that is newer than all that was seen clears the map
    in one call; only a late one has to look at each level.
    """

    def __init__(self, price: T.DataType, amount: T.DataType) -> None:
        self.price, self.amount = price, amount

    def init(self, handle: StatefulProcessorHandle) -> None:
        level = T.StructType([T.StructField("side", T.StringType()), T.StructField("price", self.price)])
        value = T.StructType([T.StructField("amount", self.amount), T.StructField("seq", T.LongType())])
        marks = T.StructType([T.StructField("snapshot_seq", T.LongType()), T.StructField("last_seq", T.LongType())])
        self.levels = handle.getMapState("levels", level, value)
        self.marks = handle.getValueState("marks", marks)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        snapshot, last = self.marks.get() or (None, -1)
        cleared = batch.loc[batch["side"].isna(), "seq"].max()
        if not np.isnan(cleared) and (snapshot is None or cleared > snapshot):
            snapshot = int(cleared)
            if last < snapshot:
                self.levels.clear()
            else:
                old = [level for level, (_, seq) in self.levels.iterator() if seq < snapshot]
                for level in old:
                    self.levels.removeKey(level)
        found = batch[batch["side"].notna()].sort_values("seq").drop_duplicates(["side", "price"], keep="last")
        if snapshot is not None:
            found = found[found["seq"] >= snapshot]
        changed = []
        for side, price, amount, seq in zip(*[found[c].tolist() for c in ("side", "price", "amount", "seq")], strict=True):
            known = self.levels.getValue((side, price))
            if known is None or known[1] <= seq:
                self.levels.updateValue((side, price), (amount, seq))
                changed.append((key[0], side, price, amount, seq))
        self.marks.update((snapshot, max(int(last), int(batch["seq"].max()))))
        yield pd.DataFrame(changed, columns=["market_id", "side", "price", "amount", "seq"], dtype=object)

    def close(self) -> None:
        pass


def book_changes(levels: DataFrame, snapshots: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The levels that each micro-batch changed: ``market_id, side, price, amount, seq``.

    ``levels`` and ``snapshots`` are streams of the shapes in ``operators/book.py``. A market's
    levels are dealt out by side and price, and a snapshot's number, not its levels, goes to every
    part, so that each can clear its own.
    """
    kinds = {f.name: f.dataType for f in levels.schema}
    shard = F.pmod(F.xxhash64("side", "price"), F.lit(shards)).cast("int")
    rows = levels.select("market_id", shard.alias("shard"), "side", "price", "amount", "seq")
    # No number is null, since pandas would turn its column to floats; a null side tells a snapshot.
    marks = snapshots.select(
        "market_id",
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.lit(None).cast("string").alias("side"),
        F.lit(0).cast(kinds["price"]).alias("price"),
        F.lit(0).cast(kinds["amount"]).alias("amount"),
        "seq",
    )
    rows = rows.unionByName(marks)
    names = ["market_id", "side", "price", "amount", "seq"]
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    return rows.groupBy("market_id", "shard").transformWithStateInPandas(
        statefulProcessor=Book(kinds["price"], kinds["amount"]),
        outputStructType=schema,
        outputMode="Update",
        timeMode="None",
    )


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def kept_book(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The book as the checkpoint's last finished batch left it: ``market_id, side, price, amount``
    of markets that had a snapshot. It is read from the state store itself."""
    levels = _state(spark, checkpoint, "levels").select("key.*", F.col("user_map_key.*"), F.col("user_map_value.*"))
    marks = _state(spark, checkpoint, "marks").select("key.*", "value.snapshot_seq")
    marks = marks.where("snapshot_seq IS NOT NULL")
    standing = levels.join(marks, ["market_id", "shard"]).where("amount > 0 AND seq >= snapshot_seq")
    return standing.select("market_id", "side", "price", "amount")


# -- sequence gaps ---------------------------------------------------------------------


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unbroken runs (market_id, first, last) of each Arrow batch's numbers."""
    for batch in batches:
        market, seq = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        order = np.lexsort((seq, market))
        market, seq = market[order], seq[order]
        new = np.ones(len(seq), bool)
        new[1:] = (market[1:] != market[:-1]) | (seq[1:] - seq[:-1] > 1)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(seq)) - 1
        columns = [market[starts], seq[starts], seq[ends]] if len(seq) else [market, seq, seq]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["market_id", "first", "last"])


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first, last) put in order, with those that touch or overlap made one."""
    found: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if found and first <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(last, found[-1][1]))
        else:
            found.append((first, last))
    return found


class Gaps(StatefulProcessor):
    """The numbers that a market has shown, as spans; a list state holds those around open gaps.

    A gap is certain when the market has come ``slack`` numbers past it. It is then sent once and its
    lower span is forgotten. A number that comes later still is sent as ``late``, unless the kept
    spans have it; below the lowest span it cannot be told from a repeated one.
    """

    def __init__(self, slack: int) -> None:
        self.slack = slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
        self.spans = handle.getListState("spans", span)
        self.floor = handle.getValueState("floor", T.StructType([T.StructField("seq", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        new = list(zip(batch["first"].tolist(), batch["last"].tolist(), strict=True))
        floor = self.floor.get()
        kept = [(int(a), int(b)) for a, b in self.spans.get()] if self.spans.exists() else []
        late: list[tuple[int, int]] = []
        if floor is not None:
            low = int(floor[0])
            late = joined([(a, min(b, low - 1)) for a, b in new if a < low])
            new = [(max(a, low), b) for a, b in new if b >= low]
        spans = joined(kept + new)
        sent = []
        while len(spans) > 1 and spans[-1][1] >= spans[1][0] + self.slack:
            sent.append(("gap", spans[0][1], spans[1][0]))
            spans.pop(0)
        if sent:
            self.floor.update((spans[0][0],))
        if spans:
            self.spans.put(spans)
        found = [(key[0], kind, a, b, b - a - 1) for kind, a, b in sent]
        found += [(key[0], "late", a, b, b - a + 1) for a, b in late]
        yield pd.DataFrame(found, columns=["market_id", "kind", "seq_before", "seq", "missing"])

    def close(self) -> None:
        pass


GAP = "market_id long, kind string, seq_before long, seq long, missing long"


def certain_gaps(messages: DataFrame, slack: int) -> DataFrame:
    """The gaps that have become certain in each micro-batch: ``market_id, kind, seq_before, seq, missing``.

    A row of kind ``gap`` is one of ``operators.book.seq_gaps``. A row of kind ``late`` says that the numbers
    from ``seq_before`` to ``seq`` (``missing`` of them) came below a gap that was sent before. Messages
    are reduced to unbroken runs where they are read, so a busy market sends few rows to its task.
    """
    seen = messages.where("market_id IS NOT NULL AND seq IS NOT NULL")
    seen = seen.select(F.col("market_id").cast("long"), F.col("seq").cast("long"))
    short = seen.mapInArrow(runs, "market_id long, first long, last long")
    return short.groupBy("market_id").transformWithStateInPandas(
        statefulProcessor=Gaps(slack), outputStructType=GAP, outputMode="Update", timeMode="None"
    )


def open_gaps(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The gaps that are not certain yet, as ``market_id, seq_before, seq, missing``."""
    spans = spark.read.format("statestore").option("stateVarName", "spans").load(checkpoint)
    each = spans.select("key.market_id", F.col("list_element.first").alias("first"), F.col("list_element.last").alias("last"))
    whole = each.groupBy("market_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("s"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("s") - 1),
        lambda k: F.struct(F.get("s", k - 1)["last"].alias("seq_before"), F.get("s", k)["first"].alias("seq")),
    )
    found = whole.where(F.size("s") > 1).select("market_id", F.explode(pairs).alias("p")).select("market_id", "p.*")
    return found.withColumn("missing", F.col("seq") - F.col("seq_before") - 1)

"""Order books and message statistics.

Message rows: ``market_id, seq, kind, time_us, ...``. Level rows: ``market_id, seq, side,
price, amount``, where ``amount`` 0 removes the level; ``snapshot`` marks rows of a message
that replaces the book.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans import blocks
from tickloom.plans.settle import dimension

# Sequence numbers rise by one per message, so blocks of this width have equal sizes.
SEQ_WIDTH = 100_000


# -- lookups ---------------------------------------------------------------------------


def market_lookup(
    messages: DataFrame, exchanges: DataFrame, instruments: DataFrame, markets: DataFrame
) -> DataFrame:
    """Add ``exchange``, ``instrument`` and ``market`` symbols by id; unknown ids stay, with null
    symbols.

    The ids are few and some hold most messages, so the dimensions go to the messages, as long as
    their counted size allows.
    """
    for name, rows in (("exchange", exchanges), ("instrument", instruments), ("market", markets)):
        messages = messages.join(dimension(rows, f"{name}s"), f"{name}_id", "left")
    return messages


# -- statistics ------------------------------------------------------------------------


def kind_counts(messages: DataFrame) -> DataFrame:
    """Messages per kind, and their share of all messages in percent."""
    counts = messages.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    # The window sees one row per kind.
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / total)


def exchange_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("exchange_id").agg(F.count(F.lit(1)).alias("n"))


def market_stats(messages: DataFrame) -> DataFrame:
    """Messages, and distinct exchanges, instruments and markets, exactly.

    Each market is first reduced to one row, so the distinct counts see few rows.
    """
    ids = ["exchange_id", "instrument_id", "market_id"]
    reduced = messages.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"))
    return reduced.agg(
        F.sum("n").alias("messages"),
        *[F.countDistinct(c).alias(c.replace("_id", "s")) for c in ids],
    )


# -- sequences -------------------------------------------------------------------------


def seq_gaps(messages: DataFrame, keys: Sequence[str] = ("market_id",)) -> DataFrame:
    """Places where the sequence number does not rise by one: after ``seq_before`` comes ``seq``."""
    keys = list(keys)
    rows = blocks.cut_blocks(messages.select(*keys, "seq"), keys, ["seq"], SEQ_WIDTH, unique=True)
    seen = blocks.neighbors(rows, keys, ["seq"], back={"seq_before": "seq"})
    missing = F.col("seq") - F.col("seq_before") - 1
    return seen.where(missing != 0).select(*keys, "seq_before", "seq", missing.alias("missing"))


def estimate_time(messages: DataFrame, keys: Sequence[str] = ("market_id",)) -> DataFrame:
    """Bound each message's time by the nearest times at or before and at or after it.

    Adds ``time_from``, ``time_to`` and ``time_error`` (their distance).
    """
    keys = list(keys)
    rows = blocks.cut_blocks(messages, keys, ["seq"], SEQ_WIDTH, unique=True)
    around = blocks.known_around(
        rows, keys, ["seq"], last={"time_from": "time_us"}, next={"time_to": "time_us"}
    )
    return around.withColumn("time_error", F.col("time_to") - F.col("time_from")).drop(blocks.BLOCK)


# -- books -----------------------------------------------------------------------------


def book_full(
    levels: DataFrame, snapshots: DataFrame, until: Column | None = None
) -> DataFrame:
    """The book of every market after its last message (or after sequence number ``until``).

    ``snapshots``: ``market_id, seq`` of snapshot messages. A level holds the last amount set
    at or after the market's last snapshot. Two aggregates with map-side combine and a join
    on the small table of last snapshots, so a busy market is no single task.
    """
    if until is not None:
        levels, snapshots = levels.where(F.col("seq") <= until), snapshots.where(
            F.col("seq") <= until
        )
    last = snapshots.groupBy("market_id").agg(F.max("seq").alias("snapshot_seq"))
    return (
        levels.groupBy("market_id", "side", "price")
        .agg(F.max_by("amount", "seq").alias("amount"), F.max("seq").alias("seq"))
        .join(last, "market_id")
        .where((F.col("seq") >= F.col("snapshot_seq")) & (F.col("amount") > 0))
        .select("market_id", "side", "price", "amount")
    )


def book_per_epoch(levels: DataFrame, snapshots: DataFrame, **options) -> DataFrame:
    """The book at the end of every epoch; an epoch runs from one snapshot to the next."""
    marked = levels.select(
        "market_id", "seq", "side", "price", "amount", F.lit(0).alias("_starts")
    ).unionByName(
        snapshots.select("market_id", "seq", F.lit(1).alias("_starts")), allowMissingColumns=True
    )
    order = ["seq", "_first"]
    # A snapshot's own levels belong to the epoch it starts.
    marked = marked.withColumn("_first", 1 - F.col("_starts"))
    cut = blocks.cut_blocks(marked, ["market_id"], order, SEQ_WIDTH, **options)
    epochs = blocks.running_sum(cut, ["market_id"], order, {"epoch": "_starts"})
    return (
        epochs.where((F.col("_starts") == 0) & (F.col("epoch") > 0))
        .groupBy("market_id", "epoch", "side", "price")
        .agg(F.max_by("amount", "seq").alias("amount"))
        .where(F.col("amount") > 0)
    )


def book_spread(book: DataFrame, keys: Sequence[str] = ("market_id",)) -> DataFrame:
    """Best bid, best ask and their difference; null where a side is empty."""
    price, side = F.col("price"), F.col("side")
    return (
        book.groupBy(*keys)
        .agg(
            F.max(F.when(side == "bid", price)).alias("best_bid"),
            F.min(F.when(side == "ask", price)).alias("best_ask"),
        )
        .withColumn("spread", F.col("best_ask") - F.col("best_bid"))
    )

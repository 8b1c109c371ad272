"""Order books at every point of their history.

Level rows and snapshots are those of ``operators/book.py``. A level lives from the message that
sets it to the message that removes or overwrites it, or to the market's next snapshot. Levels
before a market's first snapshot do not count, since the book is not known there. A message names
a side's price once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans import blocks
from tickloom.plans.settle import dimension, settle

MARKET = ["market_id"]
LEVEL = ["market_id", "side", "price"]

# Sequence numbers of a block; levels that live through a block's edge are copied to the next.
SEQ_WIDTH = 100_000
TOP_WIDTH = 20_000

# At one sequence number a snapshot clears first, then levels are set, then the book is looked at.
_CLEAR, _SET, _LOOK = 0, 1, 2


def level_lives(levels: DataFrame, snapshots: DataFrame, width: int = SEQ_WIDTH) -> DataFrame:
    """Every level's life: ``market_id, side, price, amount, seq_from, seq_to, closed_by``.

    The level stands after each message from ``seq_from`` to the one before ``seq_to``.
    ``closed_by`` is ``removal``, ``overwrite`` or ``snapshot``; it and ``seq_to`` are null for
    levels that still stand. Rows with amount 0 end a life and start none.
    """
    return _lives(levels, snapshots, None, width).drop("rank_from", "rank_to")


def _lives(levels: DataFrame, snapshots: DataFrame, points: DataFrame | None, width: int) -> DataFrame:
    """Lives, and of numbered points (market_id, seq) the first inside and the first behind each."""
    marks = levels.select("market_id", "seq", F.lit(_SET).alias("_kind"), "side", "price", "amount")
    marks = marks.unionByName(
        snapshots.select("market_id", "seq", F.lit(_CLEAR).alias("_kind")), allowMissingColumns=True
    )
    if points is not None:
        looks = points.select("market_id", "seq", F.lit(_LOOK).alias("_kind"))
        marks = marks.unionByName(looks, allowMissingColumns=True)
    order = ["seq", "_kind"]
    cut = blocks.cut_blocks(marks, MARKET, order, width)
    if points is not None:
        cut = cut.withColumn("_look", (F.col("_kind") == _LOOK).cast("bigint"))
        # Points at a row's own number come behind it, so this counts the points before the row.
        cut = settle(blocks.running_sum(cut, MARKET, order, {"rank": "_look"}).drop("_look"), "ranked")
    else:
        cut = cut.withColumn("rank", F.lit(0).cast("bigint"))
    cut = cut.withColumn("_clear", F.when(F.col("_kind") == _CLEAR, F.struct("seq", "rank")))
    known = blocks.known_around(cut, MARKET, order, last={"_since": "_clear"}, next={"_until": "_clear"})
    rows = known.where((F.col("_kind") == _SET) & F.col("_since").isNotNull())
    rows = rows.select(*LEVEL, "seq", "amount", "rank", "_until")
    by_level = blocks.cut_blocks(rows, LEVEL, ["seq"], width, unique=True)
    ahead = {"_next_seq": "seq", "_next_rank": "rank", "_next_amount": "amount"}
    seen = blocks.neighbors(by_level, LEVEL, ["seq"], ahead=ahead)
    cleared = F.col("_until").isNotNull() & (
        F.col("_next_seq").isNull() | (F.col("_until.seq") <= F.col("_next_seq"))
    )
    reason = (
        F.when(cleared, "snapshot")
        .when(F.col("_next_amount") > 0, "overwrite")
        .when(F.col("_next_seq").isNotNull(), "removal")
    )
    return seen.where("amount > 0").select(
        *LEVEL,
        "amount",
        F.col("seq").alias("seq_from"),
        F.when(cleared, F.col("_until.seq")).otherwise(F.col("_next_seq")).alias("seq_to"),
        reason.alias("closed_by"),
        F.col("rank").alias("rank_from"),
        F.when(cleared, F.col("_until.rank")).otherwise(F.col("_next_rank")).alias("rank_to"),
    )


def book_at(levels: DataFrame, snapshots: DataFrame, points: DataFrame, width: int = SEQ_WIDTH) -> DataFrame:
    """The levels that stand after given messages: ``market_id, seq, side, price, amount``.

    ``points``: ``market_id, seq``, any number of them; a point that no message has is after the
    message before it, and equal points count once. Each life learns which of its market's points
    it covers from running counts, and is copied to just these, so the work is that of the input
    and of the result; no life is compared with points that it does not cover.
    """
    asked = points.select("market_id", "seq").where("market_id IS NOT NULL AND seq IS NOT NULL").distinct()
    cut = blocks.cut_blocks(asked, MARKET, ["seq"], width, unique=True)
    numbered = settle(
        blocks.number_rows(cut, MARKET, ["seq"]).select("market_id", "seq", "rn", "n_rows"), "points"
    )
    totals = numbered.groupBy("market_id").agg(F.max("n_rows").alias("_points"))
    lives = _lives(levels, snapshots, numbered, width).join(dimension(totals, "totals"), "market_id")
    last = F.coalesce("rank_to", "_points") - 1
    covering = lives.withColumn("_last", last).where(F.col("rank_from") <= F.col("_last"))
    each = covering.select(*LEVEL, "amount", F.explode(F.sequence("rank_from", "_last")).alias("rn"))
    named = dimension(numbered.select("market_id", "rn", "seq"), "numbers")
    return each.join(named, ["market_id", "rn"]).select("market_id", "seq", "side", "price", "amount")


def last_seq_at(messages: DataFrame, times: DataFrame, width_us: int = 3_600 * 10**6) -> DataFrame:
    """The last message of each market up to given times: ``market_id, time_us, seq``.

    ``messages``: ``market_id, seq, time_us``, null where a message has no time; ``times``:
    ``market_id, time_us``. Messages without a time count as soon as a later message's time is
    reached. Times before a market's first message have no row.
    """
    rows = messages.where("time_us IS NOT NULL").select("market_id", "time_us", "seq", F.lit(0).alias("_ask"))
    asks = times.select("market_id", "time_us", F.lit(None).cast("bigint").alias("seq"), F.lit(1).alias("_ask"))
    rows = rows.unionByName(asks.distinct()).withColumn("_tie", F.coalesce("seq", F.lit(0)))
    order = ["time_us", "_ask", "_tie"]
    cut = blocks.cut_blocks(rows, MARKET, order, width_us)
    found = blocks.running_max_before(cut, MARKET, order, {"_seen": "seq"})
    asked = found.where("_ask = 1 AND _seen IS NOT NULL")
    return asked.select("market_id", "time_us", F.col("_seen").alias("seq"))


# -- the top of the book ---------------------------------------------------------------


def best_after(starts: np.ndarray, ends: np.ndarray, points: np.ndarray) -> np.ndarray:
    """For each point the last of the intervals [start, end) that hold it, or -1.

    Points are sorted; starts and ends are places among them. Intervals are laid on the nodes of a
    binary tree over the points, the larger number staying, and each point takes the largest on its
    way to the root: a few array steps for each of the tree's levels, whatever is removed.
    """
    size = 1 << max(0, int(len(points) - 1).bit_length())
    tree = np.full(2 * size, -1, np.int64)
    own = np.flatnonzero(starts < ends)  # an empty one holds no point
    low, high = starts[own] + size, ends[own] + size
    while len(low):
        odd = (low & 1) == 1
        np.maximum.at(tree, low[odd], own[odd])
        low = low + odd
        odd = (high & 1) == 1
        high = high - odd
        np.maximum.at(tree, high[odd], own[odd])
        low, high = low >> 1, high >> 1
        left = low < high
        low, high, own = low[left], high[left], own[left]
    node = 1
    while node < size:
        above = np.repeat(tree[node : 2 * node], 2)
        tree[2 * node : 4 * node] = np.maximum(tree[2 * node : 4 * node], above)
        node *= 2
    return tree[size : size + len(points)]


def _side(lives: pd.DataFrame, points: np.ndarray, upward: bool) -> tuple[list, list]:
    """Best price and its amount at each point, ``upward`` for the highest; None where none stands."""
    lives = lives.sort_values("price", ascending=upward, kind="stable")
    starts = np.searchsorted(points, lives["a"].to_numpy())
    ends = np.searchsorted(points, lives["b"].to_numpy())
    found = best_after(starts, ends, points).tolist()
    price, amount = lives["price"].tolist(), lives["amount"].tolist()
    return [price[k] if k >= 0 else None for k in found], [amount[k] if k >= 0 else None for k in found]


TOP = ["best_bid", "bid_amount", "best_ask", "ask_amount"]


def book_top(levels: DataFrame, snapshots: DataFrame, width: int = TOP_WIDTH) -> DataFrame:
    """One row for each change of a market's best bid or ask, or of the amount there:
    ``market_id, seq, best_bid, bid_amount, best_ask, ask_amount, spread``.

    The row holds after message ``seq`` and until the next row's; a side without levels is null. The
    first row is that of the first snapshot. Lives are cut at the edges of sequence blocks, so a
    block starts from what stood at its edge and no task gets a market; a block's sweep is a few
    array steps. A life that spans many blocks is copied to each, at most one book for a block.
    """
    lives = settle(level_lives(levels, snapshots).drop("closed_by"), "lives")
    return top_of_lives(lives, snapshots, width)


def top_of_lives(lives: DataFrame, snapshots: DataFrame, width: int = TOP_WIDTH) -> DataFrame:
    """:func:`book_top` of written lives."""
    # A level that still stands is copied up to the end of its market's last block.
    ends = lives.select("market_id", F.greatest("seq_from", F.coalesce("seq_to", "seq_from")).alias("seq"))
    ends = ends.unionByName(snapshots.select("market_id", "seq"))
    last = ends.groupBy("market_id").agg(F.expr(f"(max(seq) div {width}L + 1) * {width}L").alias("_end"))
    whole = lives.join(dimension(last, "ends"), "market_id").withColumn("_to", F.coalesce("seq_to", "_end"))
    first_block, last_block = f"seq_from div {width}L", f"(_to - 1) div {width}L"
    spread = whole.withColumn("block", F.explode(F.expr(f"sequence({first_block}, {last_block})")))
    start, stop = F.col("block") * width, (F.col("block") + 1) * width
    rows = spread.select(
        "market_id", "block", "side", "price", "amount",
        F.greatest("seq_from", start).alias("a"), F.least("_to", stop).alias("b"),
    )
    # A snapshot without levels empties the book and has no life that shows it.
    empty = snapshots.select("market_id", F.expr(f"seq div {width}L").alias("block"), F.col("seq").alias("a"))
    rows = rows.unionByName(empty.withColumn("b", F.col("a")), allowMissingColumns=True)
    kinds = {f.name: f.dataType for f in rows.schema}

    def sweep(whole: pd.DataFrame) -> pd.DataFrame:
        market, block = whole["market_id"].iloc[0], int(whole["block"].iloc[0])
        edge = (block + 1) * width
        points = np.unique(np.concatenate([whole["a"].to_numpy(), whole["b"].to_numpy()]))
        points = points[points < edge]
        bid = _side(whole[whole["side"] == "bid"], points, True)
        ask = _side(whole[whole["side"] == "ask"], points, False)
        found = list(zip(*bid, *ask, strict=True))
        new = [k for k, row in enumerate(found) if k == 0 or row != found[k - 1]]
        out = pd.DataFrame([found[k] for k in new], columns=TOP, dtype=object)
        out.insert(0, "market_id", market)
        out.insert(1, "seq", points[new])
        return out

    schema = T.StructType(
        [T.StructField("market_id", kinds["market_id"]), T.StructField("seq", T.LongType())]
        + [T.StructField(name, kinds["amount" if "amount" in name else "price"]) for name in TOP]
    )
    tops = settle(rows.groupBy("market_id", "block").applyInPandas(sweep, schema), "tops")
    now = F.struct(*TOP)
    cut = blocks.cut_blocks(tops.withColumn("_now", now), MARKET, ["seq"], SEQ_WIDTH, unique=True)
    seen = blocks.neighbors(cut, MARKET, ["seq"], back={"_before": "_now"})
    changed = F.col("_before").isNull() | ~F.col("_now").eqNullSafe(F.col("_before"))
    return seen.where(changed).select("market_id", "seq", *TOP, (F.col("best_ask") - F.col("best_bid")).alias("spread"))


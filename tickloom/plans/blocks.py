"""Ordered per-market work that does not put a market in one task.

A plain ``Window.partitionBy(market)`` sends a whole market to one task. Here the
ordered rows of a market are cut to blocks, the window runs inside (market, block),
and what must cross a block edge travels through a summary with one row per block.
The summary joins back on the very keys the window is partitioned by, so the rows
themselves are shuffled once. All results equal those of the plain window.

Key and order columns must not be null, and the order must be unique inside a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

BLOCK = "_block"

HOUR_NS = 3_600 * 10**9

# A block with more rows than this is cut further.
HOT_ROWS = 4_000_000
# Up to this many hot blocks travel as a broadcast table (a few MB); beyond it they are joined.
MAX_BROADCAST_HOT = 20_000
# A cut makes at least this many pieces, so few cuts reach a single value.
MIN_PIECES = 4_096
MAX_CUTS = 8


def cut_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    width: int,
    hot_rows: int = HOT_ROWS,
    unique: bool = False,
) -> DataFrame:
    """Add ``_block``: an ordered cut of each key's rows by ``order[0] div width``.

    With ``unique`` the first order column has no value twice inside a key, so no block holds
    more than ``width`` rows. Otherwise one small aggregate looks for blocks above
    ``hot_rows``; usually there are none and a block is a number. Hot blocks are cut again in
    order, evenly over the range of the first order column that varies inside the block, until
    none is left; a block is then the list of its places in these cuts.
    """
    cut = df.withColumn(BLOCK, F.expr(f"`{order[0]}` div {int(width)}L"))
    if unique:
        return cut
    # Only numbers can be cut evenly; columns behind the first other one are left out.
    numeric = takewhile(lambda c: isinstance(df.schema[c].dataType, NumericType), order)
    order = list(numeric)
    nested = cut.withColumn(BLOCK, F.array(BLOCK))
    for depth in range(1, MAX_CUTS):
        if depth == 1:
            hot = _hot_blocks(cut, keys, order, hot_rows).withColumn(BLOCK, F.array(BLOCK))
        else:
            hot = _hot_blocks(
                nested.where(F.size(BLOCK) == depth), keys, order, hot_rows
            )
        found = hot.limit(MAX_BROADCAST_HOT + 1).collect()
        if not found:
            return cut if depth == 1 else nested
        if len(found) <= MAX_BROADCAST_HOT:
            hot = F.broadcast(df.sparkSession.createDataFrame(found, hot.schema))
        nested = _cut_again(nested, hot, keys, order, hot_rows).select(*df.columns, BLOCK)
    return nested


def _ranges(order: Sequence[str]) -> list[tuple[str, str, str]]:
    return [(c, f"_lo_{i}", f"_hi_{i}") for i, c in enumerate(order)]


def _hot_blocks(
    cut: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int
) -> DataFrame:
    """Blocks above ``hot_rows`` in which some order column varies, with all ranges."""
    ranges = _ranges(order)
    varies = reduce(lambda a, b: a | b, [F.col(lo) < F.col(hi) for _, lo, hi in ranges])
    return (
        cut.groupBy(*keys, BLOCK)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.min(c).alias(lo) for c, lo, _ in ranges],
            *[F.max(c).alias(hi) for c, _, hi in ranges],
        )
        .where((F.col("_rows") > hot_rows) & varies)
    )


def _cut_again(
    nested: DataFrame, hot: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int
) -> DataFrame:
    pieces = F.greatest(F.ceil(F.col("_rows") * F.lit(4.0) / hot_rows), F.lit(MIN_PIECES))
    place = F.coalesce(
        *[
            F.when(
                F.col(lo) < F.col(hi),
                F.floor((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo) + F.lit(1)) * pieces),
            )
            for c, lo, hi in _ranges(order)
        ]
    )
    longer = F.concat(BLOCK, F.array(place.cast("bigint")))
    return nested.join(hot, [*keys, BLOCK], "left").withColumn(
        BLOCK, F.when(F.col("_rows").isNotNull(), longer).otherwise(F.col(BLOCK))
    )


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def _blocks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(BLOCK)


def _row(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def neighbors(
    cut: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    back: Mapping[str, str] | None = None,
    ahead: Mapping[str, str] | None = None,
) -> DataFrame:
    """Values of the row before (``back``) and the row after (``ahead``), as ``{new: column}``."""
    back, ahead = dict(back or {}), dict(ahead or {})
    inside, blocks = _inside(keys, order), _blocks(keys)
    edges, carries, rows = [], [], []
    if back:
        packed = F.struct(*[F.col(c).alias(n) for n, c in back.items()])
        rows.append(F.lag(packed).over(inside).alias("_back"))
        edges.append(F.max_by(packed, _row(order)).alias("_last"))
        carries.append(F.lag("_last").over(blocks).alias("_from_before"))
    if ahead:
        packed = F.struct(*[F.col(c).alias(n) for n, c in ahead.items()])
        rows.append(F.lead(packed).over(inside).alias("_ahead"))
        edges.append(F.min_by(packed, _row(order)).alias("_first"))
        carries.append(F.lead("_first").over(blocks).alias("_from_after"))

    carry = cut.groupBy(*keys, BLOCK).agg(*edges).select(*keys, BLOCK, *carries)
    joined = cut.select("*", *rows).join(carry, [*keys, BLOCK], "left")
    found = []
    if back:
        whole = F.coalesce(F.col("_back"), F.col("_from_before"))
        found += [whole.getField(n).alias(n) for n in back]
    if ahead:
        whole = F.coalesce(F.col("_ahead"), F.col("_from_after"))
        found += [whole.getField(n).alias(n) for n in ahead]
    return joined.select(*cut.columns, *found)


def _carried(cut, keys, rows, edges, carries, combined) -> DataFrame:
    carry = cut.groupBy(*keys, BLOCK).agg(*edges).select(*keys, BLOCK, *carries)
    joined = cut.select("*", *rows).join(carry, [*keys, BLOCK], "left")
    return joined.select(*cut.columns, *combined)


def running_sum(
    cut: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str]
) -> DataFrame:
    """Running totals up to and including each row, as ``{new: column}``."""
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    before = _blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    return _carried(
        cut,
        keys,
        [F.sum(c).over(upto).alias(f"_in_{n}") for n, c in sums.items()],
        [F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()],
        [F.sum(f"_sum_{n}").over(before).alias(f"_off_{n}") for n in sums],
        [
            F.coalesce(F.col(f"_in_{n}") + F.col(f"_off_{n}"), f"_in_{n}", f"_off_{n}").alias(n)
            for n in sums
        ],
    )


def running_max_before(
    cut: DataFrame, keys: Sequence[str], order: Sequence[Column | str], maxes: Mapping[str, str]
) -> DataFrame:
    """Largest value over all rows before each row (null at the first), as ``{new: column}``."""
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    before = _blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    return _carried(
        cut,
        keys,
        [F.max(c).over(upto).alias(f"_in_{n}") for n, c in maxes.items()],
        [F.max(c).alias(f"_max_{n}") for n, c in maxes.items()],
        [F.max(f"_max_{n}").over(before).alias(f"_off_{n}") for n in maxes],
        [F.greatest(f"_in_{n}", f"_off_{n}").alias(n) for n in maxes],
    )


def known_around(
    cut: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    last: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
) -> DataFrame:
    """Last non-null value at or before each row, and first at or after it, as ``{new: column}``.

    Both directions share one shuffle. Read backwards the frame grows row by row; a forward
    frame to the end would rescan the block for each row.
    """
    last, next = dict(last or {}), dict(next or {})
    grow = (Window.unboundedPreceding, 0)
    passed = (Window.unboundedPreceding, -1)
    forth = _inside(keys, order).rowsBetween(*grow)
    back = Window.partitionBy(*keys, BLOCK).orderBy(*[F.col(c).desc() for c in order])
    back = back.rowsBetween(*grow)
    before = _blocks(keys).rowsBetween(*passed)
    after = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc()).rowsBetween(*passed)

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), _row(order))

    def latest(c: str, over) -> Column:
        return F.last(c, ignorenulls=True).over(over)

    return _carried(
        cut,
        keys,
        [latest(c, forth).alias(f"_in_{n}") for n, c in last.items()]
        + [latest(c, back).alias(f"_in_{n}") for n, c in next.items()],
        [F.max_by(c, known(c)).alias(f"_edge_{n}") for n, c in last.items()]
        + [F.min_by(c, known(c)).alias(f"_edge_{n}") for n, c in next.items()],
        [latest(f"_edge_{n}", before).alias(f"_off_{n}") for n in last]
        + [latest(f"_edge_{n}", after).alias(f"_off_{n}") for n in next],
        [F.coalesce(f"_in_{n}", f"_off_{n}").alias(n) for n in [*last, *next]],
    )


def number_rows(cut: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``rn`` (0-based position in the key's order) and ``n_rows`` (rows of the key)."""
    blocks = _blocks(keys)
    return _carried(
        cut,
        keys,
        [F.row_number().over(_inside(keys, order)).alias("_in_rn")],
        [F.count(F.lit(1)).alias("_rows")],
        [
            F.sum("_rows").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_off"),
            F.sum("_rows").over(Window.partitionBy(*keys)).alias("n_rows"),
        ],
        [
            (F.coalesce("_off", F.lit(0)) + F.col("_in_rn") - 1).cast("bigint").alias("rn"),
            F.col("n_rows").cast("bigint"),
        ],
    )


def slabs(df: DataFrame, lo: Column, hi: Column, size: int) -> DataFrame:
    """Copy each row to the slabs of ``size`` positions that ``[lo, hi]`` touches, as ``_slab``.

    For sliding windows over row positions: a row goes to every slab with a window that
    needs it. Slabs hold equally many positions whatever the data look like.
    """
    first = F.floor(lo / F.lit(size)).cast("bigint")
    last = F.floor(hi / F.lit(size)).cast("bigint")
    return df.withColumn("_slab", F.explode(F.sequence(first, last)))

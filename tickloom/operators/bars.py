"""Open, high, low, close bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schema import MARKET, TIME_ORDER

# Bar names and their widths. Fixed values.
WIDTHS = {
    "1s": "1 second",
    "1m": "1 minute",
    "5m": "5 minutes",
    "1h": "1 hour",
    "1d": "1 day",
}
MONTH = "1mo"


def bar_aggregates() -> list[Column]:
    price, amount = F.col("price.int"), F.col("amount.int")
    order = F.struct(*TIME_ORDER)
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(amount).alias("volume"),
        F.count(F.lit(1)).alias("trades"),
    ]


def ohlc(trades: DataFrame, every: str, more: Sequence[str] = ()) -> DataFrame:
    """Bars of canonical trades per market, in price units; works on batches and streams. Trades
    that differ in a column named in ``more`` make bars of their own.

    The scales stay with the bar, so a market whose scale changes gets separate bars.
    """
    if every == MONTH:
        start = F.date_trunc("month", "time")
    elif every in WIDTHS:
        start = F.window("time", WIDTHS[every])
    else:
        raise ValueError(f"bar must be one of {[*WIDTHS, MONTH]}: {every!r}")
    bars = trades.groupBy(
        *MARKET,
        *more,
        start.alias("bar"),
        F.col("price.scale").alias("price_scale"),
        F.col("amount.scale").alias("amount_scale"),
    ).agg(*bar_aggregates())
    opened = F.col("bar") if every == MONTH else F.col("bar.start")
    return bars.withColumn("bar", opened)

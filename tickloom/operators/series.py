"""Price series of markets: changes, samples, checks, correlations, profits.

Input rows carry ``exchange, instrument, time_ns, seq`` and a double ``p``; other columns
stay out of the shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import numbers, timefmt
from tickloom.plans import blocks
from tickloom.plans.settle import settle
from tickloom.schema import MARKET, TIME_ORDER

NS = 10**9
# A year of 365 days and 6 hours. Fixed value.
YEAR_SECONDS = (365 * 24 + 6) * 3600
INT8_MAX = 127


def prices(trades: DataFrame) -> DataFrame:
    """The columns a price series needs, ``p`` being the price as a double."""
    return trades.select(*MARKET, *TIME_ORDER, numbers.as_double(F.col("price")).alias("p"))


def cut(series: DataFrame, width: int = blocks.HOUR_NS, **options) -> DataFrame:
    return blocks.cut_blocks(series, MARKET, TIME_ORDER, width, **options)


def with_next(series: DataFrame, **options) -> DataFrame:
    """Add ``p_next`` and drop each market's last row."""
    return (
        blocks.neighbors(cut(series, **options), MARKET, TIME_ORDER, ahead={"p_next": "p"})
        .where(F.col("p_next").isNotNull())
        .drop(blocks.BLOCK)
    )


def price_diff(series: DataFrame, forward: bool = True, **options) -> DataFrame:
    """First differences at each row but the market's last.

    ``forward`` gives ``p[i+1] - p[i]``, else ``p[i] - p[i+1]``.
    """
    here, after = F.col("p"), F.col("p_next")
    return with_next(series, **options).withColumn(
        "dp", after - here if forward else here - after
    )


def pct_change(series: DataFrame, **options) -> DataFrame:
    """``(p[i+1] - p[i]) / p[i] * 100``; null where ``p[i]`` is 0."""
    change = F.try_divide(F.col("p_next") - F.col("p"), F.col("p")) * 100
    return with_next(series, **options).withColumn("pct", change)


def drop_pct(series: DataFrame, outlier: float = 0.25, **options) -> DataFrame:
    """``(p[i] - p[i+1]) / p[i] * 100`` (falls are positive) below ``outlier`` in size."""
    change = F.try_divide(F.col("p") - F.col("p_next"), F.col("p")) * 100
    return (
        with_next(series, **options)
        .withColumn("drop_pct", change)
        .where(F.abs("drop_pct") < outlier)
    )


def _bucket(unit: str) -> Column:
    return F.date_trunc(unit, timefmt.to_time(F.col("time_ns")))


def sample_last(series: DataFrame, unit: str, include_last: bool = False) -> DataFrame:
    """Each market's last row per ``unit``; its last bucket may be unfinished and is dropped.

    One aggregate with map-side combine; no market or bucket meets in one task as rows.
    """
    rest = [c for c in series.columns if c not in MARKET]
    whole = F.struct(*rest)
    order = F.struct(*TIME_ORDER)
    sampled = series.groupBy(*MARKET, _bucket(unit).alias("bucket")).agg(
        F.max_by(whole, order).alias("row")
    )
    if not include_last:
        ends = series.groupBy(*MARKET).agg(F.max(_bucket(unit)).alias("last_bucket"))
        sampled = sampled.join(settle(ends, "ends"), MARKET).where(F.col("bucket") < F.col("last_bucket"))
    return sampled.select(*MARKET, "bucket", "row.*")


def decimate(numbered: DataFrame, step: int, trim: int = 0) -> DataFrame:
    """Every ``step``-th row after cutting ``trim`` rows at the start and ``trim - 1`` at the end.

    ``numbered`` has ``rn`` and ``n_rows`` (:func:`blocks.number_rows`).
    """
    inside = (F.col("rn") >= trim) & (F.col("rn") < F.col("n_rows") - max(trim - 1, 0))
    return numbered.where(inside & (F.pmod(F.col("rn") - trim, F.lit(step)) == 0))


def batches(cut_series: DataFrame, size: int) -> DataFrame:
    """Batches of ``size`` rows in each market's order."""
    numbered = blocks.number_rows(cut_series, MARKET, TIME_ORDER)
    return numbered.withColumn("batch", F.floor(F.col("rn") / size).cast("bigint"))


# -- checks ----------------------------------------------------------------------------


def scale_check(trades: DataFrame) -> DataFrame:
    """Scales per market; ``constant`` tells whether both stay the same."""
    p, a = F.col("price.scale"), F.col("amount.scale")
    return (
        trades.groupBy(*MARKET)
        .agg(
            F.min(p).alias("price_scale_min"),
            F.max(p).alias("price_scale_max"),
            F.min(a).alias("amount_scale_min"),
            F.max(a).alias("amount_scale_max"),
        )
        .withColumn(
            "constant",
            (F.col("price_scale_min") == F.col("price_scale_max"))
            & (F.col("amount_scale_min") == F.col("amount_scale_max")),
        )
    )


def monotonic_check(series: DataFrame, keys=MARKET, width: int = 100_000) -> DataFrame:
    """Rows per key whose time lies before that of the row ingested just before."""
    by_seq = blocks.cut_blocks(series, keys, ["seq"], width, unique=True)
    seen = blocks.neighbors(by_seq, keys, ["seq"], back={"time_before": "time_ns"})
    return seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("time_ns") < F.col("time_before")).alias("violations"),
    )


# -- aggregates ------------------------------------------------------------------------


def max_profit(series: DataFrame, **options) -> DataFrame:
    """Sum of all fractional gains per market, for rising and falling prices, and per year.

    ``up`` gains when the next price is higher, ``down`` when it is lower. A price of 0 has no
    fraction and adds nothing.
    """
    rise, zero = F.col("p_next") - F.col("p"), F.lit(0.0)
    rows = blocks.neighbors(cut(series, **options), MARKET, TIME_ORDER, ahead={"p_next": "p"})
    per_year = F.lit(float(YEAR_SECONDS)) / F.nullif(F.col("seconds"), F.lit(0.0))
    return (
        rows.groupBy(*MARKET)
        .agg(
            F.sum(F.try_divide(F.greatest(rise, zero), F.col("p"))).alias("up"),
            F.sum(F.try_divide(F.greatest(-rise, zero), F.col("p"))).alias("down"),
            ((F.max("time_ns") - F.min("time_ns")) / F.lit(1e9)).alias("seconds"),
        )
        .withColumn("up_per_year", F.col("up") * per_year)
        .withColumn("down_per_year", F.col("down") * per_year)
    )


def serial_pairs(series: DataFrame, **options) -> DataFrame:
    """Pairs of successive changes ``p[i-1] - p[i]`` and ``p[i] - p[i+1]``, at row i."""
    rows = blocks.neighbors(
        cut(series, **options), MARKET, TIME_ORDER, back={"p_prev": "p"}, ahead={"p_next": "p"}
    )
    return (
        rows.where(F.col("p_prev").isNotNull() & F.col("p_next").isNotNull())
        .withColumn("dp", F.col("p_prev") - F.col("p"))
        .withColumn("dp_next", F.col("p") - F.col("p_next"))
        .drop(blocks.BLOCK)
    )


def serial_corr(series: DataFrame, **options) -> DataFrame:
    pairs = serial_pairs(series, **options)
    return pairs.groupBy(*MARKET).agg(
        F.count(F.lit(1)).alias("pairs"), F.corr("dp", "dp_next").alias("corr")
    )


def diff_int8(series: DataFrame, **options) -> DataFrame:
    """Half differences scaled so that the market's largest becomes 127, cut to a byte."""
    half = price_diff(series, **options).withColumn("half", F.col("dp") / 2)
    high = half.groupBy(*MARKET).agg(F.max(F.abs("half")).alias("high"))
    unit = F.lit(float(INT8_MAX)) / F.nullif(F.col("high"), F.lit(0.0))
    return half.join(settle(high, "high"), MARKET).withColumn(
        "dp_int8", F.coalesce(F.col("half") * unit, F.lit(0.0)).cast("tinyint")
    )


def portfolio(
    fills: DataFrame, marks: DataFrame, cash: float, width: int = blocks.HOUR_NS, **options
) -> DataFrame:
    """Cash, stock and value after each fill, per account and market.

    ``fills``: account, market, order, ``side, p, amount``; ``marks``: market, order, ``p``.
    The value takes the last mark at or before the fill. Fills and marks of a market are
    walked together in time blocks.
    """
    money = F.col("p") * F.col("amount")
    events = fills.select(
        *MARKET,
        *TIME_ORDER,
        "account",
        F.when(F.col("side") == "buy", -money).otherwise(money).alias("cash_change"),
        F.when(F.col("side") == "buy", F.col("amount"))
        .otherwise(-F.col("amount"))
        .alias("stock_change"),
        F.lit(None).cast("double").alias("mark"),
        F.lit(1).alias("_rank"),
    ).unionByName(
        marks.select(*MARKET, *TIME_ORDER, F.col("p").alias("mark"), F.lit(0).alias("_rank")),
        allowMissingColumns=True,
    )
    order = ["time_ns", "_rank", "seq"]
    marked = blocks.known_around(
        blocks.cut_blocks(events, MARKET, order, width, **options),
        MARKET, order, last={"price": "mark"},
    ).where(F.col("_rank") == 1)
    accounts = ["account", *MARKET]
    held = blocks.running_sum(
        marked, accounts, TIME_ORDER, {"spent": "cash_change", "stock": "stock_change"}
    )
    balance = F.lit(float(cash)) + F.col("spent")
    return held.select(
        *accounts,
        *TIME_ORDER,
        balance.alias("cash"),
        "stock",
        "price",
        (balance + F.col("stock") * F.col("price")).alias("value"),
    )

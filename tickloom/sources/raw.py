"""Raw trades and pair listings to the canonical tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions import numbers, symbols, timefmt

# Codes of taker sides and order types. Fixed values.
SIDES = {"b": "buy", "s": "sell"}
ORDERS = {"m": "market", "l": "limit"}

# Named loaders of landed raw trades: (spark, path) -> rows of schema.RAW_TRADES.
Loader = Callable[[SparkSession, str], DataFrame]
LOADERS: dict[str, Loader] = {}


def register(name: str, loader: Loader) -> None:
    symbols.check_source(name)
    LOADERS[name] = loader


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"Source not known: {name}")
    return LOADERS[name](spark, path)


register("landed_json", lambda spark, path: spark.read.schema(schema.RAW_TRADES).json(path))
register("landed_parquet", lambda spark, path: spark.read.schema(schema.RAW_TRADES).parquet(path))


def _decode(code: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, code)


def normalize(raw: DataFrame, *more: str) -> DataFrame:
    """Raw trades to canonical trades, row by row, so it fits batches and streams.

    Columns named in ``more`` are kept beside the canonical ones.

    Unknown sides and orders become null and are kept, with ``misc``, in ``extra_json``
    under the source's name. A price or amount that is no number gives a null ``int``; rows with
    a null in a required column are split off by :func:`accepted` and :func:`rejects`.
    """
    side, order = _decode(F.col("side"), SIDES), _decode(F.col("order"), ORDERS)
    kept = F.struct(
        F.when(side.isNull(), F.col("side")).alias("side"),
        F.when(order.isNull(), F.col("order")).alias("order"),
        F.nullif(F.col("misc"), F.lit("")).alias("misc"),
    )
    any_kept = F.coalesce(kept["side"], kept["order"], kept["misc"]).isNotNull()
    entry = F.to_json(F.create_map(F.col("source"), kept))
    time_ns = numbers.seconds_to_ns(F.col("time"))
    time = timefmt.to_time(time_ns)
    return raw.select(
        time.alias("time"),
        time_ns.alias("time_ns"),
        "seq",
        numbers.scaled(
            numbers.to_units(F.col("price"), F.col("price_scale")), F.col("price_scale")
        ).alias("price"),
        numbers.scaled(
            numbers.to_units(F.col("amount"), F.col("amount_scale")), F.col("amount_scale")
        ).alias("amount"),
        side.alias("side"),
        order.alias("order"),
        F.when(any_kept, entry).alias("extra_json"),
        F.lit(None).cast(schema.EXTERNAL_ID).alias("external_id"),
        F.year(time).alias("year"),
        "exchange",
        "instrument",
        "source",
        *more,
    )


def reason() -> Column:
    """The first required column that a normalized row lacks; null if it is whole."""
    checks = []
    for name in schema.REQUIRED:
        column, _, part = name.partition(".")
        value = F.col(column)[part] if part else F.col(column)
        checks.append(F.when(value.isNull(), F.lit(name)))
    return F.coalesce(*checks)


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where(reason().isNull())


def rejects(raw: DataFrame) -> DataFrame:
    """The landed rows that :func:`accepted` leaves out, as they came, with the ``reason``."""
    landed = F.struct(*[F.col(c) for c in schema.RAW_TRADES.fieldNames()])
    # The landed row rides along as one more column, so each row is looked at once.
    kept = raw.withColumn("_landed", landed)
    normalized = normalize(kept, "_landed")
    return normalized.where(reason().isNotNull()).select("_landed.*", reason().alias("reason"))


def conform(stored: DataFrame) -> DataFrame:
    """Trades of the older shape to the canonical schema.

    The older shape has integer ``price`` and ``amount`` with their scales beside them,
    instruments in path form, and empty texts for a missing ``extra_json``. Integers that
    do not fit 64 signed bits give a null ``int``.
    """
    time = timefmt.to_time(F.col("time_ns"))
    return stored.select(
        time.alias("time"),
        "time_ns",
        "seq",
        numbers.scaled(F.col("price").try_cast("bigint"), F.col("price_scale")).alias("price"),
        numbers.scaled(F.col("amount").try_cast("bigint"), F.col("amount_scale")).alias("amount"),
        "side",
        "order",
        F.nullif(F.col("extra_json"), F.lit("")).alias("extra_json"),
        F.lit(None).cast(schema.EXTERNAL_ID).alias("external_id"),
        F.year(time).alias("year"),
        "exchange",
        symbols.from_path(F.col("instrument")).alias("instrument"),
        "source",
    )


def conform_nested(stored: DataFrame) -> DataFrame:
    """Trades of the nested older shape to the canonical schema.

    ``price`` and ``amount`` are ``{value, scale}``, ``external_id`` is ``{integer, uuid, string}``
    with one of the three set; a string id becomes the prefix.
    """
    time, given = timefmt.to_time(F.col("time_ns")), F.col("external_id")
    number = lambda c: numbers.scaled(F.col(c)["value"].try_cast("bigint"), F.col(c)["scale"])
    external = F.struct(
        given["string"].alias("prefix"),
        given["integer"].cast("decimal(20,0)").alias("numeric"),
        given["uuid"].alias("uuid"),
    )
    return stored.select(
        time.alias("time"),
        "time_ns",
        "seq",
        number("price").alias("price"),
        number("amount").alias("amount"),
        "side",
        "order",
        F.nullif(F.col("extra_json"), F.lit("")).alias("extra_json"),
        external.cast(schema.EXTERNAL_ID).alias("external_id"),
        F.year(time).alias("year"),
        "exchange",
        symbols.from_path(F.col("instrument")).alias("instrument"),
        "source",
    )


# -- dimensions ------------------------------------------------------------------------


def instruments(pairs: DataFrame) -> DataFrame:
    """Instruments of a pair listing (``name, wsname``); pairs without ``wsname`` do not trade."""
    sides = F.split("wsname", "/")
    base, quote = (symbols.rename_asset(F.get(sides, i)) for i in (0, 1))
    return pairs.where(F.col("wsname").isNotNull()).select(
        "name",
        base.alias("base"),
        quote.alias("quote"),
        F.concat_ws("/", base, quote).alias("instrument"),
    )


def instrument_dim(pairs: DataFrame) -> DataFrame:
    return instruments(pairs).select("instrument", "base", "quote").distinct().orderBy("instrument")


def asset_dim(pairs: DataFrame) -> DataFrame:
    listed = instruments(pairs)
    return (
        listed.select(F.col("base").alias("asset"))
        .union(listed.select("quote"))
        .distinct()
        .orderBy("asset")
    )


def market_dim(pairs: DataFrame, exchange: str) -> DataFrame:
    symbols.check_exchange(exchange)
    market = symbols.join_market(F.lit(exchange), F.col("instrument"))
    return instrument_dim(pairs).select(
        F.lit(exchange).alias("exchange"), "instrument", market.alias("market")
    )

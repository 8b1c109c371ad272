"""The fixed table shapes."""

from __future__ import annotations

from pyspark.sql import types as T

DECIMAL = T.StructType(
    [
        T.StructField("int", T.LongType()),
        T.StructField("scale", T.IntegerType()),
    ]
)

EXTERNAL_ID = T.StructType(
    [
        T.StructField("prefix", T.StringType()),
        T.StructField("numeric", T.DecimalType(20, 0)),
        T.StructField("uuid", T.BinaryType()),
    ]
)

TRADES = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("time_ns", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("price", DECIMAL),
        T.StructField("amount", DECIMAL),
        T.StructField("side", T.StringType()),
        T.StructField("order", T.StringType()),
        T.StructField("extra_json", T.StringType()),
        T.StructField("external_id", EXTERNAL_ID),
        T.StructField("year", T.IntegerType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("instrument", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

TRADE_COLUMNS = TRADES.fieldNames()
# Columns, and parts of columns, without nulls.
REQUIRED = [
    "time",
    "time_ns",
    "seq",
    "price.int",
    "price.scale",
    "amount.int",
    "amount.scale",
    "year",
    "exchange",
    "instrument",
    "source",
]
PARTITION_COLUMNS = ["year", "exchange", "instrument", "source"]

# A market is an instrument on an exchange; rows inside it are ordered by time and ingest order.
MARKET = ["exchange", "instrument"]
TIME_ORDER = ["time_ns", "seq"]

# Landed raw trades, one row per trade as the exchange sends it.
RAW_TRADES = T.StructType(
    [
        T.StructField("exchange", T.StringType()),
        T.StructField("instrument", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("price", T.StringType()),
        T.StructField("amount", T.StringType()),
        T.StructField("time", T.DoubleType()),
        T.StructField("side", T.StringType()),
        T.StructField("order", T.StringType()),
        T.StructField("misc", T.StringType()),
        T.StructField("price_scale", T.IntegerType()),
        T.StructField("amount_scale", T.IntegerType()),
    ]
)

_LEVEL = T.StructType(
    [T.StructField("priceStr", T.StringType()), T.StructField("amountStr", T.StringType())]
)
_DELTA_SIDE = T.StructType(
    [
        T.StructField("set", T.ArrayType(_LEVEL)),
        T.StructField("removeStr", T.ArrayType(T.StringType())),
    ]
)

# JSON form of one captured message; exactly one of the four update fields is present.
MESSAGE = T.StructType(
    [
        T.StructField(
            "marketUpdate",
            T.StructType(
                [
                    T.StructField(
                        "tradesUpdate",
                        T.StructType(
                            [
                                T.StructField(
                                    "trades",
                                    T.ArrayType(
                                        T.StructType(
                                            [
                                                T.StructField("timestamp", T.LongType()),
                                                T.StructField("priceStr", T.StringType()),
                                                T.StructField("amountStr", T.StringType()),
                                                T.StructField("timestampNano", T.LongType()),
                                                T.StructField("externalId", T.StringType()),
                                                T.StructField("orderSide", T.StringType()),
                                            ]
                                        )
                                    ),
                                )
                            ]
                        ),
                    ),
                    T.StructField(
                        "orderBookUpdate",
                        T.StructType(
                            [
                                T.StructField("bids", T.ArrayType(_LEVEL)),
                                T.StructField("asks", T.ArrayType(_LEVEL)),
                                T.StructField("seqNum", T.LongType()),
                            ]
                        ),
                    ),
                    T.StructField(
                        "orderBookDeltaUpdate",
                        T.StructType(
                            [
                                T.StructField("bids", _DELTA_SIDE),
                                T.StructField("asks", _DELTA_SIDE),
                                T.StructField("seqNum", T.LongType()),
                            ]
                        ),
                    ),
                    T.StructField(
                        "orderBookSpreadUpdate",
                        T.StructType(
                            [
                                T.StructField("timestamp", T.LongType()),
                                T.StructField("bid", _LEVEL),
                                T.StructField("ask", _LEVEL),
                            ]
                        ),
                    ),
                    T.StructField(
                        "market",
                        T.StructType(
                            [
                                T.StructField("exchangeId", T.LongType()),
                                T.StructField("currencyPairId", T.LongType()),
                                T.StructField("marketId", T.LongType()),
                            ]
                        ),
                    ),
                ]
            ),
        )
    ]
)

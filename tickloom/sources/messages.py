"""Captured market messages (JSON form) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions.numbers import without_exponent
from tickloom.plans.pin import pin

# The first messages of a capture are replies to the login and the subscription. Fixed value.
REPLIES = 2

LEVEL_PRICE = "decimal(38,18)"

# What that type holds without a loss.
READABLE = r"\A[+-]?(\d{1,20}(\.\d{0,18}0*)?|\.\d{1,18}0*)\z"

KINDS = {
    "trade": "tradesUpdate",
    "snapshot": "orderBookUpdate",
    "delta": "orderBookDeltaUpdate",
    "spread": "orderBookSpreadUpdate",
}


def number(text: Column) -> Column:
    """A price or amount, also with an exponent; null if the text is no number or has more digits
    than fit."""

    def read(plain: Column) -> Column:
        return F.when(plain.rlike(READABLE), plain.try_cast(LEVEL_PRICE))

    moved = F.regexp_replace(without_exponent(text), r"\A([+-]?)0+(?=\d)", "$1")  # zeros of 0e99, too
    plain = F.when(text.rlike("[eE]"), moved).otherwise(text)
    return F.transform(F.array(plain), read)[0]


def _known(update: Column) -> Column:
    return F.coalesce(*[F.when(update[f].isNotNull(), F.lit(k)) for k, f in KINDS.items()])


def unreadable_messages(frames: DataFrame) -> DataFrame:
    """Frames that :func:`parse` leaves out, or knows no kind of: ``path, seq, reason, text``."""
    text = F.col("payload").cast("string")
    update = F.col("m.marketUpdate")
    reason = F.when(update.isNull(), "json").when(_known(update).isNull(), "kind")
    read = pin(frames.where(F.col("seq") >= REPLIES), m=F.from_json(text, schema.MESSAGE))
    return read.where(reason.isNotNull()).select("path", "seq", reason.alias("reason"), text.alias("text"))


def parse(frames: DataFrame) -> DataFrame:
    """Messages of ``path, seq, payload`` frames: their kind, market ids and update.

    Others are listed by :func:`unreadable_messages`.
    """
    text = F.col("payload").cast("string")
    update = F.col("m.marketUpdate")
    kind = _known(update)
    return (
        pin(frames.where(F.col("seq") >= REPLIES), m=F.from_json(text, schema.MESSAGE))
        .where(kind.isNotNull())
        .select(
            "path",
            "seq",
            kind.alias("kind"),
            update["market"]["exchangeId"].alias("exchange_id"),
            update["market"]["currencyPairId"].alias("instrument_id"),
            update["market"]["marketId"].alias("market_id"),
            F.coalesce(
                update["orderBookUpdate"]["seqNum"], update["orderBookDeltaUpdate"]["seqNum"]
            ).alias("seq_num"),
            update.alias("update"),
        )
    )


_IDS = ["path", "seq", "kind", "exchange_id", "instrument_id", "market_id", "seq_num"]


def _whole() -> Column:
    readable = F.col("row.price").isNotNull() & F.col("row.amount").isNotNull()
    return F.col("row").isNull() | readable


def market_updates(messages: DataFrame) -> DataFrame:
    """One row per trade, book level or spread side, all kinds in one shape.

    ``amount`` 0 removes a level. Times exist on trades (ns) and spreads (ms) only. Rows whose
    price or amount cannot be read are listed by :func:`unreadable_values`.
    """
    rows = _items(messages).where(_whole())
    return rows.select(*_IDS, "row.side", "row.time_ns", "row.price", "row.amount", "row.external_id")


def unreadable_values(messages: DataFrame) -> DataFrame:
    """Items of messages with a price or amount that is no number or too long:
    ``path, seq, reason, text``."""
    no_price = F.col("row.price").isNull()
    text = F.when(no_price, F.col("row.price_text")).otherwise(F.col("row.amount_text"))
    reason = F.when(no_price, "price").otherwise("amount")
    return _items(messages).where(~_whole()).select("path", "seq", reason.alias("reason"), text.alias("text"))


def rejects(frames: DataFrame) -> DataFrame:
    """Everything of the frames that does not reach :func:`market_updates`, with its text."""
    return unreadable_messages(frames).unionByName(unreadable_values(parse(frames)))


def _items(messages: DataFrame) -> DataFrame:
    u = F.col("update")

    def rows(items, side, time_ns, price, amount, external=None):
        none = F.lit(None).cast("string")
        return F.transform(
            items,
            lambda x: F.struct(
                side(x).alias("side"),
                time_ns(x).alias("time_ns"),
                number(price(x)).alias("price"),
                number(amount(x)).alias("amount"),
                (external(x) if external else none).alias("external_id"),
                price(x).alias("price_text"),
                amount(x).alias("amount_text"),
            ),
        )

    no_time = lambda x: F.lit(None).cast("bigint")
    price_of = lambda x: x["priceStr"]
    amount_of = lambda x: x["amountStr"]

    def named(side):
        return lambda x: F.lit(side)

    def levels(items, side):
        return rows(items, named(side), no_time, price_of, amount_of)

    def removals(items, side):
        return rows(
            items,
            named(side),
            no_time,
            lambda x: x,
            lambda x: F.lit("0"),
        )

    trades = rows(
        u["tradesUpdate"]["trades"],
        lambda x: F.when(x["orderSide"] == "BUYSIDE", "buy").when(
            x["orderSide"] == "SELLSIDE", "sell"
        ),
        lambda x: F.coalesce(x["timestampNano"], x["timestamp"] * F.lit(10**9)),
        price_of,
        amount_of,
        lambda x: x["externalId"],
    )
    snapshot, delta = u["orderBookUpdate"], u["orderBookDeltaUpdate"]
    spread = u["orderBookSpreadUpdate"]
    spread_ns = lambda x: spread["timestamp"] * F.lit(10**6)
    spread_side = lambda side: rows(
        F.array(spread[side]), named(side), spread_ns, price_of, amount_of
    )
    none = F.array().cast(_ROW)

    def together(*parts):
        return F.concat(*[F.coalesce(p, none) for p in parts])

    # Only the branch of the message's own kind is evaluated.
    kind = F.col("kind")
    every = (
        F.when(kind == "trade", trades)
        .when(kind == "snapshot", together(levels(snapshot["bids"], "bid"), levels(snapshot["asks"], "ask")))
        .when(
            kind == "delta",
            together(
                levels(delta["bids"]["set"], "bid"),
                levels(delta["asks"]["set"], "ask"),
                removals(delta["bids"]["removeStr"], "bid"),
                removals(delta["asks"]["removeStr"], "ask"),
            ),
        )
        .when(kind == "spread", F.concat(spread_side("bid"), spread_side("ask")))
    )
    # An empty snapshot still replaces the book: explode_outer keeps one row without a level.
    return messages.select(*_IDS, F.explode_outer(every).alias("row"))


_ROW = (
    "array<struct<side:string,time_ns:bigint,price:decimal(38,18),amount:decimal(38,18),"
    "external_id:string,price_text:string,amount_text:string>>"
)

"""Market tables derived from the driver's test tables, in Spark and as SQL.

Each function reads whole tables. The SQL texts are the same views for the check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema, session
from tickloom.functions import numbers
from tickloom.plans import blocks
from tickloom.sources import frames, kept_bars, lake, versions
from tickloom.streaming import ingest

CAPTURE_FRAMES = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "*",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def pick(number: Column, *names: str | None) -> Column:
    chosen = F.lit(names[-1])
    for i, name in reversed(list(enumerate(names[:-1]))):
        chosen = F.when(number == i, F.lit(name)).otherwise(chosen)
    return chosen


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical trades of 15 markets from ``events``."""
    e = F.col("event_id")
    return _events(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("time"),
        (F.col("time_us") * 1000).alias("time_ns"),
        e.alias("seq"),
        numbers.scaled(F.round(F.col("value") * 100), F.lit(2)).alias("price"),
        numbers.scaled(F.col("k"), F.lit(0)).alias("amount"),
        pick(e % 3, "buy", "sell", None).alias("side"),
        F.when(e % 5 == 0, F.lit(None)).when(e % 2 == 0, "market").otherwise("limit").alias("order"),
        F.lit(None).cast("string").alias("extra_json"),
        F.struct(
            F.lit("ev").alias("prefix"),
            e.cast("decimal(20,0)").alias("numeric"),
            F.lit(None).cast("binary").alias("uuid"),
        ).alias("external_id"),
        F.year("ts").alias("year"),
        pick(F.col("user_id") % 3, "alpha", "beta", "gamma").alias("exchange"),
        F.concat("event_type", F.lit("/eur")).alias("instrument"),
        F.when(F.col("user_id") % 4 == 0, "src_ws").otherwise("src_rest").alias("source"),
    )


TRADES_SQL = """
trades AS (
  SELECT epoch_us(ts) AS time_us, event_id AS seq,
         CAST(round(value*100) AS BIGINT) AS price_int,
         CAST(json_extract_string(props,'$.k') AS BIGINT) AS amount_int,
         CASE event_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' END AS side,
         CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'market' ELSE 'limit' END AS ord,
         CAST(year(ts) AS INTEGER) AS yr,
         CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS exchange,
         concat(event_type,'/eur') AS instrument,
         CASE WHEN user_id % 4 = 0 THEN 'src_ws' ELSE 'src_rest' END AS source,
         CAST(round(value*100) AS BIGINT) / 100.0::DOUBLE AS p
  FROM events)"""


def long_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical trades over seven years from ``orders``; many share a time."""
    time = F.col("o_orderdate").cast("timestamp")
    nothing = F.lit(None).cast("string")
    first = F.substring("o_orderpriority", 1, 1)
    names = {"1": "btc", "2": "eth", "3": "ada", "4": "dot", "5": "xrp"}
    base = F.coalesce(*[F.when(first == d, F.lit(n)) for d, n in names.items()])
    return table(spark, sf_dir, "orders").select(
        time.alias("time"),
        (F.unix_micros(time) * 1000).alias("time_ns"),
        F.col("o_orderkey").alias("seq"),
        numbers.scaled(F.round(F.col("o_totalprice") * 100), F.lit(2)).alias("price"),
        numbers.scaled(F.col("o_custkey"), F.lit(0)).alias("amount"),
        nothing.alias("side"),
        nothing.alias("order"),
        nothing.alias("extra_json"),
        F.lit(None).cast(schema.EXTERNAL_ID).alias("external_id"),
        F.year(time).alias("year"),
        F.when(F.col("o_orderstatus") == "P", "alpha")
        .when(F.col("o_orderstatus") == "F", "beta")
        .otherwise("gamma")
        .alias("exchange"),
        F.concat(base, F.lit("/eur")).alias("instrument"),
        F.lit("src_rest").alias("source"),
    )


LONG_TRADES_SQL = """
long_trades AS (
  SELECT epoch_us(o_orderdate) AS time_us, o_orderkey AS seq,
         CAST(round(o_totalprice*100) AS BIGINT) AS price_int, o_custkey AS amount_int,
         CAST(year(o_orderdate) AS INTEGER) AS yr,
         CASE o_orderstatus WHEN 'P' THEN 'alpha' WHEN 'F' THEN 'beta' ELSE 'gamma' END AS exchange,
         concat(CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'btc' WHEN '2' THEN 'eth'
                WHEN '3' THEN 'ada' WHEN '4' THEN 'dot' ELSE 'xrp' END, '/eur') AS instrument,
         'src_rest' AS source,
         CAST(round(o_totalprice*100) AS BIGINT) / 100.0::DOUBLE AS p
  FROM orders)"""

_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Folder of a derived table, written once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        folder = session.new_folder(spark, name)
        write(folder)
        _written[key] = folder
    return _written[key]


def lake_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Root of a lake that holds the named trades."""
    session.prepare(spark)
    build = {"trades": trades, "long_trades": long_trades}[name]
    return _once(spark, sf_dir, name, lambda root: lake.write(build(spark, sf_dir), root))


# When the versioned lake below was last compacted.
LAKE_NOW = "2024-02-03 12:00:00"


def versioned_lake(spark: SparkSession, sf_dir: str) -> str:
    """Root of a lake that took in three write-ahead batches in two compactions.

    The last batch also has late rows of finished days, some of them a second time.
    """
    session.prepare(spark)
    return _once(spark, sf_dir, "versioned", lambda root: _compactions(spark, sf_dir, root, lambda: None))


def barred_lake(spark: SparkSession, sf_dir: str) -> str:
    """Root of such a lake that also keeps bars, refreshed after each compaction."""
    session.prepare(spark)

    def build(root: str) -> None:
        _compactions(spark, sf_dir, root, lambda: kept_bars.refresh(spark, root))

    return _once(spark, sf_dir, "barred", build)


def _compactions(spark: SparkSession, sf_dir: str, root: str, after: Callable[[], object]) -> None:
    # Written once: the batches' writers read their rows twice each, to sample ranges and to write.
    rows = spark.read.schema(schema.TRADES).parquet(stored(spark, sf_dir, "flat_trades", trades))
    day, late, again = F.dayofmonth("time"), F.col("seq") % 997 == 0, F.col("seq") % 991 == 0
    ingest.append_batch(rows.where((day < 4) & ~late), 0, root)
    versions.compact(spark, root, F.lit("2024-01-04 00:00:00"))
    after()
    ingest.append_batch(rows.where((day >= 4) & (day < 21) & ~late), 1, root)
    ingest.append_batch(rows.where((day >= 21) | late | again), 2, root)
    versions.compact(spark, root, F.lit(LAKE_NOW))
    after()


def stored(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    build: Callable[[SparkSession, str], DataFrame],
    form: str = "parquet",
) -> str:
    """Folder of a derived table's files."""
    session.prepare(spark)
    return _once(
        spark, sf_dir, name, lambda folder: build(spark, sf_dir).write.format(form).save(folder)
    )


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trades as landed, from ``events``."""
    e = F.col("event_id")
    return _events(spark, sf_dir).select(
        pick(F.col("user_id") % 3, "alpha", "beta", "gamma").alias("exchange"),
        F.concat("event_type", F.lit("/eur")).alias("instrument"),
        F.lit("src_rest").alias("source"),
        e.alias("seq"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("price"),
        F.col("k").cast("string").alias("amount"),
        (F.col("time_us") / F.lit(1e6)).alias("time"),
        pick(e % 3, "b", "s", "x").alias("side"),
        pick(e % 5, "x", "m", "l", "m", "l").alias("order"),
        F.when(e % 4 == 0, "note").otherwise("").alias("misc"),
        F.when(F.col("event_type") == "view", 5).otherwise(1).alias("price_scale"),
        F.lit(8).alias("amount_scale"),
    )


def stored_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the older shape: integers with the scale beside them, path-form instruments."""
    e = F.col("event_id")
    return _events(spark, sf_dir).select(
        (F.col("time_us") * 1000).alias("time_ns"),
        e.alias("seq"),
        F.round(F.col("value") * 100).cast("decimal(20,0)").alias("price"),
        F.lit(2).alias("price_scale"),
        F.col("k").cast("decimal(20,0)").alias("amount"),
        F.lit(0).alias("amount_scale"),
        pick(e % 3, "buy", "sell", None).alias("side"),
        F.lit(None).cast("string").alias("order"),
        F.when(e % 4 == 0, F.col("props")).otherwise("").alias("extra_json"),
        pick(F.col("user_id") % 3, "alpha", "beta", "gamma").alias("exchange"),
        F.concat("event_type", F.lit("_eur")).alias("instrument"),
        F.lit("src-rest").alias("source"),
    )


def nested_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of the older shape with nested decimals and ids."""
    e, nothing = F.col("seq"), F.lit(None)
    number = lambda c, s: F.struct(F.col(c).alias("value"), F.col(s).alias("scale"))
    external = F.struct(
        F.when(e % 3 == 0, e).alias("integer"),
        F.when(e % 3 == 2, F.unhex(F.md5(e.cast("string")))).alias("uuid"),
        F.when(e % 3 == 1, F.lit("ev")).otherwise(nothing).alias("string"),
    )
    return stored_trades(spark, sf_dir).select(
        "time_ns", "seq", number("price", "price_scale").alias("price"),
        number("amount", "amount_scale").alias("amount"), "side", "order", "extra_json",
        external.alias("external_id"), "exchange", "instrument", "source",
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair listing from ``nation``."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"),
        F.when(
            n % 6 != 5,
            F.concat_ws(
                "/", pick(n % 4, "XBT", "XDG", "ETH", "ADA"),
                pick(r, "EUR", "USD", "GBP", "XBT", "JPY"),
            ),
        ).alias("wsname"),
    )


PAIRS_SQL = """
pairs AS (
  SELECT CASE n_nationkey % 4 WHEN 0 THEN 'btc' WHEN 1 THEN 'doge' WHEN 2 THEN 'eth' ELSE 'ada' END AS base,
         CASE n_regionkey WHEN 0 THEN 'eur' WHEN 1 THEN 'usd' WHEN 2 THEN 'gbp' WHEN 3 THEN 'btc'
              ELSE 'jpy' END AS quote
  FROM nation WHERE n_nationkey % 6 <> 5)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file catalog of 50 markets from ``orders``."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file_id"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 50).cast("string")).alias("market"),
        day.alias("s"),
        F.date_add(day, (F.lit(1) + F.col("o_orderkey") % 40).cast("int")).alias("e"),
    )


CATALOG_SQL = """
catalog AS (
  SELECT o_orderkey AS file_id, concat('m', CAST(o_custkey % 50 AS VARCHAR)) AS market,
         CAST(o_orderdate AS DATE) AS s,
         CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 40 AS INTEGER) AS e
  FROM orders)"""


def message_folder(spark: SparkSession, sf_dir: str) -> str:
    return stored(spark, sf_dir, "messages", _messages)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book messages of ten markets from ``events``, stored as a capture would be."""
    return spark.read.parquet(message_folder(spark, sf_dir))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages, numbered per market."""
    e = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "purchase", "trade")
        .when(F.col("event_type") == "signup", "snapshot")
        .when(F.col("event_type") == "error", "spread")
        .otherwise("delta")
    )
    rows = _events(spark, sf_dir).select(
        (F.col("user_id") % 10).alias("market_id"),
        F.col("time_us").alias("at"),
        e,
        kind.alias("kind"),
        F.when(kind.isin("trade", "spread"), F.col("time_us")).alias("time_us"),
        F.when(e % 2 == 0, "bid").otherwise("ask").alias("side"),
        F.floor("value").cast("bigint").alias("price"),
        F.when(F.col("k") % 4 == 0, 0).otherwise(F.col("k")).alias("amount"),
    )
    keys, order = ["market_id"], ["at", "event_id"]
    numbered = blocks.number_rows(
        blocks.cut_blocks(rows, keys, order, 3_600 * 10**6), keys, order
    )
    return numbered.select(
        "market_id",
        (F.col("market_id") % 3).alias("exchange_id"),
        (F.col("market_id") % 7).alias("instrument_id"),
        (F.col("rn") + 1).alias("seq"),
        "kind",
        "time_us",
        "side",
        "price",
        "amount",
        "event_id",
    )


# Messages of the folder below come up to this many numbers late.
JITTER = 60


def late_message_folder(spark: SparkSession, sf_dir: str) -> str:
    """The messages landed in three parts of four files each, out of order and some twice."""

    def land(folder: str) -> None:
        rows = messages(spark, sf_dir)
        most = rows.agg(F.max("seq")).first()[0] or 0
        jitter = F.pmod(F.xxhash64("event_id"), F.lit(JITTER))
        part = F.least(F.lit(2), F.floor((F.col("seq") + jitter) * 3 / F.lit(most + 1)))
        for k in range(3):
            again = (part == k - 1) & (F.col("event_id") % 50 == 0)
            landed = rows.where((part == k) | again)
            landed.repartition(4, "event_id").write.mode("append").parquet(folder)

    return _once(spark, sf_dir, "late-messages", land)


MESSAGES_SQL = """
messages AS (
  SELECT CAST(user_id % 10 AS BIGINT) AS market_id,
         CAST(user_id % 10 % 3 AS BIGINT) AS exchange_id, CAST(user_id % 10 % 7 AS BIGINT) AS instrument_id,
         row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS seq,
         CASE event_type WHEN 'purchase' THEN 'trade' WHEN 'signup' THEN 'snapshot'
                         WHEN 'error' THEN 'spread' ELSE 'delta' END AS kind,
         CASE WHEN event_type IN ('purchase','error') THEN epoch_us(ts) END AS time_us,
         CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
         CAST(floor(value) AS BIGINT) AS price,
         CASE WHEN CAST(json_extract_string(props,'$.k') AS BIGINT) % 4 = 0 THEN 0
              ELSE CAST(json_extract_string(props,'$.k') AS BIGINT) END AS amount,
         event_id
  FROM events)"""


def levels(messages: DataFrame) -> DataFrame:
    """Level rows: a delta's one level, a snapshot's three bids and three asks."""
    p, a = F.col("price"), F.col("amount")
    full = F.array(
        *[
            F.struct(F.lit(s).alias("side"), x.alias("price"), (a + 1 + o).alias("amount"))
            for o in range(3)
            for s, x in (("bid", p - o), ("ask", p + 1 + o))
        ]
    )
    one = F.array(F.struct("side", "price", "amount"))
    return (
        messages.where(F.col("kind").isin("snapshot", "delta"))
        .select(
            "market_id",
            "seq",
            F.explode(F.when(F.col("kind") == "snapshot", full).otherwise(one)).alias("level"),
        )
        .select("market_id", "seq", "level.*")
    )


def snapshots(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("kind") == "snapshot").select("market_id", "seq")


LEVELS_SQL = """
levels AS (
  SELECT market_id, seq, side, price, amount FROM messages WHERE kind = 'delta'
  UNION ALL
  SELECT market_id, seq, 'bid', price - o, amount + 1 + o
  FROM messages, (VALUES (0),(1),(2)) AS v(o) WHERE kind = 'snapshot'
  UNION ALL
  SELECT market_id, seq, 'ask', price + 1 + o, amount + 1 + o
  FROM messages, (VALUES (0),(1),(2)) AS v(o) WHERE kind = 'snapshot')"""


def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured messages in JSON, one per event: ``path, seq, payload``."""
    e = F.col("event_id")
    value = F.col("value").cast("decimal(18,2)").cast("string")
    level = F.struct(value.alias("priceStr"), F.col("k").cast("string").alias("amountStr"))
    bid, gone = e % 2 == 0, F.col("k") % 4 == 0
    kind = F.col("event_type")

    def delta_side(on: Column) -> Column:
        return F.struct(
            F.when(on & ~gone, F.array(level)).alias("set"),
            F.when(on & gone, F.array(value)).alias("removeStr"),
        )

    trade = F.struct(
        F.expr("time_us div 1000000").alias("timestamp"),
        value.alias("priceStr"),
        F.col("k").cast("string").alias("amountStr"),
        (F.col("time_us") * 1000).alias("timestampNano"),
        F.concat(F.lit("ev:"), e.cast("string")).alias("externalId"),
        F.when(bid, "BUYSIDE").otherwise("SELLSIDE").alias("orderSide"),
    )
    update = F.struct(
        F.when(kind == "purchase", F.struct(F.array(trade).alias("trades"))).alias("tradesUpdate"),
        F.when(
            kind == "signup",
            F.struct(
                F.array(level).alias("bids"), F.array(level, level).alias("asks"), e.alias("seqNum")
            ),
        ).alias("orderBookUpdate"),
        F.when(
            kind.isin("click", "view"),
            F.struct(
                delta_side(bid).alias("bids"), delta_side(~bid).alias("asks"), e.alias("seqNum")
            ),
        ).alias("orderBookDeltaUpdate"),
        F.when(
            kind == "error",
            F.struct(
                F.expr("time_us div 1000").alias("timestamp"),
                level.alias("bid"),
                level.alias("ask"),
            ),
        ).alias("orderBookSpreadUpdate"),
        F.struct(
            (F.col("user_id") % 3).alias("exchangeId"),
            (F.col("user_id") % 7).alias("currencyPairId"),
            (F.col("user_id") % 10).alias("marketId"),
        ).alias("market"),
    )
    return _events(spark, sf_dir).select(
        _capture(e).alias("path"),
        (e % CAPTURE_FRAMES).alias("seq"),
        F.to_json(F.struct(update.alias("marketUpdate"))).alias("payload"),
    )


def spoiled_raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trades of which some lack a time, and some have no readable or too long a number."""
    e = F.col("seq")
    return (
        raw_trades(spark, sf_dir)
        .withColumn("time", F.when(e % 70 != 3, F.col("time")))
        .withColumn("price", F.when(e % 50 == 4, "abc").otherwise(F.col("price")))
        .withColumn("amount", F.when(e % 90 == 5, "9" * 24).otherwise(F.col("amount")))
    )


def spoiled_message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured messages of which some are cut off, unknown, or hold bad prices."""
    text, at = F.col("payload"), F.col("seq") % 40
    prices = lambda price: F.regexp_replace(text, r'"priceStr":"[^"]*"', f'"priceStr":"{price}"')
    payload = (
        F.when(at == 7, F.substring(text, 1, 20))
        .when(at == 8, F.lit('{"marketUpdate":{"market":{"marketId":1}}}'))
        .when(at == 9, prices("abc"))
        .when(at == 11, prices("9" * 24))
        .when(at == 13, prices("0.1234567890123456789"))
        .otherwise(text)
    )
    return message_texts(spark, sf_dir).withColumn("payload", payload)


def _capture(event_id: Column) -> Column:
    number = F.floor(event_id / CAPTURE_FRAMES).cast("bigint").cast("string")
    return F.concat(F.lit("capture-"), number)


def landed_pages(spark: SparkSession, sf_dir: str) -> str:
    """Folder of raw trades in pages, each of a stretch of time."""
    paged = lambda s, d: raw_trades(s, d).repartitionByRange(12, "time").sortWithinPartitions("time")
    return stored(spark, sf_dir, "pages", paged)


# Frames of a long capture file, which is read in pieces of the second many bytes.
LONG_FRAMES, LONG_PIECE = 20_000, 1 << 16


def long_captures(spark: SparkSession, sf_dir: str) -> str:
    """Folder of capture files of 20,000 frames each, every 101st with a wrong checksum, and one byte
    behind the last: below ``capture=`` and the file's number."""

    def write(folder: str) -> None:
        rows = _capture_files(spark, sf_dir, F.floor(F.col("event_id") / LONG_FRAMES).alias("capture"))
        text = rows.select("capture", F.col("content").cast("string").alias("value"))
        text.write.partitionBy("capture").option("lineSep", "\n").text(folder)

    return _once(spark, sf_dir, "long-captures", write)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture files from ``events``: 500 frames each, every 101st with a wrong checksum."""
    return _capture_files(spark, sf_dir, _capture(F.col("event_id")).alias("path"))


def _capture_files(spark: SparkSession, sf_dir: str, key: Column) -> DataFrame:
    """The frames of each file, joined: the key and ``content``."""
    e = F.col("event_id")
    text = F.concat_ws(":", e.cast("string"), F.col("event_type"), F.col("props"))
    good = frames.encode_frame(text.cast("binary"))
    size = F.octet_length(good)
    bad = F.concat(F.substring(good, F.lit(1), size - 4), F.unhex(F.lit("00000000")))
    rows = table(spark, sf_dir, "events").select(key, e, F.when(e % 101 == 0, bad).otherwise(good).alias("f"))
    name = rows.columns[0]
    return (
        rows.groupBy(name)
        .agg(F.sort_array(F.collect_list(F.struct("event_id", F.hex("f").alias("hex")))).alias("fs"))
        .select(name, F.unhex(F.array_join(F.col("fs.hex"), "")).alias("content"))
    )

"""Queries that run a stream over all stored rows to its end, then read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import schema, session
from tickloom.plans import views
from tickloom.plans.book_queries import BOOK_SQL
from tickloom.plans.lake_queries import NORMALIZE_SQL, normalized_columns
from tickloom.plans.registry import micros, query
from tickloom.plans.views import MESSAGES_SQL, TRADES_SQL
from tickloom.schema import MARKET
from tickloom.sources import paged
from tickloom.streaming import bars, book, ingest, market_state


LATE = "1 hour"


def _finish(stream) -> None:
    stream.awaitTermination()


@query("stream_ingest", NORMALIZE_SQL)
def _(spark, sf):
    landing = views.stored(spark, sf, "landing", views.raw_trades, "json")
    root = session.new_folder(spark, "ingest")
    raw = ingest.landed_stream(spark, landing)
    _finish(ingest.ingest(raw, f"{root}/lake", f"{root}/checkpoint"))
    return ingest.read_write_ahead(spark, f"{root}/lake").select(*normalized_columns())


@query(
    "stream_ohlc_1d",
    f"""WITH {TRADES_SQL}, b AS (SELECT *, time_us // 86400000000 * 86400000000 AS bar_us FROM trades),
    closed AS (SELECT max(time_us) - 3600000000 AS watermark FROM trades)
    SELECT exchange, instrument, bar_us, arg_min(price_int, (time_us, seq)) AS open, max(price_int) AS high,
      min(price_int) AS low, arg_max(price_int, (time_us, seq)) AS close,
      CAST(sum(amount_int) AS BIGINT) AS volume, count(*) AS trades
    FROM b WHERE bar_us + 86400000000 <= (SELECT watermark FROM closed) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    trades = views.stored(spark, sf, "flat_trades", views.trades)
    root = session.new_folder(spark, "bars")
    stream = spark.readStream.schema(schema.TRADES).parquet(trades)
    _finish(bars.ingest_bars(stream, f"{root}/bars", f"{root}/checkpoint", "1d", LATE))
    return bars.read_bars(spark, f"{root}/bars", LATE).where("closed").select(
        *MARKET, micros("bar").alias("bar_us"), "open", "high", "low", "close", "volume", "trades"
    )


@query(
    "stream_ohlc_late",
    f"""WITH {TRADES_SQL} SELECT exchange, instrument, seq, time_us // 86400000000 * 86400000000 AS bar_us
    FROM trades WHERE dayofmonth(make_timestamp(time_us)) = 3 AND seq % 10 = 0""",
)
def _(spark, sf):
    """Trades of a day that land after later days were read: first without them, then with them."""
    root = session.new_folder(spark, "late-bars")
    rows = views.trades(spark, sf)
    held = (F.dayofmonth("time") == 3) & (F.col("seq") % 10 == 0)
    for part in (rows.where(~held), rows.where(held)):
        part.write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(schema.TRADES).parquet(f"{root}/landed")
        _finish(bars.ingest_bars(stream, f"{root}/bars", f"{root}/checkpoint", "1d", LATE))
    return bars.read_late(spark, f"{root}/bars").select(*MARKET, "seq", micros("bar").alias("bar_us"))


def _markets(spark, sf, root, gaps=""):
    messages = views.messages(spark, sf)
    stored = spark.readStream.schema(messages.schema).parquet(views.message_folder(spark, sf))
    rows = stored.select("market_id", F.expr(f"seq{gaps}").alias("seq"), "kind")
    state = book.market_state(rows)
    _finish(book.keep_changes(state, f"{root}/markets", f"{root}/check-markets"))
    return f"{root}/markets"


@query("stream_book_full", f"WITH {BOOK_SQL} SELECT market_id, side, price, amount FROM book")
def _(spark, sf):
    """Four files of messages in each micro-batch."""
    root = session.new_folder(spark, "book")
    messages = views.messages(spark, sf)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 4)
    stream = stream.parquet(views.message_folder(spark, sf))
    parts = lambda batch: (views.levels(batch), views.snapshots(batch))
    _finish(book.ingest_book(stream, parts, f"{root}/book", f"{root}/checkpoint"))
    return book.read_book(spark, f"{root}/book")


@query(
    "stream_seq_missing",
    f"""WITH {MESSAGES_SQL}, g AS (SELECT market_id, seq + seq // 97 AS seq FROM messages)
    SELECT market_id, max(seq) AS last_seq, max(seq) - min(seq) + 1 - count(*) AS missing
    FROM g GROUP BY 1""",
)
def _(spark, sf):
    root = session.new_folder(spark, "gaps")
    kept = spark.read.parquet(_markets(spark, sf, root, gaps=" + seq div 97"))
    return kept.groupBy("market_id").agg(
        F.max("last_seq").alias("last_seq"), F.max_by("missing", "last_seq").alias("missing")
    )


def _late_messages(spark, sf):
    """A stream of messages that come late and some twice, four files in each of three micro-batches."""
    messages = views.messages(spark, sf)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 4)
    return stream.parquet(views.late_message_folder(spark, sf))


@query("stream_book_state", f"WITH {BOOK_SQL} SELECT market_id, side, price, amount FROM book")
def _(spark, sf):
    """The book out of the state store."""
    root = session.new_folder(spark, "book-state")
    messages = _late_messages(spark, sf)
    changes = market_state.book_changes(views.levels(messages), views.snapshots(messages))
    _finish(market_state.start(changes, market_state.keep_batches(f"{root}/changes"), f"{root}/checkpoint"))
    return market_state.kept_book(spark, f"{root}/checkpoint")


@query(
    "stream_seq_gaps",
    f"""WITH {MESSAGES_SQL}, g AS (SELECT market_id, seq + seq // 97 AS seq FROM messages),
    l AS (SELECT market_id, seq, lag(seq) OVER (PARTITION BY market_id ORDER BY seq) AS seq_before FROM g)
    SELECT market_id, seq_before, seq, seq - seq_before - 1 AS missing FROM l WHERE seq <> seq_before + 1""",
)
def _(spark, sf):
    """Gaps that became certain while the stream ran, and those still open at its end."""
    root = session.new_folder(spark, "gap-state")
    gappy = _late_messages(spark, sf).withColumn("seq", F.expr("seq + seq div 97"))
    gaps = market_state.certain_gaps(gappy, slack=2 * views.JITTER)
    _finish(market_state.start(gaps, market_state.keep_batches(f"{root}/gaps"), f"{root}/checkpoint"))
    sent = spark.read.parquet(f"{root}/gaps").where("kind = 'gap'")
    found = sent.select("market_id", "seq_before", "seq", "missing")
    return found.unionByName(market_state.open_gaps(spark, f"{root}/checkpoint"))


PULL = {"since": "2024-01-04 06:00:00", "markets": "alpha:click/eur, beta:view/eur"}
PULL_SQL = """WITH e AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS exchange,
      concat(event_type, '/eur') AS instrument FROM events)
    SELECT exchange, instrument, event_id AS seq, epoch_us(ts) AS time_us, CAST(round(value * 100) AS BIGINT) AS cents FROM e
    WHERE exchange || ':' || instrument IN ('alpha:click/eur', 'beta:view/eur') AND ts >= TIMESTAMP '2024-01-04 06:00:00'"""


def _pulled(rows):
    time_us, cents = F.round(F.col("time") * 1e6).cast("bigint"), F.col("price").cast("decimal(18,2)") * 100
    return rows.select("exchange", "instrument", "seq", time_us.alias("time_us"), cents.cast("bigint").alias("cents"))


@query("source_since", PULL_SQL)
def _(spark, sf):
    """Two markets from a time on, read through the paged source."""
    return _pulled(paged.trades(spark, views.landed_pages(spark, sf), **PULL))


@query("source_pull", PULL_SQL)
def _(spark, sf):
    """The same as a stream, pulled until now."""
    root = session.new_folder(spark, "pulled")
    rows = paged.trades(spark, views.landed_pages(spark, sf), stream=True, **PULL)
    paged.pull(rows, market_state.keep_batches(f"{root}/rows"), f"{root}/checkpoint")
    return _pulled(spark.read.parquet(f"{root}/rows"))

"""Queries on order-book messages and on the file catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import book, book_history, compaction
from tickloom.plans import views
from tickloom.plans.registry import micros, query, rounded, sql_rounded
from tickloom.plans.views import CATALOG_SQL, LEVELS_SQL, MESSAGES_SQL

# Exchange 2, instrument 6 and market 9 are left out, so that an unknown id of each kind occurs.
EXCHANGES = [(0, "alpha"), (1, "beta")]
INSTRUMENTS = [(i, f"i{i}/eur") for i in range(6)]
MARKETS = [(i, f"{['alpha', 'beta', 'gamma'][i % 3]}:m{i}/eur") for i in range(9)]

NOW = "2000-07-15 12:00:00"


def _values(rows) -> str:
    return ", ".join(f"({i}, '{name}')" for i, name in rows)


@query(
    "market_lookup",
    f"""WITH {MESSAGES_SQL}, x AS (SELECT * FROM (VALUES {_values(EXCHANGES)}) AS v(exchange_id, exchange)),
    i AS (SELECT * FROM (VALUES {_values(INSTRUMENTS)}) AS v(instrument_id, instrument)),
    m AS (SELECT * FROM (VALUES {_values(MARKETS)}) AS v(market_id, market))
    SELECT event_id, messages.market_id, exchange, instrument, market FROM messages
    LEFT JOIN x ON messages.exchange_id = x.exchange_id LEFT JOIN m ON messages.market_id = m.market_id
    LEFT JOIN i ON messages.instrument_id = i.instrument_id""",
)
def _(spark, sf):
    exchanges = spark.createDataFrame(EXCHANGES, "exchange_id bigint, exchange string")
    markets = spark.createDataFrame(MARKETS, "market_id bigint, market string")
    instruments = spark.createDataFrame(INSTRUMENTS, "instrument_id bigint, instrument string")
    return book.market_lookup(views.messages(spark, sf), exchanges, instruments, markets).select(
        "event_id", "market_id", "exchange", "instrument", "market"
    )


@query(
    "msg_type_counts",
    f"""WITH {MESSAGES_SQL} SELECT kind, count(*) AS n,
      {sql_rounded("count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()")} AS pct FROM messages GROUP BY 1""",
)
def _(spark, sf):
    return book.kind_counts(views.messages(spark, sf)).withColumn("pct", rounded("pct"))


@query(
    "exchange_counts",
    f"WITH {MESSAGES_SQL} SELECT exchange_id, count(*) AS n FROM messages GROUP BY 1",
)
def _(spark, sf):
    return book.exchange_counts(views.messages(spark, sf))


@query(
    "market_stats",
    f"""WITH {MESSAGES_SQL} SELECT count(*) AS messages, count(DISTINCT exchange_id) AS exchanges,
      count(DISTINCT instrument_id) AS instruments, count(DISTINCT market_id) AS markets FROM messages""",
)
def _(spark, sf):
    return book.market_stats(views.messages(spark, sf))


@query(
    "seq_gaps",
    f"""WITH {MESSAGES_SQL}, g AS (SELECT market_id, seq + seq // 97 AS seq FROM messages),
    l AS (SELECT market_id, seq, lag(seq) OVER (PARTITION BY market_id ORDER BY seq) AS seq_before FROM g)
    SELECT market_id, seq_before, seq, seq - seq_before - 1 AS missing FROM l WHERE seq <> seq_before + 1""",
)
def _(spark, sf):
    # The fixture's numbers have no gaps, so each 97th message makes one.
    gappy = views.messages(spark, sf).withColumn("seq", F.expr("seq + seq div 97"))
    return book.seq_gaps(gappy)


@query(
    "estimate_book_time",
    f"""WITH {MESSAGES_SQL}, t AS (SELECT market_id, seq, kind,
      last_value(time_us IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS time_from,
      first_value(time_us IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY seq
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS time_to FROM messages)
    SELECT *, time_to - time_from AS time_error FROM t""",
)
def _(spark, sf):
    rows = views.messages(spark, sf).select("market_id", "seq", "kind", "time_us")
    return book.estimate_time(rows).drop("time_us")


BOOK_SQL = f"""{MESSAGES_SQL}, {LEVELS_SQL},
  last AS (SELECT market_id, max(seq) AS s FROM messages WHERE kind = 'snapshot' GROUP BY 1),
  book AS (SELECT market_id, side, price, arg_max(amount, seq) AS amount
    FROM levels JOIN last USING (market_id) WHERE seq >= s GROUP BY 1, 2, 3 HAVING arg_max(amount, seq) > 0)"""


def _book(spark, sf):
    messages = views.messages(spark, sf)
    return book.book_full(views.levels(messages), views.snapshots(messages))


@query("book_full", f"WITH {BOOK_SQL} SELECT market_id, side, price, amount FROM book")
def _(spark, sf):
    return _book(spark, sf)


@query(
    "book_spread",
    f"""WITH {BOOK_SQL}, b AS (SELECT market_id, max(price) FILTER (WHERE side = 'bid') AS best_bid,
      min(price) FILTER (WHERE side = 'ask') AS best_ask FROM book GROUP BY 1)
    SELECT *, best_ask - best_bid AS spread FROM b""",
)
def _(spark, sf):
    return book.book_spread(_book(spark, sf))


@query(
    "book_epochs",
    f"""WITH {MESSAGES_SQL}, {LEVELS_SQL},
    n AS (SELECT market_id, seq, CAST(sum(CASE WHEN kind = 'snapshot' THEN 1 ELSE 0 END)
      OVER (PARTITION BY market_id ORDER BY seq) AS BIGINT) AS epoch FROM messages)
    SELECT market_id, epoch, side, price, arg_max(amount, seq) AS amount
    FROM levels JOIN n USING (market_id, seq) WHERE epoch > 0
    GROUP BY 1, 2, 3, 4 HAVING arg_max(amount, seq) > 0""",
)
def _(spark, sf):
    messages = views.messages(spark, sf)
    return book.book_per_epoch(views.levels(messages), views.snapshots(messages))


# -- books at every point ----------------------------------------------------------------

# Levels from the first snapshot on, with what comes next at their price and the next snapshot.
LIVES_SQL = f"""{MESSAGES_SQL}, {LEVELS_SQL},
  snaps AS (SELECT market_id, seq, lead(seq) OVER (PARTITION BY market_id ORDER BY seq) AS until
    FROM messages WHERE kind = 'snapshot'),
  epochs AS (SELECT l.*, until FROM levels l ASOF JOIN snaps s ON l.market_id = s.market_id AND l.seq >= s.seq),
  ahead AS (SELECT *, lead(seq) OVER w AS next_seq, lead(amount) OVER w AS next_amount
    FROM epochs WINDOW w AS (PARTITION BY market_id, side, price ORDER BY seq)),
  lives AS (SELECT market_id, side, price, amount, seq AS seq_from,
      CASE WHEN until <= next_seq OR next_seq IS NULL THEN until ELSE next_seq END AS seq_to,
      CASE WHEN until <= next_seq OR (next_seq IS NULL AND until IS NOT NULL) THEN 'snapshot'
        WHEN next_amount > 0 THEN 'overwrite' WHEN next_seq IS NOT NULL THEN 'removal' END AS closed_by
    FROM ahead WHERE amount > 0)"""


@query("level_lives", f"WITH {LIVES_SQL} SELECT * FROM lives")
def _(spark, sf):
    messages = views.messages(spark, sf)
    return book_history.level_lives(views.levels(messages), views.snapshots(messages))


@query(
    "book_at",
    f"""WITH {LIVES_SQL}, d AS (
      SELECT DISTINCT market_id, time_us // 86400000000 * 86400000000 + 86400000000 AS day_end
      FROM messages WHERE time_us IS NOT NULL),
    p AS (SELECT DISTINCT market_id, (SELECT max(seq) FROM messages m
        WHERE m.market_id = d.market_id AND m.time_us <= day_end) AS seq FROM d)
    SELECT p.market_id, p.seq, side, price, amount FROM p JOIN lives l
    ON p.market_id = l.market_id AND seq_from <= p.seq AND (seq_to IS NULL OR p.seq < seq_to)""",
)
def _(spark, sf):
    """The books of all markets at the end of each of their days."""
    messages = views.messages(spark, sf)
    day_end = F.expr("time_us div 86400000000 * 86400000000 + 86400000000")
    times = messages.where("time_us IS NOT NULL").select("market_id", day_end.alias("time_us")).distinct()
    points = book_history.last_seq_at(messages, times)
    return book_history.book_at(views.levels(messages), views.snapshots(messages), points)


TOP_SQL = f"""{LIVES_SQL},
  bids AS (SELECT a.market_id, a.seq, max(l.price) AS price, arg_max(l.amount, l.price) AS amount
    FROM messages a JOIN lives l ON a.market_id = l.market_id AND l.side = 'bid' AND seq_from <= a.seq
      AND (seq_to IS NULL OR a.seq < seq_to) GROUP BY 1, 2),
  asks AS (SELECT a.market_id, a.seq, min(l.price) AS price, arg_min(l.amount, l.price) AS amount
    FROM messages a JOIN lives l ON a.market_id = l.market_id AND l.side = 'ask' AND seq_from <= a.seq
      AND (seq_to IS NULL OR a.seq < seq_to) GROUP BY 1, 2),
  tops AS (SELECT m.market_id, m.seq, b.price AS best_bid, b.amount AS bid_amount, a.price AS best_ask,
      a.amount AS ask_amount, row(b.price, b.amount, a.price, a.amount) AS now
    FROM messages m JOIN (SELECT market_id, min(seq) AS s FROM snaps GROUP BY 1) f ON f.market_id = m.market_id AND m.seq >= s
      LEFT JOIN bids b ON b.market_id = m.market_id AND b.seq = m.seq
      LEFT JOIN asks a ON a.market_id = m.market_id AND a.seq = m.seq),
  changes AS (SELECT *, lag(now) OVER (PARTITION BY market_id ORDER BY seq) AS before FROM tops)"""


@query(
    "book_top",
    f"""WITH {TOP_SQL} SELECT market_id, seq, best_bid, bid_amount, best_ask, ask_amount,
      best_ask - best_bid AS spread FROM changes WHERE before IS NULL OR now IS DISTINCT FROM before""",
)
def _(spark, sf):
    messages = views.messages(spark, sf)
    return book_history.book_top(views.levels(messages), views.snapshots(messages))


# -- catalog ---------------------------------------------------------------------------

SHADOW_SQL = f"""{CATALOG_SQL}, c AS (SELECT *, max(e) OVER (PARTITION BY market ORDER BY s, e DESC, file_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM catalog),
  k AS (SELECT *, covered IS NULL OR e > covered AS keep FROM c),
  shadowed AS (SELECT *, last_value(CASE WHEN keep THEN file_id END IGNORE NULLS) OVER (PARTITION BY market
    ORDER BY s, e DESC, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shadow_id FROM k)"""


@query(
    "shadowed_files",
    f"""WITH {SHADOW_SQL} SELECT market, file_id, keep,
      CASE WHEN keep THEN epoch_us(CAST(greatest(s, covered) AS TIMESTAMP)) END AS clip_us,
      CASE WHEN NOT keep THEN shadow_id END AS shadow_id FROM shadowed""",
)
def _(spark, sf):
    return compaction.shadowed_files(views.catalog(spark, sf)).select(
        "market", "file_id", "keep", micros("clip_start").alias("clip_us"),
        F.col("shadow.file_id").alias("shadow_id"),
    )


@query(
    "removable_files",
    f"""WITH {SHADOW_SQL} SELECT market, file_id, shadow_id,
      CASE WHEN shadow_id % 20 <= 5 THEN 'fresh' ELSE 'remove' END AS reason
    FROM shadowed WHERE NOT keep""",
)
def _(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    aged = views.catalog(spark, sf).withColumn(
        "modified",
        F.timestamp_micros(F.unix_micros(now) - F.col("file_id") % 20 * F.lit(60_000_000)),
    )
    return compaction.removable_files(aged, now)


TIER_SQL = f"""CASE WHEN s < TIMESTAMP '2000-01-01' THEN 'year' WHEN s < TIMESTAMP '2000-07-01' THEN 'month' ELSE 'day' END AS unit"""
BUCKET_SQL = "CASE unit WHEN 'year' THEN strftime(s, '%Y') WHEN 'month' THEN strftime(s, '%Y-%m') ELSE strftime(s, '%Y-%m-%d') END AS bucket"
DONE_SQL = """CASE unit WHEN 'year' THEN dayofyear(s) = 1 AND e = s + INTERVAL 1 YEAR
    WHEN 'month' THEN day(s) = 1 AND e = s + INTERVAL 1 MONTH
    ELSE s < DATE '2000-07-15' AND e = s + 1 AND file_id % 2 = 0 END AS done"""


def _tiered(spark, sf):
    tier = F.when(F.col("file_id") % 2 == 0, "day").otherwise("file")
    return views.catalog(spark, sf).withColumn("tier", tier)


@query(
    "tier_buckets",
    f"""WITH {CATALOG_SQL}, t AS (SELECT *, {TIER_SQL} FROM catalog)
    SELECT market, file_id, unit, {BUCKET_SQL}, {DONE_SQL} FROM t""",
)
def _(spark, sf):
    tiered = compaction.tier_buckets(_tiered(spark, sf), F.lit(NOW))
    return tiered.select("market", "file_id", "unit", "bucket", "done")


@query(
    "symbol_date_range",
    f"""WITH {CATALOG_SQL} SELECT market, CAST(min(s) AS VARCHAR) AS first_date,
      CAST(max(s) AS VARCHAR) AS last_date FROM catalog GROUP BY 1""",
)
def _(spark, sf):
    return compaction.date_range(views.catalog(spark, sf), ["market"]).select(
        "market", F.col("first_date").cast("string"), F.col("last_date").cast("string")
    )


@query(
    "tier_buckets_newest",
    f"""WITH {CATALOG_SQL}, n AS (SELECT *, max(s) OVER (PARTITION BY market) AS newest FROM catalog)
    SELECT market, file_id, CASE WHEN year(s) < year(newest) THEN strftime(s, '%Y')
      WHEN date_trunc('month', s) < date_trunc('month', newest) THEN strftime(s, '%Y-%m')
      ELSE strftime(s, '%Y-%m-%d') END AS bucket FROM n WHERE s < newest""",
)
def _(spark, sf):
    return compaction.tier_by_newest(views.catalog(spark, sf), ["market"]).select(
        "market", "file_id", "bucket"
    )


@query(
    "compaction_plan",
    f"""WITH {SHADOW_SQL}, t AS (SELECT *, {TIER_SQL} FROM shadowed WHERE keep),
    b AS (SELECT *, {BUCKET_SQL}, {DONE_SQL} FROM t)
    SELECT market, bucket, unit, count(*) AS files, CAST(min(s) AS VARCHAR) AS first_start,
      CAST(max(e) AS VARCHAR) AS "end", arg_min(file_id, (s, file_id)) AS first_file,
      CASE WHEN count(*) = 1 THEN 'rename' ELSE 'merge' END AS action
    FROM b WHERE NOT done GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    plan = compaction.compaction_plan(_tiered(spark, sf), F.lit(NOW))
    return plan.withColumn("first_start", F.col("first_start").cast("string")).withColumn(
        "end", F.col("end").cast("string")
    )

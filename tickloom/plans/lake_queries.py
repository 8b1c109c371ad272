"""Queries on scans, the query builder, ingest and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import files, symbols, timefmt
from tickloom.operators import query as q
from tickloom.operators import runs, series
from tickloom.plans import views
from tickloom.plans.pin import pin
from tickloom.plans.registry import micros, query, rounded, sql_rounded
from tickloom.plans.views import LONG_TRADES_SQL, PAIRS_SQL, TRADES_SQL
from tickloom.sources import catalog, frame_ranges, frames, lake, messages, raw, versions
from tickloom.streaming import ingest


def _all():
    return [
        micros("time").alias("time_us"),
        "time_ns",
        "seq",
        F.col("price.int").alias("price_int"),
        F.col("price.scale").alias("price_scale"),
        F.col("amount.int").alias("amount_int"),
        F.col("amount.scale").alias("amount_scale"),
        "side",
        F.col("order").alias("ord"),
        "extra_json",
        F.col("external_id.prefix").alias("ext_prefix"),
        F.col("external_id.numeric").cast("bigint").alias("ext_numeric"),
        "year",
        "exchange",
        "instrument",
        "source",
    ]


ALL_SQL = """time_us, time_us*1000 AS time_ns, seq, price_int, CAST(2 AS INTEGER) AS price_scale,
  amount_int, CAST(0 AS INTEGER) AS amount_scale, side, ord, CAST(NULL AS VARCHAR) AS extra_json,
  'ev' AS ext_prefix, seq AS ext_numeric, yr AS year, exchange, instrument, source"""


def _builder():
    return q.QueryBuilder().trades()


def _trades(spark, sf):
    return views.lake_of(spark, sf, "trades")


def _long(spark, sf):
    return views.lake_of(spark, sf, "long_trades")


@query("scan_trades", f"WITH {TRADES_SQL} SELECT {ALL_SQL} FROM trades")
def _(spark, sf):
    return lake.trades(spark, _trades(spark, sf)).select(*_all())


@query("q_trades", f"WITH {TRADES_SQL} SELECT {ALL_SQL} FROM trades")
def _(spark, sf):
    return _builder().run(spark, _trades(spark, sf)).select(*_all())


@query(
    "q_columns",
    f"""WITH {TRADES_SQL} SELECT time_us, price_int, CAST(2 AS INTEGER) AS price_scale, source
    FROM trades""",
)
def _(spark, sf):
    rows = _builder().columns("source", "price", "time", "time").run(spark, _trades(spark, sf))
    return rows.select(
        micros("time").alias("time_us"),
        F.col("price.int").alias("price_int"),
        F.col("price.scale").alias("price_scale"),
        "source",
    )


@query("q_sources", f"WITH {TRADES_SQL} SELECT seq, source FROM trades WHERE source = 'src_ws'")
def _(spark, sf):
    return _builder().columns("seq", "source").sources("src_ws").run(spark, _trades(spark, sf))


@query(
    "q_markets",
    f"""WITH {TRADES_SQL} SELECT seq, exchange, instrument FROM trades
    WHERE (exchange = 'alpha' AND instrument = 'click/eur')
       OR (exchange = 'beta' AND instrument = 'view/eur')""",
)
def _(spark, sf):
    return (
        _builder().columns("seq", "exchange", "instrument")
        .markets("alpha:click/eur", "beta:view/eur").run(spark, _trades(spark, sf))
    )


@query(
    "q_markets_wildcard",
    f"""WITH {TRADES_SQL} SELECT seq, exchange, instrument FROM trades
    WHERE exchange = 'alpha' OR instrument = 'view/eur'""",
)
def _(spark, sf):
    return (
        _builder().columns("seq", "exchange", "instrument")
        .markets(["alpha:*", "*:view/eur"]).run(spark, _trades(spark, sf))
    )


@query(
    "q_exchanges_instruments",
    f"""WITH {TRADES_SQL} SELECT seq, exchange, instrument FROM trades
    WHERE exchange IN ('alpha','gamma') AND instrument IN ('click/eur','error/eur')""",
)
def _(spark, sf):
    return (
        _builder().columns("seq", "exchange", "instrument")
        .exchanges("alpha", "gamma").instruments("click/eur", "error/eur")
        .run(spark, _trades(spark, sf))
    )


@query(
    "q_time_range",
    f"""WITH {TRADES_SQL} SELECT time_us, seq, exchange FROM trades
    WHERE time_us >= epoch_us(TIMESTAMP '2024-01-05 06:30:00')
      AND time_us < epoch_us(TIMESTAMP '2024-01-20 18:00:00.5')""",
)
def _(spark, sf):
    rows = (
        _builder().columns("time", "seq", "exchange")
        .start("2024-01-05T06:30Z").end("2024-01-20T18:00:00.5Z").run(spark, _trades(spark, sf))
    )
    return rows.select(micros("time").alias("time_us"), "seq", "exchange")


@query(
    "q_period_quarter",
    f"""WITH {LONG_TRADES_SQL} SELECT time_us, seq, yr AS year FROM long_trades
    WHERE time_us >= epoch_us(TIMESTAMP '1996-07-01') AND time_us < epoch_us(TIMESTAMP '1996-10-01')""",
)
def _(spark, sf):
    rows = _builder().columns("time", "seq", "year").period("1996Q3").run(spark, _long(spark, sf))
    return rows.select(micros("time").alias("time_us"), "seq", "year")


@query(
    "q_period_range",
    f"""WITH {LONG_TRADES_SQL} SELECT time_us, seq, yr AS year FROM long_trades
    WHERE time_us >= epoch_us(TIMESTAMP '1996-05-15') AND time_us < epoch_us(TIMESTAMP '1997-07-16')""",
)
def _(spark, sf):
    rows = (
        _builder().columns("time", "seq", "year").period("1996-05-15/1997-07-15")
        .run(spark, _long(spark, sf))
    )
    return rows.select(micros("time").alias("time_us"), "seq", "year")


@query(
    "q_combined",
    f"""WITH {LONG_TRADES_SQL} SELECT time_us, seq, price_int, exchange, instrument FROM long_trades
    WHERE source = 'src_rest' AND (instrument = 'btc/eur' OR (exchange = 'gamma' AND instrument = 'eth/eur'))
      AND yr = 1998""",
)
def _(spark, sf):
    rows = (
        _builder().columns("time", "seq", "price", "exchange", "instrument")
        .sources("src_rest").markets("*:btc/eur", "gamma:eth/eur").period("1998")
        .run(spark, _long(spark, sf))
    )
    return rows.select(
        micros("time").alias("time_us"), "seq", F.col("price.int").alias("price_int"),
        "exchange", "instrument",
    )


@query(
    "q_count",
    f"WITH {TRADES_SQL} SELECT count(*) AS n FROM trades WHERE exchange = 'beta'",
)
def _(spark, sf):
    return q.count_rows(_builder().exchanges("beta").run(spark, _trades(spark, sf)))


@query(
    "q_decimals_as_floats",
    f"""WITH {TRADES_SQL} SELECT seq, {sql_rounded("p")} AS price,
      CAST(amount_int AS DOUBLE) AS amount, {sql_rounded("time_us / 1e6")} AS time_s FROM trades""",
)
def _(spark, sf):
    rows = _builder().columns("time_ns", "seq", "price", "amount").run(spark, _trades(spark, sf))
    values = q.to_numbers(rows, decimals_as_floats=True, timestamps_as_floats=True)
    return values.select(
        "seq", rounded("price").alias("price"), "amount", rounded("time_s").alias("time_s")
    )


@query(
    "q_start_only",
    f"""WITH {TRADES_SQL} SELECT seq, time_us FROM trades
    WHERE make_timestamp(time_us) >= TIMESTAMP '2024-01-15 06:00:00'""",
)
def _(spark, sf):
    builder = _builder().markets("alpha:*").period("2023").start("2024-01-15 06:00").reset("end", "markets")
    return builder.run(spark, _trades(spark, sf)).select("seq", micros("time").alias("time_us"))


@query(
    "q_timestamps_as_floats",
    f"WITH {TRADES_SQL} SELECT seq, time_us * 1000 / 1e9::DOUBLE AS time_s, price_int AS price FROM trades",
)
def _(spark, sf):
    rows = _builder().columns("time_ns", "seq", "price").run(spark, _trades(spark, sf))
    return q.to_numbers(rows, timestamps_as_floats=True).select("seq", "time_s", "price")


@query(
    "last_n",
    f"""WITH {TRADES_SQL} SELECT time_us, seq, price_int FROM trades
    WHERE exchange = 'alpha' ORDER BY time_us DESC, seq DESC LIMIT 1000""",
)
def _(spark, sf):
    rows = _builder().exchanges("alpha").run(spark, _trades(spark, sf))
    return q.last_rows(rows.select("time", "time_ns", "seq", "price"), 1000).select(
        micros("time").alias("time_us"), "seq", F.col("price.int").alias("price_int")
    )


@query(
    "first_n",
    f"""WITH {TRADES_SQL} SELECT time_us, seq, price_int FROM trades
    WHERE exchange = 'alpha' ORDER BY time_us, seq LIMIT 1000""",
)
def _(spark, sf):
    rows = _builder().exchanges("alpha").run(spark, _trades(spark, sf))
    return q.first_rows(rows.select("time", "time_ns", "seq", "price"), 1000).select(
        micros("time").alias("time_us"), "seq", F.col("price.int").alias("price_int")
    )


# -- normalizing -----------------------------------------------------------------------


NORMALIZE_SQL = """WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k,
      CASE WHEN event_type = 'view' THEN 5 ELSE 1 END AS price_scale,
      CASE WHEN event_id % 3 = 2 THEN 'x' END AS bad_side,
      CASE WHEN event_id % 5 = 0 THEN 'x' END AS bad_order,
      CASE WHEN event_id % 4 = 0 THEN 'note' END AS misc FROM events),
    f AS (SELECT *, CAST(floor(t) AS BIGINT) AS whole,
      CAST((t - floor(t)) * 4294967296 AS BIGINT) * 100000 AS units FROM e),
    g AS (SELECT *, units // 4294967296 AS quot, units % 4294967296 AS rest FROM f)
    SELECT event_id AS seq,
      whole * 1000000000 + (quot + CASE WHEN rest > 2147483648 OR (rest = 2147483648 AND quot % 2 = 1)
        THEN 1 ELSE 0 END) * 10000 AS time_ns,
      CAST(CASE WHEN price_scale = 5 THEN round(value * 100) * 1000
           ELSE floor(round(value * 100) / 10) END AS BIGINT) AS price_int,
      price_scale, k * 100000000 AS amount_int, CAST(8 AS INTEGER) AS amount_scale,
      CASE event_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' END AS side,
      CASE event_id % 5 WHEN 1 THEN 'market' WHEN 2 THEN 'limit' WHEN 3 THEN 'market'
           WHEN 4 THEN 'limit' END AS ord,
      CASE WHEN bad_side IS NOT NULL OR bad_order IS NOT NULL OR misc IS NOT NULL THEN
        '{"src_rest":{' || concat_ws(',',
          CASE WHEN bad_side IS NOT NULL THEN '"side":"x"' END,
          CASE WHEN bad_order IS NOT NULL THEN '"order":"x"' END,
          CASE WHEN misc IS NOT NULL THEN '"misc":"note"' END) || '}}' END AS extra_json
    FROM g"""


def normalized_columns():
    return [
        "seq",
        "time_ns",
        F.col("price.int").alias("price_int"),
        F.col("price.scale").alias("price_scale"),
        F.col("amount.int").alias("amount_int"),
        F.col("amount.scale").alias("amount_scale"),
        "side",
        F.col("order").alias("ord"),
        "extra_json",
    ]


@query("normalize_trades", NORMALIZE_SQL)
def _(spark, sf):
    return raw.normalize(views.raw_trades(spark, sf)).select(*normalized_columns())


@query(
    "ingest_rejects",
    """WITH e AS (SELECT event_id AS seq,
      CASE WHEN event_id % 70 = 3 THEN 'time' WHEN event_id % 50 = 4 THEN 'price.int'
           WHEN event_id % 90 = 5 THEN 'amount.int' END AS reason,
      CASE WHEN event_id % 50 = 4 THEN 'abc' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS price,
      CASE WHEN event_id % 90 = 5 THEN repeat('9', 24) ELSE json_extract_string(props,'$.k') END AS amount
      FROM events)
    SELECT * FROM e WHERE reason IS NOT NULL""",
)
def _(spark, sf):
    return raw.rejects(views.spoiled_raw_trades(spark, sf)).select("seq", "reason", "price", "amount")


@query(
    "conform_trades",
    """SELECT epoch_us(ts) AS time_us, event_id AS seq, CAST(round(value*100) AS BIGINT) AS price_int,
      CAST(2 AS INTEGER) AS price_scale, CAST(json_extract_string(props,'$.k') AS BIGINT) AS amount_int,
      CASE event_id % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' END AS side,
      CASE WHEN event_id % 4 = 0 THEN props END AS extra_json,
      concat(event_type, '/eur') AS instrument, CAST(year(ts) AS INTEGER) AS year FROM events""",
)
def _(spark, sf):
    return raw.conform(views.stored_trades(spark, sf)).select(
        micros("time").alias("time_us"),
        "seq",
        F.col("price.int").alias("price_int"),
        F.col("price.scale").alias("price_scale"),
        F.col("amount.int").alias("amount_int"),
        "side",
        "extra_json",
        "instrument",
        "year",
    )


@query(
    "lake_round_trip",
    f"""WITH {TRADES_SQL} SELECT time_us, seq, price_int, amount_int, side, yr AS year, exchange, instrument
    FROM trades""",
)
def _(spark, sf):
    """Rows of the older shape, written to a lake and read back."""
    def build(root):
        lake.write(raw.conform(views.stored_trades(spark, sf)), root, files=8)

    rows = lake.trades(spark, views._once(spark, sf, "round-trip", build))
    return rows.select(
        micros("time").alias("time_us"), "seq", F.col("price.int").alias("price_int"),
        F.col("amount.int").alias("amount_int"), "side", "year", "exchange", "instrument",
    )


@query(
    "conform_nested",
    f"""WITH {TRADES_SQL} SELECT time_us, seq, price_int, CAST(2 AS INTEGER) AS price_scale, amount_int,
      CASE WHEN seq % 3 = 1 THEN 'ev' END AS prefix, CASE WHEN seq % 3 = 0 THEN seq END AS number,
      exchange, instrument FROM trades""",
)
def _(spark, sf):
    """Rows of the shape with nested decimals and ids."""
    rows = raw.conform_nested(views.nested_trades(spark, sf))
    return rows.select(
        micros("time").alias("time_us"), "seq", F.col("price.int").alias("price_int"),
        F.col("price.scale").alias("price_scale"), F.col("amount.int").alias("amount_int"),
        F.col("external_id.prefix").alias("prefix"),
        F.col("external_id.numeric").cast("bigint").alias("number"), "exchange", "instrument",
    )


@query(
    "instrument_dim",
    f"""WITH {PAIRS_SQL} SELECT DISTINCT concat(base, '/', quote) AS instrument, base, quote
    FROM pairs""",
)
def _(spark, sf):
    return raw.instrument_dim(views.pairs(spark, sf))


@query(
    "asset_dim",
    f"WITH {PAIRS_SQL} SELECT base AS asset FROM pairs UNION SELECT quote FROM pairs",
)
def _(spark, sf):
    return raw.asset_dim(views.pairs(spark, sf))


@query(
    "market_dim",
    f"""WITH {PAIRS_SQL} SELECT DISTINCT 'alpha' AS exchange, concat(base, '/', quote) AS instrument,
      concat('alpha:', base, '/', quote) AS market FROM pairs""",
)
def _(spark, sf):
    return raw.market_dim(views.pairs(spark, sf), "alpha")


# -- batches and days ------------------------------------------------------------------


@query(
    "rebatch",
    f"""WITH {TRADES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY exchange, instrument
      ORDER BY time_us, seq) - 1 AS rn FROM trades)
    SELECT exchange, instrument, CAST(rn // 250 AS BIGINT) AS batch, count(*) AS n,
      min(seq) AS first_seq, max(seq) AS last_seq FROM n GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    rows = views.trades(spark, sf).select("exchange", "instrument", "time_ns", "seq")
    return (
        series.batches(series.cut(rows), 250)
        .groupBy("exchange", "instrument", "batch")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
        )
    )


DAYS_SQL = """SELECT exchange, instrument, time_us // 86400000000 AS d, count(*) AS n,
      min(time_us) * 1000 AS first_ns, max(time_us) * 1000 AS last_ns,
      greatest(time_us // 86400000000 * 86400000000, epoch_us(TIMESTAMP '2024-01-01 00:00:05')) * 1000 AS start_ns,
      least((time_us // 86400000000 + 1) * 86400000000, epoch_us(TIMESTAMP '2024-01-30 23:59:59')) * 1000 AS end_ns
    FROM trades GROUP BY ALL"""


def _days(spark, sf):
    start = F.lit(timefmt.instant("2024-01-01 00:00:05").value)
    end = F.lit(timefmt.instant("2024-01-30 23:59:59").value)
    return runs.split_per_day(
        views.trades(spark, sf), ["exchange", "instrument"], start, end
    )


@query(
    "split_per_day",
    f"""WITH {TRADES_SQL}, days AS ({DAYS_SQL})
    SELECT exchange, instrument, CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS VARCHAR) AS day,
      n AS rows, first_ns, last_ns, start_ns, end_ns FROM days""",
)
def _(spark, sf):
    return _days(spark, sf).withColumn("day", F.col("day").cast("string"))


@query(
    "high_watermark",
    f"""WITH {TRADES_SQL}, days AS ({DAYS_SQL}),
    since AS (SELECT exchange, instrument, max(end_ns) AS since_ns FROM days
      WHERE d < date_diff('day', DATE '1970-01-01', DATE '2024-01-16') GROUP BY 1, 2)
    SELECT t.exchange, t.instrument, t.seq, t.time_us FROM trades t
    LEFT JOIN since s ON t.exchange = s.exchange AND t.instrument = s.instrument
    WHERE t.time_us * 1000 >= coalesce(s.since_ns, t.time_us * 1000)""",
)
def _(spark, sf):
    ended = _days(spark, sf).where(F.col("day") < F.lit("2024-01-16").cast("date"))
    landed = views.trades(spark, sf).select("exchange", "instrument", "seq", "time_ns")
    return ingest.after_watermark(landed, ingest.high_watermark(ended)).select(
        "exchange", "instrument", "seq", F.expr("time_ns div 1000").alias("time_us")
    )


@query(
    "partition_runs",
    """WITH r AS (SELECT event_id // 1000 AS batch_id, event_id AS seq, epoch_us(ts) AS time_us,
      CASE user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS exchange,
      CASE event_id // 7 % 2 WHEN 0 THEN 'trades' ELSE 'quotes' END AS subject,
      CASE WHEN user_id % 4 = 0 THEN 'src_ws' ELSE 'src_rest' END AS source, event_type || '/eur' AS instrument,
      epoch_us(ts) // 86400000000 AS d FROM events),
    m AS (SELECT *, CASE WHEN lag((exchange, subject, source, instrument, d)) OVER w = (exchange, subject, source, instrument, d)
        THEN 0 ELSE 1 END AS new
      FROM r WINDOW w AS (PARTITION BY batch_id ORDER BY seq)),
    n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY batch_id ORDER BY seq) AS BIGINT) AS run FROM m)
    SELECT batch_id, run, subject, source, exchange, instrument,
      CAST(DATE '1970-01-01' + CAST(d AS INTEGER) AS VARCHAR) AS day,
      min(time_us) * 1000 AS first_time_ns, min(seq) AS first_seq, count(*) AS rows
    FROM n GROUP BY batch_id, run, subject, source, exchange, instrument, d""",
)
def _(spark, sf):
    records = views.trades(spark, sf).select(
        F.expr("seq div 1000").alias("batch_id"),
        "seq",
        "time_ns",
        views.pick(F.floor(F.col("seq") / 7) % 2, "trades", "quotes").alias("subject"),
        "source",
        "exchange",
        "instrument",
    )
    return runs.partition_runs(records).select(
        "batch_id", "run", "subject", "source", "exchange", "instrument",
        F.col("day").cast("string").alias("day"),
        "first_time_ns", "first_seq", "rows",
    )


# -- functions -------------------------------------------------------------------------


@query(
    "validate_symbols",
    """WITH t AS (SELECT c_name AS text FROM customer UNION SELECT c_mktsegment FROM customer
      UNION SELECT concat(event_type, '/eur') FROM events UNION SELECT event_type FROM events
      UNION SELECT lower(n_name) FROM nation UNION SELECT 'ohlc:1h' FROM region)
    SELECT text, regexp_full_match(text, '(?i)[a-z]\\w*[a-z]') AS is_source,
      regexp_full_match(text, '(?i)[a-z][a-z0-9\\-]*[a-z]') AS is_exchange,
      regexp_full_match(text, '(?i)[a-z][a-z0-9\\-]*[a-z]/[a-z][a-z0-9\\-]*[a-z](?:/[a-z][a-z0-9\\-]*[a-z0-9])?') AS is_instrument,
      regexp_full_match(text, '[a-z][a-z0-9]*(?:-[a-z][a-z0-9]*)*') AS is_symbol,
      text IN ('trades','ohlc:1m','ohlc:1h','ohlc:1d','book:full','book:spread','book:diff') AS is_subject
    FROM t""",
)
def _(spark, sf):
    def texts(name, column):
        return views.table(spark, sf, name).select(column.alias("text"))

    t = (
        texts("customer", F.col("c_name"))
        .union(texts("customer", F.col("c_mktsegment")))
        .union(texts("events", F.concat("event_type", F.lit("/eur"))))
        .union(texts("events", F.col("event_type")))
        .union(texts("nation", F.lower("n_name")))
        .union(texts("region", F.lit("ohlc:1h")))
        .distinct()
    )
    text = F.col("text")
    return t.select(
        "text",
        symbols.matches(text, symbols.SOURCE, any_case=True).alias("is_source"),
        symbols.matches(text, symbols.WORD, any_case=True).alias("is_exchange"),
        symbols.matches(text, symbols.INSTRUMENT, any_case=True).alias("is_instrument"),
        symbols.is_symbol(text).alias("is_symbol"),
        symbols.is_subject(text).alias("is_subject"),
    )


@query(
    "fn_symbols",
    """WITH t AS (SELECT event_id, concat(CASE user_id % 3 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'beta' ELSE 'gamma-x' END,
        CASE WHEN event_id % 7 = 0 THEN '' ELSE ':' END, upper(event_type),
        CASE WHEN event_id % 11 = 0 THEN '' ELSE '/eur' END,
        CASE WHEN event_id % 5 = 0 THEN '/future-q3' ELSE '' END) AS text FROM events),
    p AS (SELECT event_id, text, string_split(lower(text), ':') AS m FROM t),
    i AS (SELECT *, CASE WHEN len(m) = 2 AND len(string_split(m[2], '/')) IN (2, 3)
      THEN string_split(m[2], '/') END AS parts FROM p)
    SELECT event_id, text, CASE WHEN parts IS NOT NULL THEN m[1] END AS exchange,
      CASE WHEN parts IS NOT NULL THEN m[2] END AS instrument, parts[1] AS base, parts[2] AS quote,
      parts[3] AS extension, CASE WHEN parts IS NOT NULL THEN lower(text) END AS market,
      CASE WHEN parts IS NOT NULL THEN replace(m[2], '/', '_') END AS stored FROM i""",
)
def _(spark, sf):
    e = F.col("event_id")
    text = F.concat(
        views.pick(F.col("user_id") % 3, "Alpha", "beta", "gamma-x"),
        F.when(e % 7 == 0, "").otherwise(":"),
        F.upper("event_type"),
        F.when(e % 11 == 0, "").otherwise("/eur"),
        F.when(e % 5 == 0, "/future-q3").otherwise(""),
    )
    split = (
        views.table(spark, sf, "events")
        .select("event_id", text.alias("text"))
        .withColumn("m", symbols.split_market(F.col("text")))
        .withColumn("i", symbols.split_instrument(F.col("m.instrument")))
    )
    joined = symbols.join_instrument(F.col("i.base"), F.col("i.quote"), F.col("i.extension"))
    known = F.col("i").isNotNull()
    return split.select(
        "event_id",
        "text",
        "m.*",
        "i.*",
        F.when(known, symbols.join_market(F.col("m.exchange"), joined)).alias("market"),
        symbols.to_path(F.col("m.instrument")).alias("stored"),
    )


# Times cut to a unit by event_id % 7, so that every short form occurs.
_CUTS = ["year", "month", "day", "hour", "minute", "second"]


@query(
    "fn_time",
    """WITH t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN date_trunc('year', ts) WHEN 1 THEN date_trunc('month', ts)
        WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN date_trunc('hour', ts) WHEN 4 THEN date_trunc('minute', ts)
        WHEN 5 THEN date_trunc('second', ts) ELSE ts END AS ts,
        CASE WHEN event_id % 7 = 6 THEN event_id % 1000 ELSE 0 END AS below FROM events),
    u AS (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS sec,
      CASE WHEN below > 0 THEN strftime(ts, '.%f') || lpad(CAST(below AS VARCHAR), 3, '0')
           WHEN epoch_us(ts) % 1000000 > 0 THEN strftime(ts, '.%f') ELSE '' END AS part FROM t)
    SELECT event_id, epoch_us(ts) * 1000 + below AS time_ns,
      replace(replace(replace(replace(replace(replace(sec || part || 'Z', ':00Z','Z'), ':00Z','Z'),
        'T00Z','Z'), '-01Z','Z'), '-01Z','Z'), '@', '@') AS short,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || lpad(CAST(below AS VARCHAR), 3, '0') || 'Z' AS full_text,
      strftime(ts, '%Y') AS y, strftime(ts, '%Y-%m') AS ym, strftime(ts, '%Y-%m-%d') AS ymd,
      CAST(year(ts) AS INTEGER) AS part_year, CAST(month(ts) AS INTEGER) AS part_month,
      CAST(day(ts) AS INTEGER) AS part_day, epoch_us(ts) AS parsed_us
    FROM u""",
)
def _(spark, sf):
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    cut = F.coalesce(
        *[F.when(e % 7 == i, F.date_trunc(unit, ts)) for i, unit in enumerate(_CUTS)], ts
    )
    below = F.when(e % 7 == 6, e % 1000).otherwise(0)
    t = pin(views.table(spark, sf, "events"), time_ns=F.unix_micros(cut) * 1000 + below)
    ns = F.col("time_ns")
    day = timefmt.calendar_text(ns, "day")
    return (
        pin(t, short=timefmt.iso_short(ns), parts=timefmt.calendar_parts(day))
        .select(
            "event_id",
            "time_ns",
            "short",
            timefmt.iso_full(ns).alias("full_text"),
            timefmt.calendar_text(ns, "year").alias("y"),
            timefmt.calendar_text(ns, "month").alias("ym"),
            day.alias("ymd"),
            F.col("parts.year").alias("part_year"),
            F.col("parts.month").alias("part_month"),
            F.col("parts.day").alias("part_day"),
            micros(timefmt.parse_time(F.col("short"))).alias("parsed_us"),
        )
    )


@query(
    "fn_period",
    """WITH t AS (SELECT o_orderkey, o_orderkey % 7 AS form, CAST(o_orderdate AS DATE) AS d FROM orders),
    u AS (SELECT *, CASE form WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('quarter', d)
        WHEN 2 THEN date_trunc('month', d) WHEN 6 THEN NULL ELSE d END::TIMESTAMP AS s,
      CASE form WHEN 0 THEN date_trunc('year', d) + INTERVAL 1 YEAR
        WHEN 1 THEN date_trunc('quarter', d) + INTERVAL 3 MONTH
        WHEN 2 THEN date_trunc('month', d) + INTERVAL 1 MONTH WHEN 3 THEN d + INTERVAL 1 DAY
        WHEN 4 THEN d + INTERVAL 41 DAY WHEN 5 THEN d + INTERVAL 10 DAY + INTERVAL 930 MINUTE END::TIMESTAMP AS e FROM t),
    x AS (SELECT *, strftime(s, '%Y-%m-%dT%H:%M:%S.%f000Z') || '/' || strftime(e, '%Y-%m-%dT%H:%M:%S.%f000Z') AS whole FROM u)
    SELECT o_orderkey, CASE form WHEN 0 THEN strftime(d, '%Y')
        WHEN 1 THEN strftime(d, '%Y') || 'Q' || CAST(quarter(d) AS VARCHAR) WHEN 2 THEN strftime(d, '%Y-%m')
        WHEN 3 THEN strftime(d, '%Y-%m-%d') WHEN 4 THEN strftime(d, '%Y-%m-%d') || '/' || strftime(d + 40, '%Y-%m-%d')
        WHEN 5 THEN strftime(d, '%Y-%m-%d') || '/' || strftime(d + 10, '%Y-%m-%d') || ' 15:30' ELSE 'never' END AS text,
      epoch_us(s) AS start_us, epoch_us(e) AS end_us,
      CASE form WHEN 0 THEN strftime(s, '%Y') WHEN 2 THEN strftime(s, '%Y-%m')
        WHEN 3 THEN strftime(s, '%Y-%m-%d') ELSE whole END AS label,
      form = 0 AS is_year, form = 2 AS is_month, form = 3 AS is_day
    FROM x""",
)
def _(spark, sf):
    day = F.to_date("o_orderdate")
    form = F.col("o_orderkey") % 7

    def iso(d, pattern="yyyy-MM-dd"):
        return F.date_format(d, pattern)

    text = F.coalesce(
        F.when(form == 0, iso(day, "yyyy")),
        F.when(form == 1, F.concat(iso(day, "yyyy"), F.lit("Q"), F.quarter(day).cast("string"))),
        F.when(form == 2, iso(day, "yyyy-MM")),
        F.when(form == 3, iso(day)),
        F.when(form == 4, F.concat_ws("/", iso(day), iso(F.date_add(day, 40)))),
        F.when(
            form == 5, F.concat(iso(day), F.lit("/"), iso(F.date_add(day, 10)), F.lit(" 15:30"))
        ),
        F.lit("never"),
    )
    texts = pin(views.table(spark, sf, "orders"), text=text).select("o_orderkey", "text")
    ends = timefmt.periods(texts, "text")
    spans = pin(ends, start_us=micros("start"), end_us=micros("end")).drop("start", "end")
    s, e = F.col("start_us") * 1000, F.col("end_us") * 1000
    no = F.lit(False)
    return spans.select(
        "*",
        F.when(F.col("start_us").isNotNull(), timefmt.span_text(s, e)).alias("label"),
        F.coalesce(timefmt.is_unit(s, e, "year"), no).alias("is_year"),
        F.coalesce(timefmt.is_unit(s, e, "month"), no).alias("is_month"),
        F.coalesce(timefmt.is_unit(s, e, "day"), no).alias("is_day"),
    )


# -- files -----------------------------------------------------------------------------

_FILES_SQL = """files AS (
  SELECT o_orderkey AS k, o_orderkey % 11 = 0 AS bad, CASE o_orderstatus WHEN 'P' THEN 'alpha' WHEN 'F' THEN 'beta' ELSE 'gamma' END AS exchange,
    CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'btc' WHEN '2' THEN 'eth' WHEN '3' THEN 'ada'
      WHEN '4' THEN 'dot' ELSE 'xrp' END || '/eur' AS instrument,
    CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' ELSE 'timestamp' END AS time_kind,
    CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m')
      WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
      ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || 'Z' END AS time
  FROM orders)"""


def _paths(spark, sf):
    """Paths of a positional lake, one per order; every 11th lies in a wrong year's folder."""
    rows = views.long_trades(spark, sf).select(
        "seq", "exchange", "instrument", (F.col("time_ns") + F.col("seq") % 1000).alias("ns")
    )
    k = F.col("seq")
    time = F.coalesce(
        F.when(k % 4 == 0, timefmt.calendar_text(F.col("ns"), "year")),
        F.when(k % 4 == 1, timefmt.calendar_text(F.col("ns"), "month")),
        F.when(k % 4 == 2, timefmt.calendar_text(F.col("ns"), "day")),
        timefmt.iso_full(F.col("ns")),
    )
    path = files.positional_path(
        F.lit("trades"), F.lit("src-rest"), F.col("exchange"), F.col("instrument"), F.col("t")
    )
    right = pin(pin(rows, t=time), right=path)
    wrong = F.regexp_replace("right", r"/\d{4}/", "/1900/")
    whole = F.concat(F.lit("/lake/"), F.when(k % 11 == 0, wrong).otherwise(F.col("right")))
    return pin(right, path=whole).select(k.alias("k"), "path")


@query(
    "file_catalog",
    f"""WITH {_FILES_SQL} SELECT k, 'trades:src-rest:' || exchange || ':' || instrument || ':' || time AS file_id,
      'trades' AS subject, 'src-rest' AS source, exchange, instrument, time, time_kind
    FROM files WHERE NOT bad""",
)
def _(spark, sf):
    return catalog.parse_catalog(_paths(spark, sf), "trades").drop("path").orderBy("file_id")


@query(
    "catalog_merge",
    f"""WITH {_FILES_SQL} SELECT 'trades:src-rest:' || exchange || ':' || instrument || ':' || time AS file_id,
      CASE WHEN time_kind = 'timestamp' THEN 'wal' ELSE 'data' END AS kind, k FROM files WHERE NOT bad""",
)
def _(spark, sf):
    listed = catalog.parse_catalog(_paths(spark, sf)).select("file_id", "time_kind", "k")
    fresh = F.col("time_kind") == "timestamp"
    return catalog.merge_catalogs(listed.where(~fresh), listed.where(fresh)).drop("time_kind")


_HIVE = "CASE form WHEN 0 THEN date_trunc('year', d) WHEN 1 THEN date_trunc('month', d) ELSE d END::TIMESTAMP"
_HIVE_END = """CASE form WHEN 0 THEN date_trunc('year', d) + INTERVAL 1 YEAR
    WHEN 1 THEN date_trunc('month', d) + INTERVAL 1 MONTH WHEN 2 THEN d + INTERVAL 1 DAY
    ELSE d + CAST(2 + k % 26 AS INTEGER) END::TIMESTAMP"""


@query(
    "hive_catalog",
    f"""WITH {LONG_TRADES_SQL}, t AS (SELECT seq AS k, seq % 4 AS form, exchange, instrument,
      CAST(make_timestamp(time_us) AS DATE) AS d FROM long_trades),
    r AS (SELECT *, {_HIVE} AS s, {_HIVE_END} AS e FROM t)
    SELECT k, exchange || ':' || instrument AS market, 'src_rest' AS source, epoch_us(s) AS s_us, epoch_us(e) AS e_us,
      CASE form WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' ELSE 'file' END AS tier
    FROM r WHERE k % 13 <> 0""",
)
def _(spark, sf):
    k, form = F.col("seq"), F.col("seq") % 4
    day = F.date_trunc("day", "time")
    start = (
        F.when(form == 0, F.date_trunc("year", day))
        .when(form == 1, F.date_trunc("month", day))
        .otherwise(day)
    )
    end = (
        F.when(form == 0, F.col("start") + F.expr("interval 1 year"))
        .when(form == 1, F.col("start") + F.expr("interval 1 month"))
        .when(form == 2, F.col("start") + F.expr("interval 1 day"))
        .otherwise(F.date_add("start", (2 + k % 26).cast("int")).cast("timestamp"))
    )
    rows = pin(views.long_trades(spark, sf), start=start).select(
        k, "exchange", "instrument", F.unix_micros("start").alias("a"), F.unix_micros(end).alias("b")
    )
    path = files.hive_path(
        F.lit("trades"), F.lit("src_rest"), F.col("exchange"), F.col("instrument"),
        F.col("a") * 1000, F.col("b") * 1000, short=True,
    )
    right = pin(rows, right=path)
    # Every 13th path lies in a wrong exchange's folder.
    wrong = F.regexp_replace("right", "exchange=[a-z]+", "exchange=other")
    moved = F.concat(F.lit("/lake/"), F.when(k % 13 == 0, wrong).otherwise(F.col("right")))
    paths = pin(right, path=moved).select(k, "path")

    return files.parse_hive_paths(paths).select(
        k.alias("k"),
        symbols.join_market(F.col("exchange"), F.col("instrument")).alias("market"),
        "source",
        micros("s").alias("s_us"),
        micros("e").alias("e_us"),
        "tier",
    )


# -- captures --------------------------------------------------------------------------


@query(
    "frames_valid",
    """SELECT 'capture-' || CAST(event_id // 500 AS VARCHAR) AS path, event_id % 500 AS seq,
      concat_ws(':', CAST(event_id AS VARCHAR), event_type, props) AS text,
      CAST(strlen(concat_ws(':', CAST(event_id AS VARCHAR), event_type, props)) AS INTEGER) AS length
    FROM events WHERE event_id % 101 <> 0""",
)
def _(spark, sf):
    return frames.valid_frames(views.captures(spark, sf)).select(
        "path", "seq", F.col("payload").cast("string").alias("text"), "length"
    )


@query(
    "frames_rejected",
    """SELECT 'capture-' || CAST(event_id // 500 AS VARCHAR) AS path, event_id % 500 AS seq,
      'bad_crc' AS status FROM events WHERE event_id % 101 = 0""",
)
def _(spark, sf):
    return frames.rejected_frames(views.captures(spark, sf)).select("path", "seq", "status")


@query(
    "frames_by_range",
    f"""WITH f AS (SELECT event_id // {views.LONG_FRAMES} AS capture, event_id % {views.LONG_FRAMES} AS seq,
      concat_ws(':', CAST(event_id AS VARCHAR), event_type, props) AS text,
      CASE WHEN event_id % 101 = 0 THEN 'bad_crc' ELSE 'valid' END AS status FROM events)
    SELECT capture, seq, text, CAST(strlen(text) AS INTEGER) AS length, status FROM f
    UNION ALL SELECT capture, count(*), NULL, NULL, 'truncated' FROM f GROUP BY 1""",
)
def _(spark, sf):
    """Each file is cut into pieces that find their frames on their own."""
    pieces = frame_ranges.read_pieces(spark, views.long_captures(spark, sf), piece=views.LONG_PIECE)
    capture = F.regexp_extract("path", "capture=([0-9]+)", 1).cast("bigint").alias("capture")
    text = F.col("payload").cast("string").alias("text")
    return frame_ranges.split_pieces(pieces).select(capture, "seq", text, "length", "status")


@query(
    "frame_stats",
    """WITH f AS (SELECT 'capture-' || CAST(event_id // 500 AS VARCHAR) AS path, event_id % 500 // 100 AS chunk,
      strlen(concat_ws(':', CAST(event_id AS VARCHAR), event_type, props)) AS length
      FROM events WHERE event_id % 101 <> 0),
    g AS (SELECT path, chunk, count(*) AS frames, CAST(sum(length) AS BIGINT) AS bytes FROM f GROUP BY 1, 2)
    SELECT path, chunk, frames, bytes,
      CAST(sum(frames) OVER w AS BIGINT) AS total_frames, CAST(sum(bytes) OVER w AS BIGINT) AS total_bytes
    FROM g WINDOW w AS (PARTITION BY path ORDER BY chunk)""",
)
def _(spark, sf):
    return frames.frame_stats(frames.valid_frames(views.captures(spark, sf)), 100)


@query(
    "market_updates",
    """WITH e AS (SELECT *, 'capture-' || CAST(event_id // 500 AS VARCHAR) AS path, event_id % 500 AS seq,
        CAST(round(value*100) AS BIGINT) AS price_units, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k,
        CASE event_type WHEN 'purchase' THEN 'trade' WHEN 'signup' THEN 'snapshot' WHEN 'error' THEN 'spread'
          ELSE 'delta' END AS kind FROM events WHERE event_id % 500 >= 2),
    s AS (SELECT * FROM (VALUES ('trade', 'even', 0), ('delta', 'even', 0), ('snapshot', 'bid', 0),
      ('snapshot', 'ask', 1), ('snapshot', 'ask', 2), ('spread', 'bid', 0), ('spread', 'ask', 0)) AS v(kind, side, no))
    SELECT path, seq, e.kind, user_id % 3 AS exchange_id, user_id % 7 AS instrument_id, user_id % 10 AS market_id,
      CASE WHEN e.kind IN ('snapshot', 'delta') THEN event_id END AS seq_num,
      CASE WHEN s.side <> 'even' THEN s.side WHEN e.kind = 'trade' THEN CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END
        ELSE CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END END AS side,
      CASE e.kind WHEN 'trade' THEN epoch_us(ts) * 1000 WHEN 'spread' THEN epoch_us(ts) // 1000 * 1000000 END AS time_ns,
      price_units, CASE WHEN e.kind = 'delta' AND k % 4 = 0 THEN 0 ELSE k END AS amount,
      CASE WHEN e.kind = 'trade' THEN 'ev:' || CAST(event_id AS VARCHAR) END AS external_id
    FROM e JOIN s ON e.kind = s.kind""",
)
def _(spark, sf):
    rows = messages.market_updates(messages.parse(views.message_texts(spark, sf)))
    return rows.withColumn("price_units", (F.col("price") * 100).cast("bigint")).withColumn(
        "amount", F.col("amount").cast("bigint")
    ).drop("price")


@query(
    "message_rejects",
    """WITH e AS (SELECT *, 'capture-' || CAST(event_id // 500 AS VARCHAR) AS path, event_id % 500 AS seq,
        CAST(json_extract_string(props,'$.k') AS BIGINT) % 4 = 0 AS gone
      FROM events WHERE event_id % 500 >= 2),
    r AS (SELECT path, seq, seq % 40 AS place, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 3
        WHEN 'error' THEN 2 ELSE CASE WHEN gone THEN 0 ELSE 1 END END AS prices FROM e)
    SELECT path, seq, CASE WHEN place = 7 THEN 'json' WHEN place = 8 THEN 'kind' ELSE 'price' END AS reason,
      CASE WHEN place = 9 THEN 'abc' WHEN place = 11 THEN repeat('9', 24) WHEN place = 13 THEN '0.1234567890123456789' END AS text,
      CAST(CASE WHEN place IN (7, 8) THEN 1 ELSE prices END AS BIGINT) AS n
    FROM r WHERE place IN (7, 8) OR place IN (9, 11, 13) AND prices > 0""",
)
def _(spark, sf):
    left_out = messages.rejects(views.spoiled_message_texts(spark, sf))
    whole = F.col("reason").isin("json", "kind")
    text = F.when(~whole, F.col("text")).alias("text")
    return left_out.groupBy("path", "seq", "reason", text).agg(F.count(F.lit(1)).alias("n"))


# -- a lake in versions ----------------------------------------------------------------


@query(
    "compact_lake",
    f"WITH {TRADES_SQL} SELECT time_us, seq, price_int, yr AS year, exchange, instrument, source FROM trades",
)
def _(spark, sf):
    """All rows, read back through the query builder after two compactions."""
    rows = _builder().run(spark, views.versioned_lake(spark, sf), versioned=True)
    return rows.select(
        micros("time").alias("time_us"), "seq", F.col("price.int").alias("price_int"),
        "year", "exchange", "instrument", "source",
    )


@query(
    "catalog_of_lake",
    f"""WITH {TRADES_SQL}, u AS (SELECT *, make_timestamp(time_us) AS t FROM trades)
    SELECT exchange, instrument, source,
      CASE WHEN t < DATE '2024-01-01' THEN strftime(t, '%Y') WHEN t < DATE '2024-02-01' THEN strftime(t, '%Y-%m')
        ELSE strftime(t, '%Y-%m-%d') END AS unit,
      min(time_us) * 1000 AS start_ns, max(time_us) * 1000 + 1 AS end_ns, count(*) AS rows
    FROM u GROUP BY ALL""",
)
def _(spark, sf):
    rows = versions.catalog(spark, views.versioned_lake(spark, sf))
    return rows.select(*versions.UNIT, "start_ns", "end_ns", "rows")


@query(
    "resume_lake",
    f"""WITH {TRADES_SQL} SELECT exchange, instrument, max(time_us) * 1000 + 1 AS since_ns
    FROM trades GROUP BY 1, 2""",
)
def _(spark, sf):
    """Where a download of each market goes on."""
    return ingest.high_watermark(versions.catalog(spark, views.versioned_lake(spark, sf)))

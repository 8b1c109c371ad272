"""Queries on price series, distributions and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import numbers
from tickloom.operators import bars, series, smooth, stats
from tickloom.plans import blocks, views
from tickloom.plans.settle import settle
from tickloom.plans.registry import micros, query, rounded, sql_rounded
from tickloom.plans.views import LONG_TRADES_SQL, TRADES_SQL
from tickloom.schema import MARKET, TIME_ORDER
from tickloom.sources import kept_bars

W = "PARTITION BY exchange, instrument ORDER BY time_us, seq"
LEAD = f"""{TRADES_SQL}, l AS (SELECT *, lead(p) OVER w AS p_next, lag(p) OVER w AS p_prev,
  row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY exchange, instrument) AS n_rows
  FROM trades WINDOW w AS ({W}))"""
# Widest price change kept, in percent, where the fixture needs more than the default.
WIDE = 50.0
DROPS = f"""{LEAD}, drops AS (SELECT exchange, instrument, seq, (p - p_next) / p * 100 AS x
  FROM l WHERE p_next IS NOT NULL AND abs((p - p_next) / p * 100) < {WIDE})"""


def _series(spark, sf):
    return series.prices(views.trades(spark, sf))


def _drops(spark, sf):
    """Price changes, written once: the statistics read them several times."""
    changes = series.drop_pct(_series(spark, sf), outlier=WIDE)
    return settle(changes.select(*MARKET, "drop_pct"), "drops")


def _numbered(spark, sf):
    return blocks.number_rows(series.cut(_series(spark, sf)), MARKET, TIME_ORDER)


@query(
    "price_diff",
    f"""WITH {LEAD} SELECT exchange, instrument, seq, {sql_rounded("p_next - p")} AS dp
    FROM l WHERE p_next IS NOT NULL""",
)
def _(spark, sf):
    return series.price_diff(_series(spark, sf)).select(*MARKET, "seq", rounded("dp").alias("dp"))


@query(
    "pct_change",
    f"""WITH {LEAD} SELECT exchange, instrument, seq, {sql_rounded("(p_next - p) / nullif(p, 0) * 100")} AS pct
    FROM l WHERE p_next IS NOT NULL""",
)
def _(spark, sf):
    return series.pct_change(_series(spark, sf)).select(*MARKET, "seq", rounded("pct").alias("pct"))


@query(
    "pct_change_dist",
    f"""WITH {LEAD} SELECT exchange, instrument, seq, {sql_rounded("(p - p_next) / p * 100")} AS drop_pct
    FROM l WHERE abs((p - p_next) / p * 100) < 0.25""",
)
def _(spark, sf):
    return series.drop_pct(_series(spark, sf)).select(
        *MARKET, "seq", rounded("drop_pct").alias("drop_pct")
    )


@query(
    "sample_last_hour",
    f"""WITH {TRADES_SQL}, b AS (SELECT *, time_us // 3600000000 AS h,
      lead(time_us // 3600000000) OVER ({W}) AS h_next FROM trades)
    SELECT exchange, instrument, h * 3600000000 AS bucket_us, seq, {sql_rounded("p")} AS p
    FROM b WHERE h <> h_next""",
)
def _(spark, sf):
    return series.sample_last(_series(spark, sf), "hour").select(
        *MARKET, micros("bucket").alias("bucket_us"), "seq", rounded("p").alias("p")
    )


@query(
    "decimate",
    f"""WITH {LEAD} SELECT exchange, instrument, seq, rn FROM l
    WHERE rn >= 10 AND rn < n_rows - 9 AND (rn - 10) % 25 = 0""",
)
def _(spark, sf):
    numbered = _numbered(spark, sf)
    return series.decimate(numbered, 25, trim=10).select(*MARKET, "seq", "rn")


def _smooth_sql(width: int, weight: str) -> str:
    return f"""WITH {LEAD}, s AS (
      SELECT exchange, instrument, n_rows, p, rn + {width} - 1 AS pos FROM l
      UNION ALL SELECT exchange, instrument, n_rows, p, {width} - 1 - rn FROM l WHERE rn BETWEEN 1 AND {width} - 1
      UNION ALL SELECT exchange, instrument, n_rows, p, 2 * n_rows + {width} - 2 - rn FROM l WHERE rn >= n_rows - {width} + 1),
    k AS (SELECT o, {weight} AS w FROM range({width}) AS r(o)),
    t AS (SELECT sum(w) AS total FROM k),
    y AS (SELECT exchange, instrument, pos - o AS j, sum(p * w) / any_value(total) AS y
      FROM s, k, t WHERE pos - o BETWEEN 0 AND n_rows + {width} - 2 GROUP BY 1, 2, 3)
    """


@query(
    "smooth_flat",
    _smooth_sql(11, "1.0::DOUBLE") + f"SELECT exchange, instrument, j, {sql_rounded('y')} AS y FROM y",
)
def _(spark, sf):
    return smooth.smooth(_numbered(spark, sf), "p", 11, "flat").select(
        *MARKET, "j", rounded("y").alias("y")
    )


@query(
    "smooth_hanning",
    _smooth_sql(11, "0.5 - 0.5 * cos(2 * pi() * o / 10)")
    + f"SELECT exchange, instrument, j, {sql_rounded('y')} AS y FROM y",
)
def _(spark, sf):
    return smooth.smooth(_numbered(spark, sf), "p", 11, "hanning").select(
        *MARKET, "j", rounded("y").alias("y")
    )


def _kernel_query(name: str, weight: str) -> None:
    @query(
        f"smooth_{name}",
        _smooth_sql(11, weight) + f"SELECT exchange, instrument, j, {sql_rounded('y')} AS y FROM y",
    )
    def _(spark, sf):
        return smooth.smooth(_numbered(spark, sf), "p", 11, name).select(
            *MARKET, "j", rounded("y").alias("y")
        )


_kernel_query("hamming", "0.54 - 0.46 * cos(2 * pi() * o / 10)")
_kernel_query("bartlett", "1 - abs(2.0::DOUBLE * o / 10 - 1)")
_kernel_query("blackman", "0.42 - 0.5 * cos(2 * pi() * o / 10) + 0.08 * cos(4 * pi() * o / 10)")

THIN = 1_000


@query(
    "smooth_thin",
    f"""WITH {TRADES_SQL} SELECT exchange, instrument, count(*) AS n_rows FROM trades
    GROUP BY 1, 2 HAVING count(*) < {THIN}""",
)
def _(spark, sf):
    """Markets too thin for a kernel of 1000 points."""
    return smooth.left_out(_numbered(spark, sf), THIN)


@query(
    "smooth_decimate",
    _smooth_sql(20, "1.0::DOUBLE")
    + f""", n AS (SELECT exchange, instrument, count(*) + 19 AS points FROM trades GROUP BY 1, 2)
    SELECT exchange, instrument, j, {sql_rounded('y')} AS y FROM y JOIN n USING (exchange, instrument)
    WHERE j >= 10 AND j < points - 9 AND (j - 10) % 50 = 0""",
)
def _(spark, sf):
    points = smooth.smooth(_numbered(spark, sf), "p", 20, "flat")
    return smooth.decimate_points(points, 50, trim=10).select(*MARKET, "j", rounded("y").alias("y"))


LABEL = "CASE WHEN (p > p_prev AND p > p_next) OR (p < p_prev AND p < p_next) THEN 1 ELSE 0 END"


@query(
    "extrema_labels",
    f"""WITH {LEAD} SELECT exchange, instrument, seq, CAST({LABEL} AS INTEGER) AS label FROM l""",
)
def _(spark, sf):
    cut = series.cut(_series(spark, sf))
    return smooth.extrema_labels(cut, TIME_ORDER).select(*MARKET, "seq", "label")


@query(
    "lag_vectors",
    f"""WITH {LEAD}, v AS (SELECT *, lag(p, 3) OVER w AS v0, lag(p, 2) OVER w AS v1, lag(p, 1) OVER w AS v2,
      {LABEL} AS label FROM l WINDOW w AS ({W}))
    SELECT exchange, instrument, rn, v0, v1, v2, p AS v3, CAST(label AS INTEGER) AS label FROM v WHERE rn >= 3""",
)
def _(spark, sf):
    labeled = smooth.extrema_labels(series.cut(_series(spark, sf)), TIME_ORDER)
    numbered = blocks.number_rows(labeled, MARKET, TIME_ORDER)
    vectors = smooth.lag_vectors(numbered, ["p", "label"], 4)
    return vectors.select(
        *MARKET, "rn", *[F.get("v", i).alias(f"v{i}") for i in range(4)], "label"
    )


@query("extrema_model")
def _(spark, sf):
    """No SQL: a model is trained. The tests check that it beats guessing."""
    labeled = smooth.extrema_labels(series.cut(_series(spark, sf)), TIME_ORDER)
    numbered = blocks.number_rows(labeled, MARKET, TIME_ORDER)
    vectors = smooth.lag_vectors(numbered, ["p", "label"], 4)
    return smooth.extrema_model(vectors, iterations=10, most=100_000)[1]


# -- checks ----------------------------------------------------------------------------


@query(
    "scale_check",
    f"""WITH {TRADES_SQL}, s AS (SELECT exchange, instrument, CASE WHEN exchange = 'beta' AND seq % 3 = 0 THEN 5
        ELSE 2 END AS p, CASE WHEN instrument = 'view/eur' AND seq % 5 = 0 THEN 1 ELSE 0 END AS a FROM trades)
    SELECT exchange, instrument, CAST(min(p) AS INTEGER) AS price_scale_min,
      CAST(max(p) AS INTEGER) AS price_scale_max, CAST(min(a) AS INTEGER) AS amount_scale_min,
      CAST(max(a) AS INTEGER) AS amount_scale_max, min(p) = max(p) AND min(a) = max(a) AS constant
    FROM s GROUP BY 1, 2""",
)
def _(spark, sf):
    """Some markets change their scales."""
    e = F.col("seq")
    odd_price = (F.col("exchange") == "beta") & (e % 3 == 0)
    odd_amount = (F.col("instrument") == "view/eur") & (e % 5 == 0)
    rows = views.trades(spark, sf)
    rows = rows.withColumn("price", numbers.scaled(F.col("price.int"), F.when(odd_price, 5).otherwise(2)))
    return series.scale_check(
        rows.withColumn("amount", numbers.scaled(F.col("amount.int"), F.when(odd_amount, 1).otherwise(0)))
    )


@query(
    "monotonic_check",
    f"""WITH {LONG_TRADES_SQL}, l AS (SELECT *, lag(time_us) OVER (PARTITION BY exchange, instrument ORDER BY seq)
      AS before FROM long_trades)
    SELECT exchange, instrument, count(*) AS n, count(*) FILTER (WHERE time_us < before) AS violations
    FROM l GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = views.long_trades(spark, sf).select(*MARKET, "seq", "time_ns")
    return series.monotonic_check(rows)


# -- aggregates ------------------------------------------------------------------------


@query(
    "max_profit",
    f"""WITH {LEAD}, s AS (SELECT exchange, instrument, sum(greatest(p_next - p, 0) / nullif(p, 0)) AS up,
      sum(greatest(p - p_next, 0) / nullif(p, 0)) AS down, (max(time_us) - min(time_us)) / 1e6 AS seconds
      FROM l WHERE p_next IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT exchange, instrument, (max(time_us) - min(time_us)) / 1e6 AS seconds FROM trades GROUP BY 1, 2)
    SELECT exchange, instrument, {sql_rounded("up", 4)} AS up, {sql_rounded("down", 4)} AS down,
      {sql_rounded("t.seconds")} AS seconds, {sql_rounded("up * 31557600 / t.seconds", 3)} AS up_per_year,
      {sql_rounded("down * 31557600 / t.seconds", 3)} AS down_per_year
    FROM s JOIN t USING (exchange, instrument)""",
)
def _(spark, sf):
    return series.max_profit(_series(spark, sf)).select(
        *MARKET,
        rounded("up", 4).alias("up"),
        rounded("down", 4).alias("down"),
        rounded("seconds").alias("seconds"),
        rounded("up_per_year", 3).alias("up_per_year"),
        rounded("down_per_year", 3).alias("down_per_year"),
    )


@query(
    "serial_pairs",
    f"""WITH {LEAD} SELECT exchange, instrument, seq, {sql_rounded("p_prev - p")} AS dp,
      {sql_rounded("p - p_next")} AS dp_next FROM l WHERE p_prev IS NOT NULL AND p_next IS NOT NULL""",
)
def _(spark, sf):
    return series.serial_pairs(_series(spark, sf)).select(
        *MARKET, "seq", rounded("dp").alias("dp"), rounded("dp_next").alias("dp_next")
    )


@query(
    "serial_corr",
    f"""WITH {LEAD} SELECT exchange, instrument, count(*) AS pairs,
      {sql_rounded("corr(p_prev - p, p - p_next)")} AS corr
    FROM l WHERE p_prev IS NOT NULL AND p_next IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    return series.serial_corr(_series(spark, sf)).withColumn("corr", rounded("corr"))


@query(
    "diff_price_int8",
    f"""WITH {LEAD}, h AS (SELECT exchange, instrument, seq, (p_next - p) / 2 AS half FROM l WHERE p_next IS NOT NULL),
    m AS (SELECT exchange, instrument, max(abs(half)) AS high FROM h GROUP BY 1, 2)
    SELECT exchange, instrument, seq, CAST(trunc(half * (127.0::DOUBLE / high)) AS INTEGER) AS dp_int8
    FROM h JOIN m USING (exchange, instrument)""",
)
def _(spark, sf):
    return series.diff_int8(_series(spark, sf)).select(
        *MARKET, "seq", F.col("dp_int8").cast("int").alias("dp_int8")
    )


@query(
    "price_change_hist",
    f"""WITH {DROPS}, m AS (SELECT exchange, instrument, min(x) AS lo, (max(x) - min(x)) / 30 AS step,
      count(*) AS total FROM drops GROUP BY 1, 2),
    c AS (SELECT exchange, instrument, least(CAST(floor((x - lo) / step) AS INTEGER), 29) AS bin, count(*) AS n
      FROM drops JOIN m USING (exchange, instrument) GROUP BY 1, 2, 3)
    SELECT exchange, instrument, CAST(b AS INTEGER) AS bin, {sql_rounded("lo + b * step")} AS lo,
      {sql_rounded("lo + (b + 1) * step")} AS hi, coalesce(n, 0) AS n,
      {sql_rounded("coalesce(n, 0) / (total * step)")} AS density
    FROM m CROSS JOIN range(30) AS r(b) LEFT JOIN c ON c.exchange = m.exchange AND c.instrument = m.instrument AND c.bin = b""".replace(
        "SELECT exchange, instrument, CAST(b", "SELECT m.exchange, m.instrument, CAST(b"
    ),
)
def _(spark, sf):
    return stats.histogram(_drops(spark, sf), "drop_pct", 30).select(
        *MARKET,
        "bin",
        rounded("lo").alias("lo"),
        rounded("hi").alias("hi"),
        F.col("n").cast("bigint").alias("n"),
        rounded("density").alias("density"),
    )


@query(
    "price_change_entropy",
    f"""WITH {DROPS}, m AS (SELECT exchange, instrument, min(x) AS lo, (max(x) - min(x)) / 100 AS step,
      count(*) AS total FROM drops GROUP BY 1, 2),
    c AS (SELECT exchange, instrument, total, least(floor((x - lo) / step), 99) AS bin, count(*) AS n
      FROM drops JOIN m USING (exchange, instrument) GROUP BY 1, 2, 3, 4)
    SELECT exchange, instrument, {sql_rounded("-sum(n / total * ln(n / total))")} AS entropy FROM c GROUP BY 1, 2""",
)
def _(spark, sf):
    return stats.entropy(_drops(spark, sf), "drop_pct").withColumn("entropy", rounded("entropy"))


FIT = f"""{DROPS}, m AS (SELECT exchange, instrument, median(x) AS loc, count(*) AS n FROM drops GROUP BY 1, 2),
  fit AS (SELECT exchange, instrument, any_value(n) AS n, any_value(loc) AS loc, avg(abs(x - loc)) AS scale
    FROM drops JOIN m USING (exchange, instrument) GROUP BY 1, 2)"""


@query(
    "laplace_fit",
    f"""WITH {FIT} SELECT exchange, instrument, n, {sql_rounded("loc")} AS loc, {sql_rounded("scale")} AS scale FROM fit""",
)
def _(spark, sf):
    return stats.laplace_fit(_drops(spark, sf), "drop_pct").select(
        *MARKET, "n", rounded("loc").alias("loc"), rounded("scale").alias("scale")
    )


@query(
    "laplace_curve",
    f"""WITH {FIT}, e AS (SELECT *, loc + scale * ln(0.002::DOUBLE) AS lo,
      loc - scale * ln(2 * (1 - 0.999::DOUBLE)) AS hi FROM fit WHERE scale > 0),
    c AS (SELECT exchange, instrument, loc, scale, i, lo + i * ((hi - lo) / 9999) AS x
      FROM e CROSS JOIN range(10000) AS r(i))
    SELECT exchange, instrument, CAST(i AS INTEGER) AS i, {sql_rounded("x", 5)} AS x,
      {sql_rounded("exp(-abs(x - loc) / scale) / (scale * 2)")} AS density FROM c""",
)
def _(spark, sf):
    fit = stats.laplace_fit(_drops(spark, sf), "drop_pct")
    return stats.laplace_curve(fit).select(
        *MARKET, "i", rounded("x", 5).alias("x"), rounded("density").alias("density")
    )


HOURS = f"""{TRADES_SQL}, b AS (SELECT *, time_us // 3600000000 AS h,
  lead(time_us // 3600000000) OVER ({W}) AS h_next FROM trades),
  s AS (SELECT exchange, instrument, h, p FROM b WHERE h <> h_next),
  f AS (SELECT a.exchange, a.instrument, k AS lag, count(*) AS n, sqrt(avg((c.p - a.p) * (c.p - a.p))) AS sigma
    FROM s a, (VALUES (1),(2),(4),(8),(16)) AS v(k), s c
    WHERE a.exchange = c.exchange AND a.instrument = c.instrument AND c.h = a.h + k GROUP BY 1, 2, 3)"""


def _structure(spark, sf):
    sampled = series.sample_last(_series(spark, sf), "hour")
    return stats.structure_function(sampled, blocks.HOUR_NS, [1, 2, 4, 8, 16])


@query(
    "structure_function",
    f"""WITH {HOURS} SELECT exchange, instrument, CAST(lag AS INTEGER) AS lag, n,
      {sql_rounded("sigma")} AS sigma FROM f""",
)
def _(spark, sf):
    return _structure(spark, sf).withColumn("sigma", rounded("sigma"))


@query(
    "structure_exponent",
    f"""WITH {HOURS} SELECT exchange, instrument, count(*) AS lags,
      {sql_rounded("regr_slope(ln(sigma), ln(lag * 3600.0::DOUBLE))")} AS exponent
    FROM f WHERE sigma > 0 GROUP BY 1, 2""",
)
def _(spark, sf):
    return stats.structure_exponent(_structure(spark, sf), 3600).withColumn(
        "exponent", rounded("exponent")
    )


@query(
    "portfolio_value",
    f"""WITH {TRADES_SQL}, a AS (SELECT t.*, e.user_id AS account FROM trades t JOIN events e ON t.seq = e.event_id),
    m AS (SELECT *, last_value(CASE WHEN side IS NULL THEN p END IGNORE NULLS) OVER ({W}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM a),
    h AS (SELECT *, sum(CASE WHEN side = 'buy' THEN -p * amount_int ELSE p * amount_int END) OVER w AS spent,
      sum(CASE WHEN side = 'buy' THEN amount_int ELSE -amount_int END) OVER w AS stock
      FROM m WHERE side IS NOT NULL
      WINDOW w AS (PARTITION BY account, exchange, instrument ORDER BY time_us, seq))
    SELECT account, exchange, instrument, seq, {sql_rounded("1000.0::DOUBLE + spent", 4)} AS cash,
      CAST(stock AS BIGINT) AS stock, {sql_rounded("price")} AS price,
      {sql_rounded("1000.0::DOUBLE + spent + stock * price", 4)} AS value FROM h""",
)
def _(spark, sf):
    account = views.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("account")
    )
    rows = views.trades(spark, sf).select(
        *MARKET, *TIME_ORDER, "side", F.col("amount.int").alias("amount"),
        (F.col("price.int") / F.lit(100.0)).alias("p"),
    )
    fills = rows.where(F.col("side").isNotNull()).join(account, "seq")
    marks = rows.where(F.col("side").isNull())
    return series.portfolio(fills, marks, cash=1000).select(
        "account",
        *MARKET,
        "seq",
        rounded("cash", 4).alias("cash"),
        F.col("stock").cast("bigint").alias("stock"),
        rounded("price").alias("price"),
        rounded("value", 4).alias("value"),
    )


# -- bars ------------------------------------------------------------------------------


def _bars_sql(start: str, view: str = "trades", ctes: str = TRADES_SQL) -> str:
    return f"""WITH {ctes}, b AS (SELECT *, {start} AS bar_us FROM {view})
    SELECT exchange, instrument, bar_us, arg_min(price_int, (time_us, seq)) AS open, max(price_int) AS high,
      min(price_int) AS low, arg_max(price_int, (time_us, seq)) AS close,
      CAST(sum(amount_int) AS BIGINT) AS volume, count(*) AS trades FROM b GROUP BY 1, 2, 3"""


def _bar_columns(rows):
    return rows.select(
        *MARKET, micros("bar").alias("bar_us"), "open", "high", "low", "close", "volume", "trades"
    )


def _bars(rows, every):
    return _bar_columns(bars.ohlc(rows, every))


@query("ohlc_1m", _bars_sql("time_us // 60000000 * 60000000"))
def _(spark, sf):
    return _bars(views.trades(spark, sf), "1m")


@query("ohlc_1h", _bars_sql("time_us // 3600000000 * 3600000000"))
def _(spark, sf):
    return _bars(views.trades(spark, sf), "1h")


@query("ohlc_1d", _bars_sql("time_us // 86400000000 * 86400000000"))
def _(spark, sf):
    return _bars(views.trades(spark, sf), "1d")


@query(
    "ohlc_1mo",
    _bars_sql(
        "epoch_us(date_trunc('month', make_timestamp(time_us)))", "long_trades", LONG_TRADES_SQL
    ),
)
def _(spark, sf):
    return _bars(views.long_trades(spark, sf), "1mo")


def _kept(spark, sf, subject):
    return kept_bars.read(spark, views.barred_lake(spark, sf), subject)


@query("kept_bars_1m", _bars_sql("time_us // 60000000 * 60000000"))
def _(spark, sf):
    """Bars stored beside a lake in versions, of which some units were refreshed for late trades."""
    return _bar_columns(_kept(spark, sf, "ohlc:1m"))


@query("kept_bars_1d", _bars_sql("time_us // 86400000000 * 86400000000"))
def _(spark, sf):
    return _bar_columns(_kept(spark, sf, "ohlc:1d"))

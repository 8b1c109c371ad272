import doctest
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.functions import files, kernels, numbers, symbols, timefmt
from tickloom.operators import query


@pytest.mark.parametrize("module", [timefmt, query])
def test_doctests(module):
    assert doctest.testmod(module).failed == 0


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


SHORT = {
    "2020-03-24 15:34:55": "2020-03-24T15:34:55Z",
    "2020-03-24 15:34:00": "2020-03-24T15:34Z",
    "2020-03-24 15:00:00": "2020-03-24T15Z",
    "2020-03-24 00:00:00": "2020-03-24Z",
    "2020-03-01 00:00:00": "2020-03Z",
    "2020-01-01 00:00:00": "2020Z",
    "2020-03-24 15:34:55.123456789": "2020-03-24T15:34:55.123456789Z",
    "2020-03-24 15:34:55.5": "2020-03-24T15:34:55.500000Z",
    "1969-12-31 23:59:59.000000001": "1969-12-31T23:59:59.000000001Z",
}


@pytest.mark.parametrize("text,short", SHORT.items())
def test_short_form(spark, text, short):
    stamp = timefmt.instant(text)
    assert timefmt.short_text(stamp) == short
    assert one(spark, timefmt.iso_short(F.col("ns")), ns=stamp.value) == short
    back = one(spark, F.unix_micros(timefmt.parse_time(F.col("t"))), t=short)
    assert back == stamp.value // 1000


def test_instant():
    assert timefmt.instant("2017-03Z") == pd.Timestamp("2017-03-01", tz="UTC")
    assert timefmt.instant(1488844800000000000) == timefmt.instant("2017-03-07")
    assert timefmt.instant(pd.Timestamp("2017-03-07")) == timefmt.instant("2017-03-07")


PERIODS = {
    "2019": ("2019-01-01", "2020-01-01"),
    "2020Q3": ("2020-07-01", "2020-10-01"),
    "2020q4": ("2020-10-01", "2021-01-01"),
    "2020-11": ("2020-11-01", "2020-12-01"),
    "2020-11-02": ("2020-11-02", "2020-11-03"),
    "2020-05-15/2020-07-15": ("2020-05-15", "2020-07-16"),
    "2019-08-04/2019-08-07 15:00": ("2019-08-04", "2019-08-07 15:00"),
    "2019/2020Q1": ("2019-01-01", "2020-04-01"),
    "2019-08-04T06:30Z/2019-08": ("2019-08-04 06:30", "2019-09-01"),
}


@pytest.mark.parametrize("text,ends", PERIODS.items())
def test_periods(spark, text, ends):
    want = tuple(timefmt.instant(e).value // 1000 for e in ends)
    span = timefmt.period(text)
    assert (span.start.value // 1000, span.end.value // 1000) == want
    row = timefmt.periods(spark.range(1).select(F.lit(text).alias("p")), "p").select(
        F.unix_micros("start"), F.unix_micros("end")
    ).first()
    assert tuple(row) == want


@pytest.mark.parametrize("text", ["nonsense", "2020-13", "2020-02-30", "2020Q5", "2020-11-02 10:00"])
def test_bad_periods(spark, text):
    with pytest.raises(ValueError):
        timefmt.period(text)
    row = timefmt.periods(spark.range(1).select(F.lit(text).alias("p")), "p").first()
    assert row["start"] is None and row["end"] is None


def test_span_text(spark):
    def text(a, b, short=True):
        a, b = timefmt.instant(a).value, timefmt.instant(b).value
        return one(spark, timefmt.span_text(F.col("a"), F.col("b"), short), a=a, b=b)

    assert text("2019", "2020") == "2019"
    assert text("2019-01", "2019-02") == "2019-01"
    assert text("2019-01-01", "2019-01-02") == "2019-01-01"
    full = "2019-01-01T00:00:00.000000000Z/2020-01-01T00:00:00.000000000Z"
    assert text("2019", "2020", short=False) == full
    assert text("2019-01-02", "2019-02-02").startswith("2019-01-02T00:00:00.000000000Z/2019-02-02T")


def test_calendar_parts(spark):
    def parts(text):
        got = one(spark, timefmt.calendar_parts(F.col("t")), t=text)
        return tuple(got) if got else None

    assert parts("2020") == (2020, None, None)
    assert parts("2020-02") == (2020, 2, None)
    assert parts("2020-02-29") == (2020, 2, 29)
    for bad in ("1899", "2101-01", "2019-02-29", "2020-2", "x", "2020-01-01-01"):
        assert parts(bad) is None


@pytest.mark.parametrize(
    "text,scale,units",
    [
        ("12.349", 2, 1234), ("-12.349", 2, -1234), ("0.00000001", 8, 1), ("5", 3, 5000),
        (".5", 1, 5), ("7.", 0, 7), ("1e-7", 8, 10), ("1.5E3", 1, 15000), ("+3.1", 1, 31),
        ("abc", 2, None), ("", 2, None), (".", 2, None), ("99999999999999999999", 0, None),
        ("0.123456789012345678901234567890", 18, 123456789012345678),
        ("1.9999999999999999999e0", 0, 1), ("-1.9999999999999999999e0", 0, -1),
        ("123.456e-2", 3, 1234), ("0.00012e5", 0, 12), ("9e-400", 5, 0), ("1e18", 0, 10**18),
        ("1e19", 0, None), ("0e99", 2, 0), ("1e", 2, None), ("00012.5", 1, 125),
    ],
)
def test_units_are_cut_not_rounded(spark, text, scale, units):
    assert one(spark, numbers.to_units(F.col("t"), F.col("s")), t=text, s=scale) == units


def test_seconds_round_half_even_on_the_binary_value(spark):
    rng = np.random.default_rng(3)
    seconds = np.concatenate(
        [
            rng.integers(1_300_000_000 * 10**6, 1_900_000_000 * 10**6, 4000) / 1e6,
            1_700_000_000 + np.arange(64) / 64,
            [1607848390.407, 0.0, 1234567.5, 3.25],
        ]
    ).tolist()
    want = [
        int(Decimal(s).quantize(Decimal("0.00000"), ROUND_HALF_EVEN).scaleb(9)) for s in seconds
    ]
    rows = spark.createDataFrame(list(enumerate(seconds)), "i long, s double")
    got = rows.select("i", numbers.seconds_to_ns(F.col("s")).alias("ns")).orderBy("i").collect()
    assert [r["ns"] for r in got] == want
    assert one(spark, numbers.seconds_to_ns(F.col("s")), s=0.1) is None


def test_symbols(spark):
    market = one(spark, symbols.split_market(F.col("t")), t="Alpha:BTC/USD/quarterly-q3")
    assert tuple(market) == ("alpha", "btc/usd/quarterly-q3")
    for bad in ("alpha", "alpha:btc", "a:b/c/d/e", "alpha:b_c/d", "alpha:-b/c", ":b/c"):
        assert one(spark, symbols.split_market(F.col("t")), t=bad) is None
    assert one(spark, symbols.rename_asset(F.col("t")), t="XBT") == "btc"
    assert one(spark, symbols.rename_asset(F.col("t")), t="XDG") == "doge"
    assert one(spark, symbols.rename_asset(F.col("t")), t="EUR") == "eur"


symbol = st.from_regex(r"\A[a-z][a-z0-9]{0,3}(-[a-z][a-z0-9]{0,3})?\Z")
moment = st.integers(0, 4 * 10**18)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(symbol, symbol, symbol, symbol, moment), min_size=1, max_size=20),
       st.sampled_from(symbols.SUBJECTS))
def test_file_paths_round_trip(spark, parts, subject):
    rows = spark.createDataFrame(
        [(s, e, f"{b}/{q}", t, i % 4) for i, (s, e, b, q, t) in enumerate(parts)],
        "source string, exchange string, instrument string, ns bigint, kind int",
    )
    time = F.coalesce(
        *[
            F.when(F.col("kind") == i, timefmt.calendar_text(F.col("ns"), unit))
            for i, unit in enumerate(["year", "month", "day"])
        ],
        timefmt.iso_full(F.col("ns")),
    )
    parts = [F.lit(subject), F.col("source"), F.col("exchange"), F.col("instrument"), F.col("t")]
    built = rows.withColumn("t", time).select(
        F.col("t").alias("want_time"),
        files.file_id(*parts).alias("want"),
        F.concat(F.lit("/data/lake/"), files.positional_path(*parts)).alias("path"),
    )
    found = files.parse_positional_paths(built)
    names = [F.col(c) for c in ("subject", "source", "exchange", "instrument", "time")]
    got = found.select(files.file_id(*names).alias("got"), "want").collect()
    assert len(got) == rows.count()
    assert all(r["got"] == r["want"] for r in got)
    again = files.parse_file_ids(built.select(F.col("want").alias("file_id"), "want_time"))
    assert again.where("time = want_time").count() == rows.count()


def test_bad_file_ids(spark):
    bad = ["", "trades:a:b:c/d", "nothing:a:b:c/d:2020", "trades:a:b:c/d:1800", "trades:a:b:cd:2020",
           "trades:a_b:b:c/d:2020", "trades:a:b:c/d:2020-13-01"]
    rows = spark.createDataFrame([(x,) for x in bad], "file_id string")
    assert files.parse_file_ids(rows).count() == 0
    good = spark.createDataFrame([("ohlc:1m:a:b:c/d:2020-02-03",)], "file_id string")
    row = files.parse_file_ids(good).first()
    assert (row["subject"], row["time_kind"]) == ("ohlc:1m", "day")


def test_hive_path(spark):
    def path(a, b, short):
        columns = [F.lit(x) for x in ("trades", "src_rest", "alpha", "btc/eur")]
        ends = [F.lit(timefmt.instant(x).value) for x in (a, b)]
        return one(spark, files.hive_path(*columns, *ends, short=short))

    root = "trades/year=2015/exchange=alpha/instrument=btc_eur/source=src_rest/"
    assert path("2015-08-01", "2015-09-01", True) == (
        root + "2015-08.alpha.btc_eur.src_rest.trades.parquet"
    )
    assert path("2015-08-01", "2015-09-01", False) == (
        root + "2015-08-01T000000.000000000Z.2015-09-01T000000.000000000Z"
        ".alpha.btc_eur.src_rest.trades.parquet"
    )


@pytest.mark.parametrize("name", kernels.KERNELS)
@pytest.mark.parametrize("length", [3, 4, 11])
def test_kernels(name, length):
    want = np.ones(length) if name == "flat" else getattr(np, name)(length)
    assert np.allclose(kernels.kernel(name, length), want / want.sum())


def test_unknown_kernel():
    with pytest.raises(ValueError):
        kernels.kernel("gauss", 5)

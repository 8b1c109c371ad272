import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, series, smooth, stats
from tickloom.plans import blocks
from tickloom.schema import MARKET, TIME_ORDER

HOUR = blocks.HOUR_NS


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    rows = []
    for exchange, n in (("alpha", 700), ("beta", 150), ("gamma", 40)):
        times = np.sort(rng.integers(0, 50 * HOUR, n))
        times[: n // 4] = times[n // 4]
        prices = np.round(100 + np.cumsum(rng.normal(0, 1, n)), 2)
        rows += [(exchange, "btc/eur", int(t), i, float(p)) for i, (t, p) in enumerate(zip(times, prices))]
    return rows


@pytest.fixture(scope="module")
def prices(spark, data):
    fields = "exchange string, instrument string, time_ns bigint, seq bigint, p double"
    return spark.createDataFrame(data, fields).repartition(4)


def of(data, exchange):
    return np.array([r[4] for r in data if r[0] == exchange])


def convolved(x, w, name):
    padded = np.r_[x[w - 1 : 0 : -1], x, x[-1 : -w : -1]]
    kernel = np.ones(w) if name == "flat" else getattr(np, name)(w)
    return np.convolve(kernel / kernel.sum(), padded, mode="valid")


@pytest.mark.parametrize("name", ["flat", "hanning", "hamming", "bartlett", "blackman"])
@pytest.mark.parametrize("w", [3, 8, 21])
def test_smooth_equals_numpy(prices, data, name, w):
    numbered = blocks.number_rows(series.cut(prices), MARKET, TIME_ORDER)
    points = smooth.smooth(numbered, "p", w, name, size=30).toPandas()
    for exchange in ("alpha", "beta", "gamma"):
        mine = points[points["exchange"] == exchange].sort_values("j")
        want = convolved(of(data, exchange), w, name)
        assert mine["j"].tolist() == list(range(len(want)))
        assert set(mine["n_points"]) == {len(want)}
        assert np.allclose(mine["y"], want)


def test_smooth_edges(prices):
    numbered = blocks.number_rows(series.cut(prices), MARKET, TIME_ORDER)
    assert smooth.smooth(numbered, "p", 2).count() == numbered.count()
    with pytest.raises(ValueError):
        smooth.smooth(numbered, "p", 5, "gauss")
    sizes = {r.exchange: r.n_rows for r in numbered.select("exchange", "n_rows").distinct().collect()}
    width = max(sizes.values())
    thin = {r.exchange for r in smooth.left_out(numbered, width).collect()}
    assert thin == {e for e, n in sizes.items() if n < width}
    points = smooth.smooth(numbered, "p", width, "flat")
    assert {r.exchange for r in points.select("exchange").distinct().collect()} == set(sizes) - thin


@pytest.mark.parametrize("name", ["flat", "hanning"])
def test_smooth_huge_and_undefined_values(spark, name):
    x = [1e17, *([float(i % 7) for i in range(59)]), float("inf"), *([2.0] * 20), None, *([3.0] * 20)]
    rows = [("a", "b/c", i, len(x), v) for i, v in enumerate(x)]
    numbered = spark.createDataFrame(
        rows, "exchange string, instrument string, rn bigint, n_rows bigint, p double"
    )
    got = smooth.smooth(numbered, "p", 5, name, size=40).orderBy("j").toPandas()["y"]
    plain = np.array([np.nan if v is None else v for v in x])
    mirrored = np.r_[plain[4:0:-1], plain, plain[-1:-5:-1]]
    weights = smooth.kernel(name, 5)
    want = [(mirrored[i : i + 5] * weights).sum() for i in range(len(mirrored) - 4)]
    assert np.allclose(got, want, equal_nan=True)


def test_smooth_then_decimate(prices, data):
    w, step = 20, 7
    numbered = blocks.number_rows(series.cut(prices), MARKET, TIME_ORDER)
    points = smooth.decimate_points(smooth.smooth(numbered, "p", w, "flat"), step, trim=w // 2)
    got = points.where("exchange = 'alpha'").orderBy("j").toPandas()["y"]
    want = convolved(of(data, "alpha"), w, "flat")[w // 2 : -(w // 2) + 1][::step]
    assert np.allclose(got, want)
    plain = series.decimate(numbered, 10).where("exchange = 'alpha'")
    assert plain.count() == len(of(data, "alpha")[::10])


def test_lag_vectors(prices, data):
    labeled = smooth.extrema_labels(series.cut(prices, hot_rows=50), TIME_ORDER)
    numbered = blocks.number_rows(labeled, MARKET, TIME_ORDER)
    rows = smooth.lag_vectors(numbered, ["p", "label"], 5, size=1).where("exchange = 'alpha'")
    got = {r["rn"]: (list(r["v"]), r["label"]) for r in rows.collect()}
    x = of(data, "alpha")
    assert sorted(got) == list(range(4, len(x)))
    for i, (vector, label) in got.items():
        assert vector == x[i - 4 : i + 1].tolist()
        extreme = i + 1 < len(x) and (x[i] - x[i - 1]) * (x[i] - x[i + 1]) > 0
        assert label == int(extreme)


def test_extrema_model(prices):
    labeled = smooth.extrema_labels(series.cut(prices), TIME_ORDER)
    numbered = blocks.number_rows(labeled, MARKET, TIME_ORDER)
    vectors = smooth.lag_vectors(numbered, ["p", "label"], 3).where("exchange = 'alpha'").cache()
    model, score = smooth.extrema_model(vectors, iterations=5)
    row = score.first()
    assert model.coefficients.size == 3 and row["n"] == 350 and 0 <= row["accuracy"] <= 1


def test_sample_last(prices, data):
    def want(include):
        rows = [r for r in data if r[0] == "beta"]
        hours = [r[2] // HOUR for r in rows]
        return [
            rows[i][3] for i in range(len(rows))
            if (i + 1 < len(rows) and hours[i] != hours[i + 1]) or (include and i + 1 == len(rows))
        ]

    for include in (False, True):
        got = series.sample_last(prices, "hour", include_last=include).where("exchange = 'beta'")
        assert sorted(r["seq"] for r in got.collect()) == want(include)


def test_profit_and_correlation(prices, data):
    x = of(data, "alpha")
    row = series.max_profit(prices, hot_rows=60).where("exchange = 'alpha'").first()
    d = np.diff(x)
    assert row["up"] == pytest.approx(np.sum(np.maximum(d, 0) / x[:-1]))
    assert row["down"] == pytest.approx(np.sum(np.maximum(-d, 0) / x[:-1]))
    corr = series.serial_corr(prices).where("exchange = 'alpha'").first()
    drop = x[:-1] - x[1:]
    assert corr["corr"] == pytest.approx(np.corrcoef(drop[:-1], drop[1:])[0, 1])
    assert corr["pairs"] == len(x) - 2


def test_int8(prices, data):
    got = series.diff_int8(prices).where("exchange = 'alpha'").orderBy("seq").toPandas()["dp_int8"]
    half = np.diff(of(data, "alpha")) / 2
    want = (half * (127 / np.max(np.abs(half)))).astype(np.int8)
    assert got.tolist() == want.tolist()


def test_zero_prices_and_constant_series(spark):
    rows = [("a", "b/c", i * HOUR, i, p) for i, p in enumerate([0.0, 0.0, 5.0, 5.0])]
    flat = spark.createDataFrame(
        rows, "exchange string, instrument string, time_ns bigint, seq bigint, p double"
    )
    pct = [r["pct"] for r in series.pct_change(flat).orderBy("seq").collect()]
    assert pct == [None, None, 0.0]
    still = flat.withColumn("p", F.lit(2.0))
    assert [r["dp_int8"] for r in series.diff_int8(still).collect()] == [0, 0, 0]


def test_portfolio_by_hand(spark):
    fields = "exchange string, instrument string, time_ns bigint, seq bigint, p double"
    marks = spark.createDataFrame(
        [("a", "b/c", 10, 1, 2.0), ("a", "b/c", 20, 9, 3.0), ("a", "b/c", 20, 10, 4.0)], fields
    )
    fills = spark.createDataFrame(
        [
            ("a", "b/c", 5, 0, 1.0, "x", "buy", 10.0),
            ("a", "b/c", 20, 2, 3.0, "x", "sell", 4.0),
            ("a", "b/c", 30, 3, 5.0, "y", "buy", 1.0),
        ],
        fields + ", account string, side string, amount double",
    )
    got = series.portfolio(fills, marks, cash=100, width=7).orderBy("seq").collect()
    assert [(r["cash"], r["stock"], r["price"], r["value"]) for r in got] == [
        (90.0, 10.0, None, None),
        (102.0, 6.0, 4.0, 126.0),
        (95.0, 1.0, 4.0, 99.0),
    ]


@pytest.mark.parametrize("bins", [1, 7, 100])
def test_histogram_equals_numpy(prices, data, bins):
    rows = stats.histogram(prices, "p", bins).toPandas()
    for exchange in ("alpha", "gamma"):
        mine = rows[rows["exchange"] == exchange].sort_values("bin")
        want, edges = np.histogram(of(data, exchange), bins)
        density, _ = np.histogram(of(data, exchange), bins, density=True)
        assert np.allclose(mine["lo"], edges[:-1]) and np.allclose(mine["hi"], edges[1:])
        assert np.abs(mine["n"].to_numpy() - want).sum() <= 2  # values on an edge
        assert mine["n"].sum() == want.sum()
        if (mine["n"].to_numpy() == want).all():
            assert np.allclose(mine["density"], density)


def test_histogram_of_equal_values(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", None)], "k string, x double")
    got = stats.histogram(rows, "x", 4, ["k"]).orderBy("bin").toPandas()
    want, edges = np.histogram([2.0, 2.0], 4)
    assert got["n"].tolist() == want.tolist() and got["lo"].tolist() == edges[:-1].tolist()


def test_entropy(prices, data):
    counts, _ = np.histogram(of(data, "alpha"), 100)
    p = counts[counts > 0] / counts.sum()
    got = stats.entropy(prices, "p").where("exchange = 'alpha'").first()["entropy"]
    assert got == pytest.approx(-np.sum(p * np.log(p)), abs=0.02)


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 5001])
@pytest.mark.parametrize("kind", ["spread", "tied"])
def test_exact_median(spark, n, kind):
    rng = np.random.default_rng(n)
    x = rng.normal(size=n) if kind == "spread" else rng.integers(0, 3, n).astype(float)
    rows = spark.createDataFrame([(0, float(v)) for v in x] + [(1, 4.0), (0, None)], "k int, x double")
    got = stats.exact_median(rows.repartition(8), "x", ["k"], sketch=100)
    found = {r["k"]: (r["n"], r["median"]) for r in got.collect()}
    assert found == {0: (n, float(np.median(x))), 1: (1, 4.0)}


def test_laplace(prices, data):
    x = of(data, "beta")
    fit = stats.laplace_fit(prices, "p").where("exchange = 'beta'")
    row = fit.first()
    assert row["loc"] == np.median(x)
    assert row["scale"] == pytest.approx(np.mean(np.abs(x - np.median(x))))
    curve = stats.laplace_curve(fit, points=2001).orderBy("i").toPandas()
    area = np.trapezoid(curve["density"], curve["x"])
    assert area == pytest.approx(0.998, abs=1e-3)


def test_structure_exponent_of_a_line(spark):
    """A straight price line has sigma proportional to the lag."""
    rows = spark.range(200).select(
        F.lit("a").alias("exchange"), F.lit("b/c").alias("instrument"),
        F.timestamp_seconds(F.col("id") * 60).alias("bucket"), (F.col("id") * 2.0).alias("p"),
    )
    structure = stats.structure_function(rows, 60 * 10**9, [1, 3, 9])
    assert [r["sigma"] for r in structure.orderBy("lag").collect()] == [2.0, 6.0, 18.0]
    assert stats.structure_exponent(structure, 60).first()["exponent"] == pytest.approx(1.0)


def test_bar_names(prices):
    with pytest.raises(ValueError):
        bars.ohlc(prices, "2h")


def test_monotonic_check(spark):
    rows = spark.createDataFrame(
        [("a", "b/c", s, t) for s, t in enumerate([1, 2, 2, 1, 5, 4])],
        "exchange string, instrument string, seq bigint, time_ns bigint",
    )
    row = series.monotonic_check(rows, width=2).first()
    assert (row["n"], row["violations"]) == (6, 2)


def test_scale_check(spark):
    rows = spark.createDataFrame(
        [("a", "b/c", (1, 2), (1, 0)), ("a", "b/c", (1, 3), (1, 0)), ("z", "b/c", (1, 2), (1, 0))],
        "exchange string, instrument string, price struct<int:bigint,scale:int>, "
        "amount struct<int:bigint,scale:int>",
    )
    got = {r["exchange"]: r["constant"] for r in series.scale_check(rows).collect()}
    assert got == {"a": False, "z": True}

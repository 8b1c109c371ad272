"""Distributions of a value per group: histogram, entropy, exact quantile, Laplace fit.

Every step is an aggregate with map-side combine, so a group with most of the rows is
reduced where it lies. Per-group summaries are settled (written with a known size) when
they join back to the rows, so their first pass runs when the function is called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.settle import settle
from tickloom.schema import MARKET

# Rank error of the first guess of a quantile is rows / SKETCH.
SKETCH = 100_000
# Tail quantiles between which the fitted curve is drawn. Fixed values.
CURVE_TAILS = (0.001, 0.999)


def histogram(
    rows: DataFrame, value: str, bins: int, keys: Sequence[str] = MARKET
) -> DataFrame:
    """``bins`` equal bins from each group's least to its greatest value, the last one closed.

    ``bin, lo, hi, n, density``, empty bins included. If all values are equal the range is
    half a unit to both sides.
    """
    x = F.col(value)
    ends = rows.groupBy(*keys).agg(
        F.min(x).alias("_min"), F.max(x).alias("_max"), F.count(x).alias("_total")
    )
    flat = F.col("_min") == F.col("_max")
    ends = ends.where(F.col("_total") > 0).select(
        *keys,
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_lo"),
        (F.when(flat, F.lit(1.0)).otherwise(F.col("_max") - F.col("_min")) / bins).alias("_step"),
        "_total",
    )
    ends = settle(ends, "ends")
    place = F.floor((x - F.col("_lo")) / F.col("_step")).cast("int")
    counts = (
        rows.where(x.isNotNull())
        .join(ends, list(keys))
        .groupBy(*keys, F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_step")).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_step")).alias("hi"),
        n.alias("n"),
        (n / (F.col("_total") * F.col("_step"))).alias("density"),
    )


def entropy(
    rows: DataFrame, value: str, bins: int = 100, keys: Sequence[str] = MARKET
) -> DataFrame:
    """Entropy (nats) of the histogram's shares."""
    counted = histogram(rows, value, bins, keys).where(F.col("n") > 0)
    n = F.col("n")
    # -sum(p ln p) with p = n / N  equals  ln N - sum(n ln n) / N.
    return counted.groupBy(*keys).agg(
        (F.ln(F.sum(n)) - F.sum(n * F.ln(n)) / F.sum(n)).alias("entropy")
    )


def exact_median(
    rows: DataFrame, value: str, keys: Sequence[str] = MARKET, sketch: int = SKETCH
) -> DataFrame:
    """The exact median per group (mean of the middle two), as ``median``, with ``n``.

    A sketch bounds the median from both sides by twice its guaranteed rank error; rows
    outside the bounds are only counted, rows between them are counted per distinct value.
    Should the bounds ever miss, the job fails rather than give a near value.
    """
    x = F.col(value)
    keys = list(keys)
    near = 2.0 / sketch
    guess = rows.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.percentile_approx(x, [0.5 - near, 0.5 + near], sketch).alias("_guess"),
    )
    bounds = guess.select(
        *keys, "n", F.get("_guess", 0).alias("_lo"), F.get("_guess", 1).alias("_hi")
    )
    bounds = settle(bounds, "bounds")
    place = F.when(x < F.col("_lo"), -1).when(x > F.col("_hi"), 1).otherwise(0)
    counted = (
        rows.where(x.isNotNull())
        .join(bounds, keys)
        .groupBy(*keys, "n", place.alias("_place"), F.when(place == 0, x).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    upto = Window.partitionBy(*keys).orderBy("_place", "_x")
    before = F.coalesce(
        F.sum("_rows").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    ranked = counted.withColumn("_from", before).withColumn("_to", before + F.col("_rows"))

    def at(rank: Column) -> Column:
        here = (F.col("_from") <= rank) & (rank < F.col("_to"))
        missed = F.raise_error(F.lit("median outside its bounds")).cast("double")
        return F.max(
            F.when(here & (F.col("_place") != 0), missed).when(here, F.col("_x"))
        )

    low = F.floor((F.col("n") - 1) / 2)
    high = F.floor(F.col("n") / 2)
    found = ranked.groupBy(*keys, "n").agg(at(low).alias("_a"), at(high).alias("_b"))
    return found.select(*keys, "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"))


def laplace_fit(rows: DataFrame, value: str, keys: Sequence[str] = MARKET) -> DataFrame:
    """Maximum-likelihood ``loc`` (median) and ``scale`` (mean distance from it)."""
    center = settle(exact_median(rows, value, keys), "median")
    return (
        rows.where(F.col(value).isNotNull())
        .join(center, list(keys))
        .groupBy(*keys, "n", F.col("median").alias("loc"))
        .agg(F.avg(F.abs(F.col(value) - F.col("median"))).alias("scale"))
    )


def laplace_curve(
    fit: DataFrame, points: int = 10_000, keys: Sequence[str] = MARKET
) -> DataFrame:
    """The fitted density at evenly spaced ``x`` between its tail quantiles."""
    low, high = CURVE_TAILS
    lo = F.col("loc") + F.col("scale") * F.ln(F.lit(2 * low))
    hi = F.col("loc") - F.col("scale") * F.ln(F.lit(2 * (1 - high)))
    x = F.col("_lo") + F.col("i") * ((F.col("_hi") - F.col("_lo")) / (points - 1))
    return (
        fit.where(F.col("scale") > 0)
        .select(
            *keys, "loc", "scale", lo.alias("_lo"), hi.alias("_hi"),
            F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"),
        )
        .withColumn("x", x)
        .select(
            *keys,
            "i",
            "x",
            (F.exp(-F.abs(F.col("x") - F.col("loc")) / F.col("scale")) / (F.col("scale") * 2))
            .alias("density"),
        )
    )


def structure_function(
    sampled: DataFrame, step_ns: int, lags: Sequence[int], keys: Sequence[str] = MARKET
) -> DataFrame:
    """``sigma`` of price differences over each lag of an evenly sampled series.

    ``sampled`` has one ``p`` per ``(keys, bucket)``; a lag joins buckets ``lag`` steps apart
    that both exist. Keys of the join are unique per bucket, so it spreads evenly.
    """
    keys = list(keys)
    slot = F.expr(f"unix_micros(bucket) * 1000 div {int(step_ns)}L")
    left = sampled.select(*keys, slot.alias("slot"), F.col("p").alias("p0")).withColumn(
        "lag", F.explode(F.array(*[F.lit(int(k)) for k in lags]))
    )
    right = sampled.select(*keys, (slot).alias("_slot"), F.col("p").alias("p1"))
    d = F.col("p1") - F.col("p0")
    return (
        left.withColumn("_slot", F.col("slot") + F.col("lag"))
        .join(right, [*keys, "_slot"])
        .groupBy(*keys, "lag")
        .agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("sigma"))
    )


def structure_exponent(
    structure: DataFrame, step_seconds: float, keys: Sequence[str] = MARKET
) -> DataFrame:
    """Slope of ``ln sigma`` over ``ln`` lag time."""
    time = F.ln(F.col("lag") * F.lit(float(step_seconds)))
    return (
        structure.where(F.col("sigma") > 0)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("lags"),
            F.regr_slope(F.ln("sigma"), time).alias("exponent"),
        )
    )

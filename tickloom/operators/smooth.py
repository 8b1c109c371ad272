"""Smoothing and window vectors over row positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.kernels import KERNELS, kernel
from tickloom.plans import blocks
from tickloom.schema import MARKET

SLAB = 50_000


def left_out(numbered: DataFrame, width: int) -> DataFrame:
    """Markets with fewer rows than ``width``, which :func:`smooth` cannot mirror: with ``n_rows``."""
    return numbered.where((F.col("rn") == 0) & (F.col("n_rows") < width)).select(*MARKET, "n_rows")


def smooth(
    numbered: DataFrame, value: str, width: int, window: str = "hanning", size: int = SLAB
) -> DataFrame:
    """Convolve each market's series with a kernel; the ends are mirrored.

    ``numbered`` has ``rn`` and ``n_rows`` (:func:`blocks.number_rows`). A market of n rows
    gives n + width - 1 points ``j, y``. On the left the mirror leaves out the first value,
    on the right it repeats the last. Widths below 3 return the values. Markets with fewer rows
    than ``width`` give no points; :func:`left_out` lists them. Each point is a sum over its own
    ``width`` values, so a huge or undefined value touches no other points; a null counts as NaN.
    """
    if window not in KERNELS:
        raise ValueError(f"window must be one of {KERNELS}")
    rn, n, w = F.col("rn"), F.col("n_rows"), width
    known = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    values = numbered.select(*MARKET, rn, n, known.alias("x"))
    if w < 3:
        return values.select(*MARKET, rn.alias("j"), n.alias("n_points"), F.col("x").alias("y"))

    positions = F.array_compact(
        F.array(
            rn + (w - 1),
            F.when(rn.between(1, w - 1), F.lit(w - 1) - rn),
            F.when(rn >= n - w + 1, n * 2 + (w - 2) - rn),
        )
    )
    placed = values.where(n >= w).select(*MARKET, n, "x", F.explode(positions).alias("pos"))
    size = max(size, 8 * w)
    # The point j is the kernel over positions j .. j + w - 1.
    points = n + (w - 1)
    first = F.greatest(F.col("pos") - (w - 1), F.lit(0))
    spread = blocks.slabs(placed, first, F.least(F.col("pos"), points - 1), size)
    ahead = Window.partitionBy(*MARKET, "_slab").orderBy("pos").rowsBetween(0, w - 1)
    if window == "flat":
        y = F.avg("x").over(ahead)
    else:
        weights = F.array(*[F.lit(float(k)) for k in kernel(window, w)])
        weighed = F.zip_with(F.collect_list("x").over(ahead), weights, lambda x, k: x * k)
        y = F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b)
    own = (F.col("pos") < points) & (F.floor(F.col("pos") / size) == F.col("_slab"))
    smoothed = spread.withColumn("y", y).where(own)
    return smoothed.select(*MARKET, F.col("pos").alias("j"), points.alias("n_points"), "y")


def decimate_points(points: DataFrame, step: int, trim: int = 0) -> DataFrame:
    """Every ``step``-th point after cutting ``trim`` at the start and ``trim - 1`` at the end."""
    j = F.col("j")
    inside = (j >= trim) & (j < F.col("n_points") - max(trim - 1, 0))
    return points.where(inside & (F.pmod(j - trim, F.lit(step)) == 0))


def extrema_labels(cut: DataFrame, order: list[str]) -> DataFrame:
    """``label`` 1 where ``p`` is above or below both neighbors, else 0; the ends are 0."""
    near = blocks.neighbors(
        cut, MARKET, order, back={"_before": "p"}, ahead={"_after": "p"}
    )
    p, a, b = F.col("p"), F.col("_before"), F.col("_after")
    extreme = ((p > a) & (p > b)) | ((p < a) & (p < b))
    return near.withColumn("label", F.coalesce(extreme, F.lit(False)).cast("int")).drop(
        "_before", "_after"
    )


def lag_vectors(numbered: DataFrame, values: list[str], m: int, size: int = SLAB) -> DataFrame:
    """Add ``v`` = the last ``m`` values of ``values[0]`` up to each row, oldest first.

    Rows with fewer than m values behind them are left out. ``values[1:]`` are kept.
    """
    rn = F.col("rn")
    size = max(size, 8 * m)
    rows = numbered.select(*MARKET, "rn", "n_rows", *values)
    spread = blocks.slabs(rows, rn, F.least(rn + (m - 1), F.col("n_rows") - 1), size)
    window = (
        Window.partitionBy(*MARKET, "_slab").orderBy("rn").rowsBetween(-(m - 1), Window.currentRow)
    )
    return (
        spread.withColumn("v", F.collect_list(values[0]).over(window))
        .where((F.size("v") == m) & (F.floor(rn / size) == F.col("_slab")))
        .drop("_slab")
    )


def extrema_model(vectors: DataFrame, iterations: int = 50, most: int = 1_000_000):
    """Train a linear SVM on each series' first half, predict the second.

    At most ``most`` vectors are learned from, chosen by a hash of market and position. Returns
    the fitted model and a one-row table with the share of right predictions.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    data = vectors.select(
        array_to_vector(F.col("v")).alias("features"),
        F.col("label").cast("double").alias("label"),
        (F.col("rn") < F.col("n_rows") / 2).alias("train"),
        F.struct(*MARKET, "rn").alias("place"),
    )
    learned = data.where("train").orderBy(F.xxhash64("place")).limit(most).select("features", "label")
    model = LinearSVC(maxIter=iterations).fit(learned)
    hits = (F.col("prediction") == F.col("label")).cast("double")
    scored = model.transform(data.where("NOT train"))
    return model, scored.agg(F.count(F.lit(1)).alias("n"), F.avg(hits).alias("accuracy"))

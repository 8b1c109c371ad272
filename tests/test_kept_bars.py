import os

import pytest
from pyspark.sql import functions as F

from tests.test_versions import same
from tickloom.operators import bars
from tickloom.plans import views
from tickloom.sources import kept_bars, versions
from tickloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def files(root):
    found = {}
    for folder, _, names in os.walk(f"{root}/bars"):
        found |= {f"{folder}/{n}": os.stat(f"{folder}/{n}").st_mtime_ns for n in names if n.endswith("parquet")}
    return found


def check(spark, root, rows):
    for subject, every in kept_bars.SUBJECTS.items():
        fresh = bars.ohlc(rows, every)
        kept = kept_bars.read(spark, root, subject)
        assert set(kept.columns) == set(fresh.columns)
        assert same(kept, fresh.select(*kept.columns))


def test_kept_bars_follow_versions(spark, folder):
    rows = views.long_trades(spark, SF).where("seq % 5 = 0").cache()
    assert kept_bars.refresh(spark, folder) is None
    assert kept_bars.read(spark, folder, "ohlc:1h").count() == 0
    late = (F.col("year") == 1996) & (F.col("instrument") == "btc/eur") & (F.col("seq") % 3 == 0)
    ingest.append_batch(rows.where((F.col("year") < 1999) & ~late), 0, folder)
    versions.compact(spark, folder, F.lit("1999-01-02 00:00:00"))
    kept_bars.refresh(spark, folder)
    check(spark, folder, rows.where((F.col("year") < 1999) & ~late))
    first, listed = files(folder), {tuple(r) for r in kept_bars.listed(spark, folder).drop("made_of").collect()}
    # Late trades: only their units get new files.
    ingest.append_batch(rows.where(late | (F.col("year") == 1999)), 1, folder)
    versions.compact(spark, folder, F.lit("1999-03-02 00:00:00"))
    kept_bars.refresh(spark, folder)
    check(spark, folder, rows.where("year <= 1999"))
    now = files(folder)
    assert all(now[name] == time for name, time in first.items())
    again = {tuple(r) for r in kept_bars.listed(spark, folder).drop("made_of").collect()}
    gone = {(r[3], r[4]) for r in listed - again}
    assert gone == {("btc_eur", "1996")}
    assert all(r[4] == "1996" and r[3] == "btc_eur" or r[4].startswith("1999") for r in again - listed)
    # Nothing has changed: nothing is written but an equal list.
    kept_bars.refresh(spark, folder)
    assert files(folder) == now
    assert {tuple(r) for r in kept_bars.listed(spark, folder).drop("made_of").collect()} == again
    # Months become a year.
    versions.compact(spark, folder, F.lit("2000-03-02 00:00:00"))
    kept_bars.refresh(spark, folder)
    check(spark, folder, rows.where("year <= 1999"))
    assert {r.unit for r in kept_bars.listed(spark, folder).collect()} == {str(y) for y in range(1995, 2000)}


def test_unknown_subject(spark, folder):
    with pytest.raises(ValueError, match="subject must be one of"):
        kept_bars.read(spark, folder, "ohlc:5m")


def test_merged_bars_equal_bars_of_trades(spark):
    rows = views.trades(spark, SF).withColumn("unit", F.lit("all"))
    minutes = bars.ohlc(rows, "1m", more=["unit"])
    for every in ("1h", "1d"):
        whole = bars.ohlc(rows, every)
        assert same(kept_bars.merged(minutes, every).select(*whole.columns), whole)

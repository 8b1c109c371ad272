import time

import pytest
from pyspark.sql import functions as F

from tickloom.plans import views
from tickloom.sources import paged
from tickloom.streaming.market_state import keep_batches

SF = "/root/testdata/sf0.001"


def land(rows, folder, parts=3):
    rows.repartitionByRange(parts, "time").sortWithinPartitions("time").write.mode("append").parquet(folder)


def same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_batch_options(spark, folder):
    rows = views.raw_trades(spark, SF)
    land(rows, f"{folder}/landed")
    read = lambda **o: paged.trades(spark, f"{folder}/landed", **o)
    assert read().columns == rows.columns
    assert same(read().select(*rows.columns), rows)
    assert same(paged.trades(spark, f"file://{folder}/landed"), rows)
    first = rows.agg(F.min("time")).first()[0]
    assert same(read(since=repr(first + 86_400)), rows.where(F.col("time") >= first + 86_400))
    assert same(
        read(since="2024-01-05", until="2024-01-06 12:00:00", markets="beta:view/eur,alpha:click/eur"),
        rows.where("time >= 1704412800 AND time < 1704542400")
        .where("concat(exchange, ':', instrument) IN ('beta:view/eur', 'alpha:click/eur')"),
    )
    assert read(since="2030-01-01").count() == 0
    assert paged.markets(spark, f"{folder}/landed").count() == rows.select("exchange", "instrument").distinct().count()


def test_pages_outside_are_not_opened(spark, folder):
    land(views.raw_trades(spark, SF), f"{folder}/landed", parts=6)
    pages = paged.Folder(f"{folder}/landed")
    whole = list(pages.pages())
    assert len(whole) == 6
    low = sorted(p[2] for p in whole)[-1]
    assert len(pages.between(low, float("inf"))) == 1
    assert pages.between(pages.end(), float("inf")) == []


def test_pull_until_now_goes_on_at_since(spark, folder):
    rows = views.raw_trades(spark, SF)
    early, late = rows.where("time < 1705000000"), rows.where("time >= 1705000000")
    read = lambda: spark.read.parquet(f"{folder}/rows").drop("batch_id")
    stream = lambda: paged.trades(spark, f"{folder}/landed", stream=True)
    for part, so_far in ((early, early), (late, rows), (None, rows)):
        if part is not None:
            land(part, f"{folder}/landed")
        query = paged.pull(stream(), keep_batches(f"{folder}/rows"), f"{folder}/check")
        assert query.exception() is None and not query.isActive
        assert same(read(), so_far)
    assert same(read(), paged.trades(spark, f"{folder}/landed"))  # as a stream and in batch


def test_pull_until_timeout_waits_for_more(spark, folder):
    rows = views.raw_trades(spark, SF)
    land(rows.where("seq < 300"), f"{folder}/landed")
    began = time.time()
    stream = paged.trades(spark, f"{folder}/landed", stream=True)
    query = paged.pull(stream, keep_batches(f"{folder}/rows"), f"{folder}/check", until_now=False, timeout=20)
    assert 19 < time.time() - began < 90 and not query.isActive
    assert spark.read.parquet(f"{folder}/rows").count() == 300


def test_errors(spark, folder):
    with pytest.raises(Exception, match="needs the option path"):
        spark.read.format(paged.NAME).load().count()
    with pytest.raises(ValueError, match="needs a timeout"):
        paged.pull(paged.trades(spark, folder, stream=True), print, f"{folder}/check", until_now=False)
    assert paged.trades(spark, f"{folder}/none").count() == 0


def test_seconds():
    assert paged.seconds("1.5") == 1.5
    assert paged.seconds("1970-01-02") == 86_400
    assert paged.seconds("-inf") == float("-inf")

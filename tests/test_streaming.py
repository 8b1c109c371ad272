import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, book
from tickloom.plans import views
from tickloom.schema import RAW_TRADES, TRADE_COLUMNS, TRADES
from tickloom.sources import raw
from tickloom.streaming import bars as stream_bars
from tickloom.streaming import book as stream_book
from tickloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def land(rows, path, parts=4):
    rows.repartitionByRange(parts, "seq").write.mode("append").json(path)


def same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def run(spark, folder):
    stream = ingest.landed_stream(spark, f"{folder}/landing", files_per_batch=2)
    query = ingest.ingest(stream, f"{folder}/lake", f"{folder}/checkpoint")
    query.awaitTermination(300)
    assert query.exception() is None


def test_ingest_equals_batch_and_resumes(spark, folder):
    all_raw = views.raw_trades(spark, SF)
    first, second = all_raw.where("seq < 600"), all_raw.where("seq >= 600")
    land(first, f"{folder}/landing")
    run(spark, folder)
    want = raw.normalize(first).select(*TRADE_COLUMNS)
    assert same(ingest.read_write_ahead(spark, f"{folder}/lake").select(*TRADE_COLUMNS), want)
    run(spark, folder)
    assert ingest.read_write_ahead(spark, f"{folder}/lake").count() == 600
    land(second, f"{folder}/landing", parts=3)
    run(spark, folder)
    got = ingest.read_write_ahead(spark, f"{folder}/lake").select(*TRADE_COLUMNS)
    assert same(got, raw.normalize(all_raw).select(*TRADE_COLUMNS))


def test_bad_numbers_are_rejected(spark, folder):
    seq = F.col("seq")
    rows = (
        views.raw_trades(spark, SF)
        .withColumn("price", F.when(seq == 5, "oops").otherwise(F.col("price")))
        .withColumn("time", F.when(seq != 7, F.col("time")))
        .withColumn("exchange", F.when(seq != 9, F.col("exchange")))
    )
    land(rows, f"{folder}/landing", parts=1)
    run(spark, folder)
    assert ingest.read_write_ahead(spark, f"{folder}/lake").count() == rows.count() - 3
    kept = {r["seq"]: r for r in spark.read.parquet(f"{folder}/lake/rejects").collect()}
    assert {s: r["reason"] for s, r in kept.items()} == {5: "price.int", 7: "time", 9: "exchange"}
    assert kept[5]["price"] == "oops" and kept[7]["misc"] is not None


def test_repeated_batch_replaces_itself(spark, folder):
    rows = views.trades(spark, SF)
    ingest.append_batch(rows, 3, folder)
    ingest.append_batch(rows, 3, folder)
    ingest.append_batch(rows.limit(10), 4, folder)
    assert ingest.read_write_ahead(spark, folder).count() == rows.count() + 10


def test_loaders(spark, folder):
    rows = views.raw_trades(spark, SF)
    land(rows, f"{folder}/json")
    rows.write.parquet(f"{folder}/parquet")
    for name in ("json", "parquet"):
        loaded = raw.load(spark, f"landed_{name}", f"{folder}/{name}")
        assert loaded.schema.fieldNames() == RAW_TRADES.fieldNames()
        assert same(loaded, rows.select(*loaded.columns))
    with pytest.raises(ValueError):
        raw.load(spark, "nowhere", folder)


def test_bars_and_late_trades_hold_every_trade(spark, folder):
    trades = views.trades(spark, SF)
    # One file per batch, out of time order.
    days = trades.select(F.to_date("time").alias("d")).distinct().orderBy("d").collect()
    parts = [days[5:9], days[:5], days[9:], days[3:3]]
    for i, part in enumerate(parts[:3]):
        rows = trades.where(F.to_date("time").isin([r["d"] for r in part]))
        rows = rows.where("seq % 9 <> 0") if i == 0 else rows
        if i == 2:
            first = trades.where(F.to_date("time").isin([r["d"] for r in parts[0]]))
            rows = rows.unionByName(first.where("seq % 9 = 0"))
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/trades")
        source = spark.readStream.schema(TRADES).parquet(f"{folder}/trades")
        query = stream_bars.ingest_bars(source, f"{folder}/bars", f"{folder}/checkpoint", "1d", "1 hour")
        query.awaitTermination(300)
        assert query.exception() is None
    got = stream_bars.read_bars(spark, f"{folder}/bars", "1 hour")
    late = stream_bars.read_late(spark, f"{folder}/bars")
    assert late.count() > 0 and got.where("closed").count() > 0
    assert got.agg(F.sum("trades")).first()[0] + late.count() == trades.count()
    want = bars.ohlc(trades.join(late.select("seq"), "seq", "left_anti"), "1d")
    assert same(got.select(*want.columns), want)
    # A batch that is repeated changes nothing.
    stream_bars.add_batch(spark.read.schema(TRADES).parquet(f"{folder}/trades").limit(0), 9, f"{folder}/bars", "1d", "1 hour")
    assert same(stream_bars.read_bars(spark, f"{folder}/bars", "1 hour"), got)
    with pytest.raises(ValueError):
        stream_bars.ingest_bars(source, folder, folder, "2d")


def test_stream_book_equals_batch_and_stays_small(spark, folder):
    messages = views.messages(spark, SF)
    levels, snapshots = views.levels(messages), views.snapshots(messages)
    messages.repartition(4, "seq").write.parquet(f"{folder}/messages")  # out of order
    stream = (
        spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/messages")
    )
    parts = lambda batch: (views.levels(batch), views.snapshots(batch))
    query = stream_book.ingest_book(stream, parts, f"{folder}/book", f"{folder}/checkpoint")
    query.awaitTermination(300)
    assert query.exception() is None
    want = book.book_full(levels, snapshots)
    assert same(stream_book.read_book(spark, f"{folder}/book").select(*want.columns), want)
    assert stream_book._batches(spark, f"{folder}/book") == [2, 3]
    last = snapshots.groupBy("market_id").agg(F.max("seq").alias("start"))
    live = levels.join(last, "market_id").where("seq >= start").select("market_id", "side", "price").distinct()
    assert spark.read.parquet(f"{folder}/book/levels/3").count() == live.count()
    # A batch that is repeated starts from the table before it.
    stream_book.add_batch(*parts(spark.read.parquet(f"{folder}/messages")), 3, f"{folder}/book")
    assert same(stream_book.read_book(spark, f"{folder}/book").select(*want.columns), want)


def test_missing_numbers_in_a_stream(spark):
    rows = spark.createDataFrame(
        [(1, 1, "trade"), (1, 2, "snapshot"), (1, 5, "delta"), (2, 7, "delta")],
        "market_id int, seq bigint, kind string",
    )
    got = {r["market_id"]: (r["snapshot_seq"], r["missing"]) for r in stream_book.market_state(rows).collect()}
    assert got == {1: (2, 2), 2: (None, 0)}
    gaps = book.seq_gaps(rows).collect()
    assert [(r["market_id"], r["seq_before"], r["seq"], r["missing"]) for r in gaps] == [(1, 2, 5, 2)]


def test_book_without_a_batch_is_empty(spark, folder):
    assert stream_book.read_book(spark, f"{folder}/none").collect() == []

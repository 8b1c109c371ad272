import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_book_history import capture
from tickloom.operators import book
from tickloom.streaming import market_state

MESSAGE = "market_id long, seq long, side string, price {0}, amount {0}"


def land(spark, rows, folder, kind="long"):
    spark.createDataFrame(rows, MESSAGE.format(kind)).repartition(2).write.mode("append").parquet(folder)


def split(rows):
    """Level rows and snapshots; a row without a side is a snapshot."""
    return rows.where("side IS NOT NULL"), rows.where("side IS NULL").select("market_id", "seq")


def run_book(spark, folder, kind="long"):
    stream = spark.readStream.schema(MESSAGE.format(kind)).parquet(f"{folder}/landed")
    changes = market_state.book_changes(*split(stream), shards=3)
    query = market_state.start(changes, market_state.keep_batches(f"{folder}/changes"), f"{folder}/check")
    query.awaitTermination(300)
    assert query.exception() is None
    return market_state.kept_book(spark, f"{folder}/check")


def rows_of(found):
    return sorted(map(tuple, found.collect()))


def test_book_survives_restarts_and_any_order(spark, folder):
    rng = random.Random(2)
    messages = []
    for market, count in ((1, 300), (2, 40)):
        levels, snapshots = capture(rng, market, count)
        messages += levels + [(m, s, None, None, None) for m, s in snapshots]
    levels, _ = capture(rng, 3, 20, snapshot=0)
    messages += levels
    rng.shuffle(messages)  # as late as can be: snapshots come before and after what they clear
    for k in range(3):  # each run starts anew from the checkpoint
        land(spark, messages[k::3] + messages[:10], f"{folder}/landed")
        found = run_book(spark, folder)
        so_far = spark.read.schema(MESSAGE.format("long")).parquet(f"{folder}/landed").distinct()
        assert rows_of(found) == rows_of(book.book_full(*split(so_far)))
    assert len(rows_of(found)) > 5
    again = run_book(spark, folder)  # nothing new has landed
    assert rows_of(again) == rows_of(found)


def test_book_of_decimals(spark, folder):
    kind, tick = "decimal(38,18)", Decimal("0.000000000000000001")
    rows = [(1, 1, None, None, None), (1, 1, "bid", 7 + tick, Decimal(2)), (1, 2, "bid", 7 + 2 * tick, tick), (1, 3, "ask", 8 + tick, Decimal(0))]
    land(spark, rows, f"{folder}/landed", kind)
    assert rows_of(run_book(spark, folder, kind)) == [(1, "bid", 7 + tick, 2), (1, "bid", 7 + 2 * tick, tick)]


def run_gaps(spark, folder, slack):
    stream = spark.readStream.schema("market_id long, seq long").parquet(f"{folder}/landed")
    gaps = market_state.certain_gaps(stream, slack)
    query = market_state.start(gaps, market_state.keep_batches(f"{folder}/gaps"), f"{folder}/check")
    query.awaitTermination(300)
    assert query.exception() is None
    sent = [tuple(r) for r in spark.read.parquet(f"{folder}/gaps").drop("batch_id").collect()]
    return sent, rows_of(market_state.open_gaps(spark, f"{folder}/check"))


def test_gaps_of_late_and_repeated_messages(spark, folder):
    rng = random.Random(3)
    numbers = [(m, s) for m in (1, 2) for s in range(1, 400) if s % 37 and rng.random() < 0.98]
    ordered = sorted(numbers, key=lambda r: r[1] + rng.randint(0, 30))
    schema = "market_id long, seq long"
    for k in range(3):
        part = ordered[k * 260 : (k + 1) * 260 if k < 2 else None]
        spark.createDataFrame(part + part[:20], schema).repartition(3).write.mode("append").parquet(f"{folder}/landed")
        sent, still = run_gaps(spark, folder, 60)
        assert all(kind == "gap" for _, kind, *_ in sent)
        so_far = spark.read.schema(schema).parquet(f"{folder}/landed").distinct()
        sent_rows = sorted((m, a, b, n) for m, _, a, b, n in sent)
        whole = rows_of(book.seq_gaps(spark.createDataFrame(numbers, schema)))
        assert set(sent_rows) <= set(whole)  # what is certain stays so
        assert sorted(sent_rows + still) == rows_of(book.seq_gaps(so_far))
    assert len(sent_rows) > len(still) > 0


def test_too_late_messages_are_told(spark, folder):
    schema = "market_id long, seq long"
    for part in ([(1, s) for s in (1, 2, 5, 6, 50)], [(1, 3), (1, 5), (1, 60)], [(None, 1), (2, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/landed")
        sent, still = run_gaps(spark, folder, 10)
    assert sorted(sent) == [(1, "gap", 2, 5, 2), (1, "gap", 6, 50, 43), (1, "late", 3, 3, 1)]
    assert (1, 50, 60, 9) in still


@pytest.mark.parametrize(
    "spans, wanted",
    [([], []), ([(1, 1), (2, 3)], [(1, 3)]), ([(5, 9), (1, 2), (6, 7), (4, 4)], [(1, 2), (4, 9)]), ([(1, 1), (3, 3)], [(1, 1), (3, 3)])],
)
def test_joined_spans(spans, wanted):
    assert market_state.joined(spans) == wanted


def test_session_setting_stays(spark, folder):
    spark.createDataFrame([(1, 1)], "market_id long, seq long").write.parquet(f"{folder}/landed")
    before = spark.conf.get(market_state.PROVIDER, None)
    run_gaps(spark, folder, 5)
    assert spark.conf.get(market_state.PROVIDER, None) == before
    assert spark.range(1).select(F.lit(1)).count() == 1

import binascii
import json
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.operators import book
from tickloom.sources import frames, messages


def frame(payload):
    body = struct.pack(">H", len(payload)) + payload
    return body + struct.pack(">I", binascii.crc32(body))


def write(folder, name, content):
    with open(f"{folder}/{name}", "wb") as file:
        file.write(content)


def test_frames_of_benchmark_texts(spark, folder):
    texts = {
        r["item_id"]: r["text"].encode()
        for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    }
    for part in range(4):
        mine = [frame(t) for i, t in sorted(texts.items()) if i % 4 == part]
        write(folder, f"{part}.dat", b"".join(mine))
    bad = bytearray(frame(b"broken"))
    bad[-1] ^= 1
    write(folder, "bad.dat", frame(b"") + bytes(bad) + frame(b"x" * 65_535) + frame(b"cut")[:-2])
    captures = frames.read_captures(spark, folder)
    valid = frames.valid_frames(captures).collect()
    assert sorted(bytes(r["payload"]) for r in valid) == sorted(
        [*texts.values(), b"", b"x" * 65_535]
    )
    assert all(r["length"] == len(r["payload"]) for r in valid)
    rejected = {(r["seq"], r["status"]) for r in frames.rejected_frames(captures).collect()}
    assert rejected == {(1, "bad_crc"), (3, "truncated")}


@pytest.mark.parametrize("tail", [b"\x00", b"\x00\x05abc", b"\xff\xff" + b"z" * 100])
def test_truncated_tail(spark, folder, tail):
    write(folder, "a.dat", frame(b"one") + tail)
    rows = frames.split_frames(frames.read_captures(spark, folder)).collect()
    assert [(r["seq"], r["status"]) for r in sorted(rows, key=lambda r: r["seq"])] == [
        (0, "valid"), (1, "truncated")
    ]


def test_packed_captures(spark, folder):
    zstandard = pytest.importorskip("zstandard")
    many = [frame(b"%d" % i * (i % 40)) for i in range(3_000)]
    packer = zstandard.ZstdCompressor()
    write(folder, "a.dat.zst", packer.compress(b"".join(many[:2_000])) + packer.compress(b"".join(many[2_000:])))
    write(folder, "b.dat", b"".join(many))
    rows = frames.valid_frames(frames.read_captures(spark, folder))
    packed = rows.where(F.col("path").endswith(".zst")).drop("path")
    plain = rows.where(F.col("path").endswith(".dat")).drop("path")
    assert packed.count() == 3_000
    assert packed.exceptAll(plain).count() == 0


def test_encoded_frames_are_read_back(spark):
    text = F.concat(F.lit("m"), F.col("id").cast("string"))
    captures = spark.range(50).select(
        F.col("id").cast("string").alias("path"),
        frames.encode_frame(text.cast("binary")).alias("content"),
    )
    good = frames.valid_frames(captures)
    assert good.where(F.col("payload").cast("string") == F.concat(F.lit("m"), "path")).count() == 50


def update(market=7, **parts):
    market = {"exchangeId": 1, "currencyPairId": 2, "marketId": market}
    return json.dumps({"marketUpdate": {**parts, "market": market}}).encode()


def level(price, amount):
    return {"priceStr": price, "amountStr": amount}


CAPTURE = [
    b'{"authenticationResult": {"status": "AUTHENTICATED"}}',
    b'{"subscriptionResult": {}}',
    update(
        tradesUpdate={
            "trades": [
                {"timestamp": 10, "priceStr": "3.25", "amountStr": "35", "timestampNano": 10_000_000_007,
                 "externalId": "a:1", "orderSide": "BUYSIDE"},
                {"timestamp": 11, "priceStr": "3.2", "amountStr": "1", "orderSide": "SELLSIDE"},
            ]
        }
    ),
    update(
        orderBookUpdate={
            "bids": [level("2.10", "5"), level("2.0", "1")], "asks": [level("2.2", "4")], "seqNum": 5
        }
    ),
    update(
        orderBookDeltaUpdate={
            "bids": {"set": [level("2.15", "9")], "removeStr": ["2.1"]},
            "asks": {"set": [level("2.2", "8")]},
            "seqNum": 6,
        }
    ),
    update(orderBookSpreadUpdate={"timestamp": 12_345, "bid": level("2.15", "9"), "ask": level("2.2", "8")}),
    update(market=8, orderBookUpdate={"seqNum": 1}),
]


@pytest.fixture
def parsed(spark, folder):
    write(folder, "capture.dat", b"".join(map(frame, CAPTURE)))
    return messages.parse(frames.valid_frames(frames.read_captures(spark, folder)))


def test_messages(parsed):
    rows = sorted(parsed.select("seq", "kind", "market_id", "seq_num").collect())
    assert [tuple(r) for r in rows] == [
        (2, "trade", 7, None), (3, "snapshot", 7, 5), (4, "delta", 7, 6), (5, "spread", 7, None),
        (6, "snapshot", 8, 1),
    ]
    stats = book.market_stats(parsed).first()
    assert (stats["messages"], stats["exchanges"], stats["markets"]) == (5, 1, 2)


def test_capture_to_book(parsed):
    rows = messages.market_updates(parsed)
    trades = [
        (r["side"], r["time_ns"], str(float(r["price"])))
        for r in rows.where("kind = 'trade'").orderBy("time_ns").collect()
    ]
    assert trades == [("buy", 10_000_000_007, "3.25"), ("sell", 11 * 10**9, "3.2")]
    assert rows.where("kind = 'spread'").select("time_ns").distinct().first()[0] == 12_345 * 10**6
    levels = rows.where("seq_num IS NOT NULL AND side IS NOT NULL").select(
        "market_id", F.col("seq_num").alias("seq"), "side", "price", "amount"
    )
    snapshots = parsed.where("kind = 'snapshot'").select("market_id", F.col("seq_num").alias("seq"))
    state = book.book_full(levels, snapshots)
    got = sorted((r["side"], float(r["price"]), float(r["amount"])) for r in state.collect())
    # 2.10 is removed by 2.1: levels are keyed by value, not by text.
    assert got == [("ask", 2.2, 8.0), ("bid", 2.0, 1.0), ("bid", 2.15, 9.0)]
    best = book.book_spread(state).first()
    assert (float(best["best_bid"]), float(best["best_ask"])) == (2.15, 2.2)
    # Before the delta the snapshot stands alone.
    early = book.book_full(levels, snapshots, until=F.lit(5))
    assert early.count() == 3


def test_prices_with_exponents(spark):
    wanted = {
        "1e-8": "0.00000001", "2.5E3": "2500", "-12e+1": "-120", ".5e1": "5", "0e99": "0", "100e-20": "0.000000000000000001",
        "1e20": None, "1e-19": None, "e5": None, "1e": None, "1.25": "1.25", "x": None,
    }
    trades = [{"priceStr": text, "amountStr": "1e-3", "timestamp": 1} for text in wanted]
    update = {"market": {"exchangeId": "1", "currencyPairId": "2", "marketId": "3"}, "tradesUpdate": {"trades": trades}}
    payload = json.dumps({"marketUpdate": update})
    rows = spark.createDataFrame([("p", 5, payload)], "path string, seq long, payload string")
    parsed = messages.parse(rows.withColumn("payload", F.col("payload").cast("binary")))
    found = sorted(r.price.normalize() for r in messages.market_updates(parsed).collect())
    assert found == sorted(Decimal(v) for v in wanted.values() if v)
    lost = {r.text for r in messages.unreadable_values(parsed).collect()}
    assert lost == {text for text, value in wanted.items() if value is None}

import random

import pytest
from pyspark.sql import functions as F

from tests.test_capture import frame, write
from tickloom.sources import frame_ranges, frames


@pytest.fixture
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "3000")
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def spoiled(content):
    return content[:-1] + bytes([content[-1] ^ 1])


def noise(rng, size):
    return bytes(rng.choices(range(256), k=size))


def files():
    rng = random.Random(12)
    plain = [frame(noise(rng, rng.randint(0, 300))) for _ in range(150)]
    text = [frame(b"line %d\n" % i * rng.randint(1, 9)) for i in range(300)]
    mixed = [spoiled(f) if rng.random() < 0.3 else f for f in plain]
    inner = b"".join(frame(b"\n%d" % i) for i in range(700))  # a payload that holds good frames
    return {
        "plain.dat": b"".join(plain),
        "text.dat": b"".join(text),
        "mixed.dat": b"".join(mixed),
        "all_bad.dat": b"".join(spoiled(f) for f in plain[:60]),
        "nested.dat": b"".join(text[:40] + [frame(inner), frame(b"x\n" * 3000), frame(inner)] + text[40:80]),
        "long.dat": frame(b"\n" * 65_535) + frame(b"a" * 65_535) + frame(b"tail"),
        "cut.dat": b"".join(text[:50]) + frame(b"whole")[:-1],
        "newline.dat": b"".join(text[:50]) + b"\n",
        "mark.dat": b"\xef\xbb" + b"\xbf" * 61_371 + b"1234" + frame(b"ok"),
        "mark_open.dat": b"\xef\xbb\xbf\n",
        "one.dat": frame(b""),
        "byte.dat": b"\x00",
        "empty.dat": b"",
    }


def name_of(rows):
    return rows.withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))


def test_ranges_equal_whole_files(spark, folder, small_ranges):
    for name, content in files().items():
        write(folder, name, content)
    pieces = frame_ranges.read_pieces(spark, folder, piece=2_000)
    counts = {r["path"]: r["count"] for r in name_of(pieces).groupBy("path").count().collect()}
    assert counts["plain.dat"] > 5 and counts["text.dat"] > 3  # one file, many tasks
    for r in name_of(pieces).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("piece", "content"))).alias("c")).collect():
        assert b"".join(bytes(x["content"]) for x in r["c"]) == files()[r["path"]]
    found = name_of(frame_ranges.split_pieces(pieces))
    wanted = name_of(frames.split_frames(frames.read_captures(spark, folder)))
    assert found.columns == wanted.columns
    key = lambda r: (r["path"], r["seq"])
    assert sorted(found.collect(), key=key) == sorted(wanted.collect(), key=key)


def test_one_range_and_no_files(spark, folder):
    write(folder, "a.dat", files()["text.dat"])
    found = frame_ranges.split_pieces(frame_ranges.read_pieces(spark, folder, glob="*.dat"))
    assert found.count() == 300 and found.where("status <> 'valid'").count() == 0
    nothing = frame_ranges.read_pieces(spark, folder, glob="*.none")
    assert frame_ranges.split_pieces(nothing).count() == 0


def test_take_up():
    good = frame(b"abc") + frame(b"") + frame(b"defg")
    assert frame_ranges.take_up(good) == 0
    assert frame_ranges.take_up(b"zz" + good) == 2
    assert frame_ranges.take_up(good[5:]) == 4  # what is left of the first frame
    assert frame_ranges.take_up(spoiled(frame(b"abc")) + good) == len(frame(b"abc"))
    assert frame_ranges.take_up(frame(b"one only")) is None
    assert frame_ranges.take_up(b"") is None

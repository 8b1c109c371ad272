"""The block forms equal plain windows, also with hot keys, hot blocks and equal times."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.plans import blocks

KEYS, ORDER = ["k"], ["t", "seq"]


def skewed(n=900, seed=5):
    """One key with half of the rows; a burst inside one block; many rows at one instant."""
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        key = "hot" if seq % 2 else f"k{seq % 7}"
        kind = rnd.random()
        if kind < 0.3:
            t = 5_000
        elif kind < 0.6:
            t = 7_000 + rnd.randrange(90)
        else:
            t = rnd.randrange(0, 100_000)
        value = None if rnd.random() < 0.4 else rnd.randrange(1000)
        rows.append((key, t, seq, value))
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(skewed(), "k string, t bigint, seq bigint, v bigint").repartition(6)


@pytest.fixture(params=[10**9, 20], ids=["plain", "hot-split"])
def cut(rows, request):
    return blocks.cut_blocks(rows, KEYS, ORDER, 1_000, hot_rows=request.param)


def plain():
    return Window.partitionBy("k").orderBy("t", "seq")


def upto():
    return plain().rowsBetween(Window.unboundedPreceding, 0)


def same(left, right, columns):
    def listed(df):
        return sorted(map(str, df.select("k", "seq", *columns).collect()))

    assert listed(left) == listed(right)


def test_hot_blocks_are_split_in_order(rows):
    cut = blocks.cut_blocks(rows, KEYS, ORDER, 1_000, hot_rows=20)
    whole = blocks.cut_blocks(rows, KEYS, ORDER, 1_000)
    largest = lambda df: df.groupBy("k", "_block").count().agg(F.max("count")).first()[0]
    assert largest(cut) < largest(whole) / 3
    moved_back = cut.withColumn("b", F.lag("_block").over(plain())).where("_block < b").count()
    assert moved_back == 0


def test_neighbors(rows, cut):
    got = blocks.neighbors(cut, KEYS, ORDER, back={"a": "v"}, ahead={"b": "v", "s": "seq"})
    want = rows.select(
        "*", F.lag("v").over(plain()).alias("a"), F.lead("v").over(plain()).alias("b"),
        F.lead("seq").over(plain()).alias("s"),
    )
    same(got, want, ["a", "b", "s"])


def test_running_sum(rows, cut):
    got = blocks.running_sum(cut, KEYS, ORDER, {"total": "v"})
    same(got, rows.withColumn("total", F.sum("v").over(upto())), ["total"])


def test_running_max_before(rows, cut):
    got = blocks.running_max_before(cut, KEYS, ORDER, {"top": "v"})
    before = plain().rowsBetween(Window.unboundedPreceding, -1)
    same(got, rows.withColumn("top", F.max("v").over(before)), ["top"])


def test_known_around(rows, cut):
    got = blocks.known_around(cut, KEYS, ORDER, last={"a": "v"}, next={"b": "v"})
    after = plain().rowsBetween(0, Window.unboundedFollowing)
    want = rows.withColumn("a", F.last("v", True).over(upto())).withColumn(
        "b", F.first("v", True).over(after)
    )
    same(got, want, ["a", "b"])


def test_number_rows(rows, cut):
    got = blocks.number_rows(cut, KEYS, ORDER)
    want = rows.withColumn("rn", F.row_number().over(plain()) - 1).withColumn(
        "n_rows", F.count("*").over(Window.partitionBy("k"))
    )
    same(got, want, ["rn", "n_rows"])


def test_many_hot_blocks_are_joined(rows, monkeypatch):
    monkeypatch.setattr(blocks, "MAX_BROADCAST_HOT", 1)
    cut = blocks.cut_blocks(rows, KEYS, ORDER, 1_000, hot_rows=5)
    got = blocks.running_sum(cut, KEYS, ORDER, {"total": "v"})
    same(got, rows.withColumn("total", F.sum("v").over(upto())), ["total"])


def test_rows_are_shuffled_once_and_not_by_key_alone(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = blocks.cut_blocks(rows, KEYS, ORDER, 1_000)
        plan = blocks.neighbors(cut, KEYS, ORDER, back={"a": "v"})._jdf.queryExecution()
        text = plan.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = text[text.index("SortMergeJoin") : text.index("max_by")]
    # The window's shuffle serves the join too; the summary is shuffled by key, then to the join.
    assert left.count("Exchange hashpartitioning(k") == 3
    assert text.count("_block#") > 0

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import compaction
from tickloom.plans import views
from tickloom.schema import TRADE_COLUMNS
from tickloom.sources import catalog as catalog_source
from tickloom.sources import lake

DAY0 = datetime(2020, 1, 1)


def files(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        market = "hot" if rnd.random() < 0.6 else f"m{rnd.randrange(3)}"
        start = rnd.randrange(0, 500)
        rows.append((market, i, DAY0 + timedelta(days=start), DAY0 + timedelta(days=start + rnd.randrange(1, 40))))
    return rows


def swept(rows):
    """Files kept, where their new part begins, and the shadow of the others, one by one."""
    result = {}
    for market in {r[0] for r in rows}:
        covered, last = None, None
        mine = sorted((r for r in rows if r[0] == market), key=lambda r: (r[2], r[2] - r[3], r[1]))
        for _, i, start, end in mine:
            if covered is None or end > covered:
                result[i] = (True, max(start, covered) if covered else start, None)
                covered, last = end, i
            else:
                result[i] = (False, None, last)
    return result


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot_rows", [10**9, 8])
@pytest.mark.parametrize("name", ["file_id", "string(file_id + 1000) AS file_id"])
def test_shadowing_equals_sweep(spark, seed, hot_rows, name):
    rows = files(seed)
    # Some files cover the same range and differ in their id alone.
    rows += [(m, i + 500, s, e) for m, i, s, e in rows[:40]]
    table = spark.createDataFrame(rows, "market string, file_id bigint, s timestamp, e timestamp")
    table = table.selectExpr("market", name, "s", "e")
    plus = 1000 if "string" in name else 0
    got = {
        int(r["file_id"]) - plus: (
            r["keep"], r["clip_start"], r["shadow"] and int(r["shadow"]["file_id"]) - plus
        )
        for r in compaction.shadowed_files(table, hot_rows=hot_rows).collect()
    }
    assert got == swept(rows)


def overlapping(spark):
    """Each file holds all trades of its time range, so overlaps hold them twice."""
    trades = views.trades(spark, "/root/testdata/sf0.001").withColumn(
        "market", F.concat_ws(":", "exchange", "instrument")
    )
    days = [(1, 6), (4, 9), (5, 8), (9, 20), (9, 12), (20, 31)]
    cuts = spark.createDataFrame(
        [(i, datetime(2024, 1, a), datetime(2024, 1, b)) for i, (a, b) in enumerate(days)],
        "file_id bigint, s timestamp, e timestamp",
    )
    stored = trades.join(cuts, (F.col("time") >= F.col("s")) & (F.col("time") < F.col("e")))
    catalog = trades.select("market").distinct().crossJoin(cuts)
    inside = trades.where("time >= '2024-01-01' AND time < '2024-01-31'")
    return stored.drop("s", "e"), catalog, inside


def test_compaction_keeps_every_row_once(spark, folder):
    stored, catalog, inside = overlapping(spark)
    assert stored.count() > inside.count()
    now = F.lit("2024-02-10").cast("timestamp")
    version = compaction.compact(spark, stored, catalog, now, folder)
    back = spark.read.parquet(f"{version}/trades").withColumn(
        "instrument", F.replace(F.col("instrument"), F.lit("_"), F.lit("/"))
    )
    assert set(r[0] for r in back.select("bucket").distinct().collect()) == {"2024-01"}
    back = back.select(*TRADE_COLUMNS)
    inside = inside.select(*TRADE_COLUMNS)
    check = compaction.version_check(inside, back)
    assert check.where("NOT equal").count() == 0
    assert inside.exceptAll(back).count() == 0 and back.exceptAll(inside).count() == 0

    compaction.publish(spark, folder, "old")
    compaction.publish(spark, folder, version)
    assert compaction.current_version(spark, folder) == version
    assert lake.trades(spark, version).count() == inside.count()


def test_version_check_sees_loss(spark):
    _, _, inside = overlapping(spark)
    lost = inside.where("seq <> 10")
    assert compaction.version_check(inside, lost).where("NOT equal").count() == 1


def test_hive_catalog_feeds_the_plan(spark):
    root = "file:/lake/trades/year={}/exchange=alpha/instrument=btc_eur/source=src_rest/{}"
    tail = ".alpha.btc_eur.src_rest.trades.parquet"
    names = [
        (2020, "2020-03-01"), (2020, "2020-03"), (2020, "2019-12-31"),
        (2020, "2020-03-30T120000.000000000Z.2020-04-02T063000.500000000Z"), (2020, "junk"),
    ]
    paths = spark.createDataFrame(
        [(root.format(y, n) + tail, 10, datetime(2020, 5, 1)) for y, n in names],
        "path string, length bigint, modificationTime timestamp",
    )
    listed = catalog_source.hive_catalog(paths)
    got = sorted((str(r["s"]), str(r["e"]), r["tier"]) for r in listed.collect())
    assert got == [
        ("2020-03-01 00:00:00", "2020-03-02 00:00:00", "day"),
        ("2020-03-01 00:00:00", "2020-04-01 00:00:00", "month"),
        ("2020-03-30 12:00:00", "2020-04-02 06:30:00.500000", "file"),
    ]
    now = F.lit("2020-06-10").cast("timestamp")
    plan = compaction.compaction_plan(listed, now).collect()
    # The whole March is done; the long file joins the bucket of its start.
    assert [(r["bucket"], r["files"], r["action"]) for r in plan] == [("2020-03", 1, "rename")]
    gone = compaction.removable_files(listed, now).collect()
    assert [(r["file_id"].split("/")[-1][:10], r["reason"]) for r in gone] == [("2020-03-01", "remove")]


def test_tiers(spark):
    rows = spark.createDataFrame(
        [
            (0, datetime(2019, 1, 1), datetime(2020, 1, 1), "year"),
            (1, datetime(2019, 5, 1), datetime(2019, 6, 1), "month"),
            (2, datetime(2020, 2, 1), datetime(2020, 3, 1), "month"),
            (3, datetime(2020, 2, 7), datetime(2020, 2, 8), "day"),
            (4, datetime(2020, 4, 3), datetime(2020, 4, 4), "day"),
            (5, datetime(2020, 4, 3), datetime(2020, 4, 4), "file"),
            (6, datetime(2020, 4, 9), datetime(2020, 4, 10), "day"),
        ],
        "file_id int, s timestamp, e timestamp, tier string",
    )
    got = compaction.tier_buckets(rows, F.lit("2020-04-09 12:00")).orderBy("file_id")
    assert [(r["bucket"], r["done"]) for r in got.collect()] == [
        ("2019", True), ("2019", False), ("2020-02", True), ("2020-02", False),
        ("2020-04-03", True), ("2020-04-03", False), ("2020-04-09", False),
    ]

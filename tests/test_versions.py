import os

from pyspark.sql import functions as F

from tickloom import QueryBuilder
from tickloom.plans import views
from tickloom.schema import TRADE_COLUMNS
from tickloom.sources import versions
from tickloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def files(root):
    found = {}
    for folder, _, names in os.walk(f"{root}/trades"):
        found |= {f"{folder}/{n}": os.stat(f"{folder}/{n}").st_mtime_ns for n in names if n.endswith("parquet")}
    return found


def same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_versions(spark, folder):
    rows = views.long_trades(spark, SF).where("seq % 7 = 0").cache()
    assert versions.scan(spark, folder).count() == 0 and versions.catalog(spark, folder).count() == 0
    ingest.append_batch(rows.where("year < 1999"), 0, folder)
    versions.compact(spark, folder, F.lit("1999-01-02 00:00:00"))
    first = files(folder)
    ingest.append_batch(rows.where("year = 1999"), 1, folder)
    ingest.append_batch(rows.where("year = 1996 AND instrument = 'btc/eur'"), 2, folder)  # a second time
    versions.compact(spark, folder, F.lit("1999-03-02 00:00:00"))
    read = QueryBuilder().trades().run(spark, folder, versioned=True)
    assert read.columns == TRADE_COLUMNS and same(read, rows.where("year <= 1999"))
    # Finished years keep their files, but for those that new rows fell into.
    listed = {r["write_id"] for r in versions.catalog(spark, folder).collect()}
    assert len(listed) == 2
    now = files(folder)
    assert all(now[name] == time for name, time in first.items())
    gone = [r["folder"] for r in versions.retired(spark, folder).collect()]
    assert gone and all("year=1996/" in name and "instrument=btc_eur/" in name for name in gone)
    # Months turn to a year: merged where there are several, listed anew where there is one.
    before = {r["unit"] for r in versions.catalog(spark, folder).where("year = 1999").collect()}
    assert "1999-01" in before
    versions.compact(spark, folder, F.lit("2000-03-02 00:00:00"))
    assert {r["unit"] for r in versions.catalog(spark, folder).collect()} == {str(y) for y in range(1995, 2000)}
    assert same(QueryBuilder().trades().run(spark, folder, versioned=True), rows.where("year <= 1999"))
    counts = versions.catalog(spark, folder).agg(F.sum("rows")).first()[0]
    assert counts == rows.where("year <= 1999").count()
    versions.retire(spark, folder)
    assert versions.retired(spark, folder).count() == 0
    assert same(QueryBuilder().trades().run(spark, folder, versioned=True), rows.where("year <= 1999"))


def test_rows_are_shuffled_once(spark, folder, monkeypatch):
    """Rows that occur twice meet in the ranges that are written, with no shuffle of their own."""
    rows = views.long_trades(spark, SF).where("seq % 50 = 0").cache()
    ingest.append_batch(rows, 0, folder)
    ingest.append_batch(rows.where("seq % 100 = 0"), 1, folder)
    write, plans = versions._write, []

    def seen(table, root, now):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return write(table, root, now)

    monkeypatch.setattr(versions, "_write", seen)
    versions.compact(spark, folder, F.lit("1999-01-02 00:00:00"))
    assert plans[0].count("Exchange") == 1 and "rangepartitioning" in plans[0]
    assert same(QueryBuilder().trades().run(spark, folder, versioned=True), rows)


def test_filters_prune_folders_of_a_version(spark):
    root = views.versioned_lake(spark, SF)
    rows = QueryBuilder().trades().columns("time").markets("alpha:click/eur").period("2024-01").run(spark, root, versioned=True)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :]
    assert "exchange" in scan[: scan.index("PushedFilters")]
    assert "ReadSchema: struct<time:timestamp,time_ns:bigint>" in plan

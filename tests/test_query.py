import re

import pytest
from pyspark.sql import functions as F

from tickloom import QueryBuilder, query_trades
from tickloom.functions import timefmt
from tickloom.operators import query as q
from tickloom.plans import views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def root(spark):
    return views.lake_of(spark, SF, "long_trades")


def test_columns_are_canonical_and_unique(spark, root):
    rows = QueryBuilder().columns("source", "price", "time", "time").trades().run(spark, root)
    assert rows.columns == ["time", "price", "source"]


def test_no_columns_means_all(spark, root):
    from tickloom.schema import TRADE_COLUMNS

    assert QueryBuilder().trades().run(spark, root).columns == TRADE_COLUMNS


def test_setters_replace_and_reset():
    builder = QueryBuilder().exchanges("alpha").instruments("btc/eur")
    assert builder.build().exchanges == ("alpha",)
    builder.markets("beta:*")
    assert builder.build().exchanges == () and builder.build().instruments == ()
    builder.instruments(["eth/eur", "btc/eur"])
    assert builder.build().markets == () and len(builder.build().instruments) == 2
    builder.period("2020").reset("start")
    assert builder.build().start is None and builder.build().end == timefmt.instant("2021")
    assert builder.reset("time").build().end is None
    builder.trades().sources("src_rest").columns("time").start("2020").reset("columns", "sources")
    assert builder.build().columns == () and builder.build().sources == ()
    assert str(builder.reset()) == "Query(any subject; everything)"


def test_build_is_frozen():
    builder = QueryBuilder().trades().exchanges("alpha")
    built = builder.build()
    builder.exchanges("beta")
    assert built.exchanges == ("alpha",)


@pytest.mark.parametrize(
    "bad",
    [
        lambda b: b.subject("bars"),
        lambda b: b.trades().columns("nope"),
        lambda b: b.columns("nope").trades(),
        lambda b: b.sources("1x"),
        lambda b: b.exchanges("a b"),
        lambda b: b.instruments("btc"),
        lambda b: b.markets("*:*"),
        lambda b: b.markets("alpha"),
        lambda b: b.markets("alpha:btc"),
        lambda b: b.period("20-20"),
        lambda b: b.reset("everything"),
        lambda b: b.run(None, "/nowhere"),
    ],
)
def test_bad_arguments(bad):
    with pytest.raises(ValueError):
        bad(QueryBuilder())


def test_describe():
    text = str(QueryBuilder().trades().markets("alpha:*").period("2020Q1"))
    assert text == "Query(trades; markets in [alpha:*]; time in 2020Z/2020-04Z)"
    assert "time from 2020Z" in str(QueryBuilder().start("2020"))
    assert "time before 2020-03Z" in str(QueryBuilder().end("2020-03"))


def test_filters_reach_the_scan(spark, root):
    rows = (
        QueryBuilder().trades().columns("time", "price").markets("alpha:btc/eur").period("1997")
        .run(spark, root)
    )
    plan = rows._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    partition = scan[scan.index("PartitionFilters") : scan.index("PushedFilters")]
    assert "exchange" in partition and "instrument" in partition and "year" in partition
    filters = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"year#\d+ >= 1997", filters) and re.search(r"year#\d+ <= 1997", filters)
    pushed = scan[scan.index("PushedFilters") : scan.index("ReadSchema")]
    assert "GreaterThanOrEqual(time_ns" in pushed and "LessThan(time_ns" in pushed
    schema = scan[scan.index("ReadSchema") :].splitlines()[0]
    assert "amount" not in schema and "extra_json" not in schema
    assert "Exchange" not in plan


def test_only_needed_decimal_part_is_read(spark, root):
    rows = QueryBuilder().trades().columns("price").run(spark, root).select(F.col("price.int"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<price:struct<int:bigint>>" in plan


def test_query_trades(spark, root):
    rows = query_trades(spark, root, "alpha:btc/eur", "1997")
    want = views.long_trades(spark, SF).where(
        "exchange = 'alpha' AND instrument = 'btc/eur' AND year = 1997"
    )
    assert rows.count() == want.count() and rows.columns == ["time", "price"]


def test_last_and_first(spark, root):
    rows = QueryBuilder().trades().run(spark, root)
    seqs = [(r["time_ns"], r["seq"]) for r in rows.select("time_ns", "seq").collect()]
    last = [(r["time_ns"], r["seq"]) for r in q.last_rows(rows, 7).collect()]
    first = [(r["time_ns"], r["seq"]) for r in q.first_rows(rows, 7).collect()]
    assert last == sorted(seqs)[-7:] and first == sorted(seqs)[:7]

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import session
from tickloom.plans import views
from tickloom.sources import catalog, lake

SF = "/root/testdata/sf0.001"


def test_write_then_read_is_identity(spark, folder):
    rows = views.trades(spark, SF)
    lake.write(rows, folder, files=5)
    back = lake.trades(spark, folder)
    assert back.columns == rows.columns
    assert rows.exceptAll(back).count() == 0 and back.exceptAll(rows).count() == 0
    path = f"{folder}/trades/year=2024/exchange=alpha/instrument=click_eur/source=src_rest"
    assert os.path.isdir(path)
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(f"{path}/{name}").metadata
            assert meta.row_group(0).column(0).compression == "ZSTD"
            times = pq.read_table(f"{path}/{name}")["time_ns"].to_pylist()
            assert times == sorted(times)


def test_write_replaces_only_its_partitions(spark, folder):
    rows = views.trades(spark, SF)
    lake.write(rows, folder)
    lake.write(rows.where("exchange = 'beta'").limit(3), folder)
    back = lake.trades(spark, folder)
    assert back.where("exchange = 'alpha'").count() == rows.where("exchange = 'alpha'").count()


def test_hot_market_becomes_many_files(spark, folder):
    one = views.trades(spark, SF).withColumn("exchange", F.lit("alpha")).withColumn(
        "instrument", F.lit("btc/eur")
    ).withColumn("source", F.lit("src_rest"))
    lake.write(one, folder, files=6)
    files = [f for _, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]
    assert len(files) >= 5


def test_missing_values_fail(spark, folder):
    bad = views.trades(spark, SF).withColumn("exchange", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="exchange must not be null"):
        lake.write(bad, folder)


def positional(root, subject, source, exchange, instrument, time, rows):
    stored = instrument.replace("/", "_")
    stamp = time.replace(":", "").replace(".", "_")
    where = f"{root}/{subject}/{source}/{exchange}/{stored}/{time[:4]}"
    os.makedirs(where, exist_ok=True)
    path = f"{where}/{stamp}_{source}_{exchange}_{stored}.{subject}.parquet"
    pq.write_table(pa.table({"x": rows}), path)
    return path


FIELDS = T.StructType([T.StructField("x", T.LongType())])


@pytest.fixture
def positional_root(folder):
    positional(folder, "trades", "src-a", "alpha", "btc/eur", "2019", [1, 2])
    positional(folder, "trades", "src-a", "alpha", "btc/eur", "2020-03", [3])
    positional(folder, "trades", "src-b", "beta", "eth/eur/fut-q", "2020-03-04", [4])
    positional(folder, "trades", "src-b", "beta", "eth/eur", "2020-03-04T05:06:07.123456789Z", [5])
    wrong = positional(folder, "trades", "src-b", "beta", "ada/eur", "2020-03-05", [6])
    os.rename(wrong, wrong.replace("_beta_", "_alpha_"))
    return folder


def test_scan_positional(spark, positional_root):
    rows = lake.scan_positional(spark, positional_root, FIELDS)
    got = sorted(tuple(r) for r in rows.collect())
    assert got[0] == (1, 2019, "alpha", "btc/eur", "src-a")
    assert got[3] == (4, 2020, "beta", "eth/eur/fut-q", "src-b")
    some = lake.scan_positional(
        spark, positional_root, FIELDS, instruments=["eth/eur", "btc/eur"], years=[2020]
    )
    assert sorted(r["x"] for r in some.collect()) == [3, 5]
    assert len(some.inputFiles()) == 2


def test_find_orders_and_rejects(spark, positional_root):
    found = [r["file_id"] for r in catalog.find(spark, positional_root).collect()]
    assert found == sorted(found) and len(found) == 4
    assert found[-1] == "trades:src-b:beta:eth/eur:2020-03-04T05:06:07.123456789Z"
    assert catalog.find(spark, positional_root, "trades").count() == 4


def test_load_file(spark, positional_root):
    ids = [r["file_id"] for r in catalog.find(spark, positional_root).collect()]
    loaded = [
        sorted(r["x"] for r in lake.load_file(spark, positional_root, FIELDS, i).collect())
        for i in ids
    ]
    assert loaded == [[1, 2], [3], [4], [5]] or sorted(map(tuple, loaded)) == [(1, 2), (3,), (4,), (5,)]
    with pytest.raises(ValueError):
        lake.load_file(spark, positional_root, FIELDS, "trades:nothing")


class Session:
    """The parts of a session that ``shared_dir`` looks at."""

    def __init__(self, master, **settings):
        self.settings = settings
        self.conf = self
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_shared_dir():
    named = Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://x/shared/"})
    assert session.shared_dir(named) == "hdfs://x/shared"
    assert session.new_folder(named, "a").startswith("hdfs://x/shared/a-")
    assert session.shared_dir(Session("local[2]")) == session.shared_dir(Session("local[2]"))
    with pytest.raises(RuntimeError):
        session.shared_dir(Session("spark://host:7077"))


def test_row_limit_per_file(spark, folder):
    """Files of fixed batches: every file but the last holds exactly the limit."""
    spark.range(1_050).coalesce(1).write.option("maxRecordsPerFile", 250).parquet(f"{folder}/b")
    sizes = sorted(
        pq.ParquetFile(f"{folder}/b/{f}").metadata.num_rows
        for f in os.listdir(f"{folder}/b")
        if f.endswith(".parquet")
    )
    assert sizes == [50, 250, 250, 250, 250]

"""Results that are written before later steps read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import session


# A dimension with more rows is joined by a shuffle.
MOST_ROWS = 1_000_000


def dimension(rows: DataFrame, label: str, most: int = MOST_ROWS) -> DataFrame:
    """A settled table, broadcast if its rows, which are counted, are few."""
    table = settle(rows, label)
    return F.broadcast(table) if table.count() <= most else table


def settle(rows: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder and read them back.

    Meant for a per-group summary that joins to large rows, and for narrow rows behind a
    shuffle that several passes read. The planner cannot tell how far an aggregate shrinks its input and would shuffle the
    large side of a join with it. A written table has a known size: below Spark's broadcast
    threshold it is broadcast and the large side stays where it is, above it Spark takes a
    shuffled join. The table also survives lost executors and is not computed twice. It
    stays in the shared folder, which the cluster's owner clears.
    """
    spark = rows.sparkSession
    folder = session.new_folder(spark, label)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)

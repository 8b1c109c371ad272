"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.columns import settle, tasks


def salted(rows: DataFrame, by: str) -> DataFrame:
    """Rows with a column ``salt`` that spreads a key's rows, by the hash of another column."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(tasks(rows))))


def with_group(
    rows: DataFrame, key: str, by: str, name: str, value: Column, merge, label: str | None = None
) -> DataFrame:
    """The rows with ``name``: an aggregate of ``value`` over their key, by any shuffle's width.

    ``merge`` is an aggregate that may be applied in two steps (min, max, sum). Rows are combined
    by (key, salt), then by key; the result goes back to the salts that a key has, and each row
    finds it by (key, salt). So no task gets all rows of a key. ``rows`` is read twice: give a
    settled table, or a label to settle the salted rows here.
    """
    spread = salted(rows, by)
    if label:
        spread = settle(spread, label)
    parts = spread.groupBy(key, "salt").agg(merge(value).alias(name))
    whole = parts.groupBy(key).agg(merge(F.col(name)).alias(name), F.collect_list("salt").alias("salts"))
    tags = whole.select(key, name, F.explode("salts").alias("salt"))
    return spread.join(tags, [key, "salt"]).drop("salt")


def lookup(rows: DataFrame, key: str, by: str, table: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row for each key.

    The table's row is first copied to the salts that a key has among the rows, so that no task
    gets all rows of a key. ``rows`` is read twice.
    """
    spread = salted(rows, by)
    wanted = spread.select(key, "salt").distinct().join(table, key)
    return spread.join(wanted, [key, "salt"], "left").drop("salt")

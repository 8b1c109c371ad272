"""Column expressions and folders that several operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import session

#: A word: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it.

    Spark may inline a projected column into each place that reads it; a lambda's variable is
    never inlined.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the plain ``lower``, which is faster."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def md5_bits(key: Column, digits: int) -> Column:
    """The first ``digits`` (15 at most) hexadecimal digits of the key's MD5 as a long."""
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("long")


def tasks(rows: DataFrame) -> int:
    """How many tasks a shuffle of this session has."""
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def settle(rows: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder and read them back: computed once, safe from lost executors."""
    spark = rows.sparkSession
    folder = session.new_folder(spark, label)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def ragged(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... counts[0] times, then the same of the next, and so on."""
    ends = np.cumsum(counts)
    return np.repeat(begins - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)

"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(session.prepare(spark), sf_dir)

        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Doubles for comparison: rounded, without a negative zero."""
    value = F.round(value, digits)
    return F.when(value == 0, 0.0).otherwise(value)


def sql_rounded(value: str, digits: int = 6) -> str:
    return f"CASE WHEN round({value}, {digits}) = 0 THEN 0::DOUBLE ELSE round({value}, {digits}) END"


def micros(time: Column | str) -> Column:
    return F.unix_micros(F.col(time) if isinstance(time, str) else time)

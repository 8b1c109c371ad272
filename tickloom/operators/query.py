"""Fluent queries over the trade lake."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions import numbers, symbols, timefmt
from tickloom.sources import lake, versions

SUBJECT_COLUMNS = {"trades": schema.TRADE_COLUMNS}

LIST_KEYS = ["columns", "sources", "exchanges", "instruments", "markets"]
TIME_KEYS = ["start", "end"]


def _either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _market_condition(market: str) -> Column:
    exchange, instrument = market.lower().split(":")
    sides = {"exchange": exchange, "instrument": instrument.replace("/", "_")}
    chosen = [F.col(c) == v for c, v in sides.items() if v != "*"]
    return reduce(lambda a, b: a & b, chosen)


@dataclass(frozen=True)
class Query:
    """A frozen query. ``filters`` speak of the stored columns, so they prune folders."""

    subject: str | None = None
    columns: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    exchanges: tuple[str, ...] = ()
    instruments: tuple[str, ...] = ()
    markets: tuple[str, ...] = ()
    start: pd.Timestamp | None = None
    end: pd.Timestamp | None = None

    @property
    def filters(self) -> list[Column]:
        found = []
        if self.sources:
            found.append(F.col("source").isin(list(self.sources)))
        if self.exchanges:
            found.append(F.col("exchange").isin([e.lower() for e in self.exchanges]))
        if self.instruments:
            stored = [i.lower().replace("/", "_") for i in self.instruments]
            found.append(F.col("instrument").isin(stored))
        if self.markets:
            found.append(_either([_market_condition(m) for m in self.markets]))
        # The year prunes folders, the nanoseconds skip row groups.
        if self.start is not None:
            found += [F.col("year") >= self.start.year, F.col("time_ns") >= self.start.value]
        if self.end is not None:
            last = self.end - pd.Timedelta(1, "ns")
            found += [F.col("year") <= last.year, F.col("time_ns") < self.end.value]
        return found

    def run(self, spark: SparkSession, root: str, versioned: bool = False) -> DataFrame:
        """The lazy result over the lake below ``root``; ``versioned``: over its current version."""
        if not self.subject:
            raise ValueError("Query: you must specify the subject")
        scan = versions.scan if versioned else lake.scan
        rows = reduce(DataFrame.where, self.filters, scan(spark, root, self.subject))
        chosen = self.columns or tuple(SUBJECT_COLUMNS[self.subject])
        plain = symbols.from_path(F.col("instrument")).alias("instrument")
        return rows.select(*[plain if c == "instrument" else c for c in chosen])

    def describe(self) -> str:
        """One line: the subject and every restriction that is set."""
        parts = [f"{key} in [{', '.join(getattr(self, key))}]" for key in LIST_KEYS if getattr(self, key)]
        if self.start is not None and self.end is not None:
            parts.append(f"time in {timefmt.Span(self.start, self.end)}")
        elif self.start is not None:
            parts.append(f"time from {timefmt.short_text(self.start)}")
        elif self.end is not None:
            parts.append(f"time before {timefmt.short_text(self.end)}")
        return f"Query({self.subject or 'any subject'}; {'; '.join(parts) or 'everything'})"

    __str__ = __repr__ = describe


@dataclass
class QueryBuilder:
    """Collects a query; every setter replaces what it set before and returns the builder.

    >>> print(QueryBuilder().trades().columns("price", "time").markets("alpha:btc/eur"))
    Query(trades; columns in [time, price]; markets in [alpha:btc/eur])
    """

    _state: dict = field(default_factory=dict)

    def subject(self, name: str) -> QueryBuilder:
        if name not in SUBJECT_COLUMNS:
            raise ValueError(f"Invalid subject: {name!r}")
        self._state["subject"] = name
        self._order_columns()
        return self

    def trades(self) -> QueryBuilder:
        return self.subject("trades")

    def columns(self, *names) -> QueryBuilder:
        self._set("columns", names)
        self._order_columns()
        return self

    def sources(self, *names) -> QueryBuilder:
        return self._set("sources", names, symbols.check_source)

    def exchanges(self, *names) -> QueryBuilder:
        return self.reset("markets")._set("exchanges", names, symbols.check_exchange)

    def instruments(self, *names) -> QueryBuilder:
        return self.reset("markets")._set("instruments", names, symbols.check_instrument)

    def markets(self, *names) -> QueryBuilder:
        return self.reset("exchanges", "instruments")._set(
            "markets", names, symbols.check_market
        )

    def start(self, time) -> QueryBuilder:
        self._state["start"] = timefmt.instant(time)
        return self

    def end(self, time) -> QueryBuilder:
        self._state["end"] = timefmt.instant(time)
        return self

    def period(self, value) -> QueryBuilder:
        span = timefmt.period(value)
        return self.start(span.start).end(span.end)

    def reset(self, *keys) -> QueryBuilder:
        """Clear the given keys (``time`` and ``period`` mean start and end), or everything."""
        names = self._listed(keys)
        if not names:
            self._state.clear()
        for name in names:
            if name in ("time", "period"):
                self.reset("start", "end")
            elif name in ["subject", *LIST_KEYS, *TIME_KEYS]:
                self._state.pop(name, None)
            else:
                raise ValueError(f"reset: Invalid key: {name}")
        return self

    def build(self) -> Query:
        return Query(**copy.copy(self._state))

    def run(self, spark: SparkSession, root: str, versioned: bool = False) -> DataFrame:
        return self.build().run(spark, root, versioned)

    def __str__(self) -> str:
        return self.build().describe()

    __repr__ = __str__

    @staticmethod
    def _listed(args: tuple) -> list[str]:
        if len(args) == 1 and isinstance(args[0], (list, tuple)):
            args = tuple(args[0])
        return [str(a) for a in args]

    def _set(self, key: str, args: tuple, check=None) -> QueryBuilder:
        values = self._listed(args)
        for value in values:
            if check:
                check(value)
        self._state[key] = tuple(values)
        return self

    def _order_columns(self) -> None:
        """Once the subject is known: check the columns and put them in canonical order."""
        subject, chosen = self._state.get("subject"), self._state.get("columns")
        if not subject or not chosen:
            return
        known = SUBJECT_COLUMNS[subject]
        for name in chosen:
            if name not in known:
                raise ValueError(f"Invalid column: {name!r}")
        self._state["columns"] = tuple(c for c in known if c in chosen)


def query_trades(
    spark: SparkSession, root: str, market: str, period: str, columns=("time", "price")
) -> DataFrame:
    """Trades of one market and period."""
    return (
        QueryBuilder().trades().columns(list(columns)).markets(market).period(period)
        .run(spark, root)
    )


def to_numbers(
    rows: DataFrame, decimals_as_floats: bool = False, timestamps_as_floats: bool = False
) -> DataFrame:
    """Decimals as their units or as doubles; with ``timestamps_as_floats``, ``time_ns`` as
    epoch seconds in ``time_s``."""
    for name in ("price", "amount"):
        if name in rows.columns:
            value = numbers.as_double(F.col(name)) if decimals_as_floats else F.col(name)["int"]
            rows = rows.withColumn(name, value)
    if timestamps_as_floats and "time_ns" in rows.columns:
        rows = rows.withColumn("time_s", F.col("time_ns") / F.lit(1e9))
    return rows


def last_rows(rows: DataFrame, n: int = 10_000) -> DataFrame:
    """The last ``n`` rows in time, in time order. Each task keeps ``n`` rows at most."""
    newest = rows.orderBy(*[F.col(c).desc() for c in schema.TIME_ORDER]).limit(n)
    return newest.orderBy(*schema.TIME_ORDER)


def first_rows(rows: DataFrame, n: int = 10_000) -> DataFrame:
    return rows.orderBy(*schema.TIME_ORDER).limit(n)


def count_rows(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"))

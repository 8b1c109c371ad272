"""File ids and paths of lake files.

A file id is ``subject:source:exchange:instrument:time``. The positional layout stores it as
``subject/source/exchange/instrument/year/time_source_exchange_instrument.subject.parquet``,
the hive layout as ``subject/year=/exchange=/instrument=/source=/period.….parquet``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import symbols, timefmt
from tickloom.plans.pin import pin

def file_id(
    subject: Column, source: Column, exchange: Column, instrument: Column, time: Column
) -> Column:
    return F.concat_ws(":", subject, source, exchange, instrument, time)


def checked_parts(rows: DataFrame) -> DataFrame:
    """Keep rows whose ``subject, source, exchange, instrument, time`` make a file id.

    Adds ``time_kind``: year, month, day or timestamp.
    """
    size, time = F.length("time"), F.col("time")
    kind = (
        F.when(size == 4, "year").when(size == 7, "month").when(size == 10, "day")
        .otherwise("timestamp")
    )
    real = F.when(
        F.col("time_kind") == "timestamp", timefmt.parse_time(time).isNotNull()
    ).otherwise(timefmt.calendar_parts(time).isNotNull())
    return rows.withColumn("time_kind", kind).where(
        symbols.is_subject(F.col("subject"))
        & symbols.is_symbol(F.col("source"))
        & symbols.is_symbol(F.col("exchange"))
        & symbols.split_instrument(F.col("instrument")).isNotNull()
        & real
    )


def parse_file_ids(rows: DataFrame, column: str = "file_id") -> DataFrame:
    """Add the parts of file ids; malformed ids are left out.

    A subject may hold a colon itself, so the parts are counted from the known subject on.
    """
    low = F.lower(F.col(column))
    subject = F.coalesce(
        *[F.when(F.startswith(low, F.lit(name + ":")), F.lit(name)) for name in symbols.SUBJECTS]
    )
    rest = F.split(F.substring(low, F.length("subject") + 2, F.length(low)), ":", 4)
    known = pin(rows, subject=subject).where(F.col("subject").isNotNull())
    parts = pin(known, _rest=rest).where(F.size("_rest") == 4)
    return checked_parts(
        pin(
            parts,
            source=F.get("_rest", 0),
            exchange=F.get("_rest", 1),
            instrument=F.get("_rest", 2),
            time=F.upper(F.get("_rest", 3)),
        ).drop("_rest")
    )


def positional_path(
    subject: Column, source: Column, exchange: Column, instrument: Column, time: Column
) -> Column:
    stored = symbols.to_path(instrument)
    stamp = F.replace(F.replace(time, F.lit(":"), F.lit("")), F.lit("."), F.lit("_"))
    name = F.concat(
        F.concat_ws("_", stamp, source, exchange, stored), F.lit("."), subject, F.lit(".parquet")
    )
    return F.concat_ws(
        "/", subject, source, exchange, stored, F.substring(time, 1, 4), name
    )


def hive_path(
    subject: Column,
    source: Column,
    exchange: Column,
    instrument: Column,
    start_ns: Column,
    end_ns: Column,
    short: bool = False,
) -> Column:
    stored = symbols.to_path(instrument)
    span = timefmt.span_text(start_ns, end_ns, short)
    span = F.replace(F.replace(span, F.lit("/"), F.lit(".")), F.lit(":"), F.lit(""))
    year = F.year(timefmt.to_time(start_ns)).cast("string")
    return F.concat_ws(
        "/",
        subject,
        F.concat(F.lit("year="), year),
        F.concat(F.lit("exchange="), exchange),
        F.concat(F.lit("instrument="), stored),
        F.concat(F.lit("source="), source),
        F.concat_ws(".", span, exchange, stored, source, subject, F.lit("parquet")),
    )


def parse_positional_paths(rows: DataFrame, column: str = "path") -> DataFrame:
    """Add the parts of positional paths; a path whose folders disagree with its file name,
    or whose parts are malformed, is left out."""
    folders = F.split(F.col(column), "/")

    def folder(back: int) -> Column:
        return F.try_element_at("_folders", F.lit(-back))

    day, clock = F.get("_stem", 0), F.get("_stem", 1)
    # Long names keep the time of day as HHMMSS_nnnnnnnnnZ.
    full = F.concat(
        F.substring(day, 1, 13), F.lit(":"), F.substring(day, 14, 2), F.lit(":"),
        F.substring(day, 16, 2), F.lit("."), clock,
    )
    named = pin(rows, _folders=folders)
    named = pin(named, _name=F.split(folder(1), r"\."))
    named = named.where((F.size("_name") == 3) & (F.get("_name", 2) == "parquet"))
    named = pin(named, _stem=F.split(F.get("_name", 0), "_")).where(
        F.size("_stem").between(5, 7)
    )
    named = pin(named, _skip=F.when(F.length(day) > 10, 2).otherwise(1))
    rest = F.slice("_stem", F.col("_skip") + 3, F.size("_stem"))
    parts = pin(
        named,
        subject=F.get("_name", 1),
        source=F.get("_stem", F.col("_skip")),
        exchange=F.get("_stem", F.col("_skip") + 1),
        instrument=F.array_join(rest, "/"),
        time=F.when(F.col("_skip") == 2, full).otherwise(day),
    )
    agree = (
        (folder(6) == F.col("subject"))
        & (folder(5) == F.col("source"))
        & (folder(4) == F.col("exchange"))
        & (folder(3) == symbols.to_path(F.col("instrument")))
        & (folder(2) == F.substring("time", 1, 4))
    )
    return checked_parts(parts.where(agree).drop("_folders", "_name", "_stem", "_skip"))


def parse_hive_paths(rows: DataFrame, column: str = "path") -> DataFrame:
    """Add the parts of hive-layout paths: ``subject, source, exchange, instrument``, the range
    ``s, e`` and ``tier``. A short name is a year, month or day; others have the tier ``file``.

    Paths whose folders disagree with their name, or with an unreadable range, are left out.
    """
    named = pin(rows, _folders=F.split(F.col(column), "/"))
    named = pin(named, _name=F.split(F.try_element_at("_folders", F.lit(-1)), r"\."))
    named = named.where(F.size("_name").isin(6, 9))
    first = F.get("_name", 0)
    long = F.size("_name") == 9
    # Full names are start.fraction.end.fraction with the colons left out.
    clock = r"T(\d{2})(\d{2})(\d{2})"
    both = F.concat_ws(
        ".", first, F.concat_ws("/", F.get("_name", 1), F.get("_name", 2)), F.get("_name", 3)
    )
    size = F.length(first)
    tier = F.when(size == 4, "year").when(size == 7, "month").when(size == 10, "day")
    at = F.when(long, 4).otherwise(1)
    named = pin(
        named,
        _period=F.when(long, F.regexp_replace(both, clock, "T$1:$2:$3")).otherwise(first),
        _at=at,
        tier=F.when(long, "file").otherwise(tier),
    )

    def part(i: int) -> Column:
        return F.get("_name", F.col("_at") + i)

    parts = pin(
        named,
        subject=part(3),
        source=part(2),
        exchange=part(0),
        instrument=symbols.from_path(part(1)),
    )
    agree = F.array_join(F.slice("_folders", F.size("_folders") - 4, 4), "/") == F.concat_ws(
        "/",
        F.concat(F.lit("year="), F.substring("_period", 1, 4)),
        F.concat(F.lit("exchange="), F.col("exchange")),
        F.concat(F.lit("instrument="), symbols.to_path(F.col("instrument"))),
        F.concat(F.lit("source="), F.col("source")),
    )
    return (
        timefmt.periods(parts.where(agree & F.col("tier").isNotNull()), "_period")
        .where(F.col("start").isNotNull())
        .withColumnsRenamed({"start": "s", "end": "e"})
        .drop("_folders", "_name", "_period", "_at")
    )

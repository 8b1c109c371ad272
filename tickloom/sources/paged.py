"""Landed pages of raw trades as a Spark data source with a ``since``.

``spark.read.format("landed_trades")`` reads the pages of a landing folder, ``spark.readStream`` reads
them as they come. A page is a row group of a Parquet file with the columns of raw trades; its
time range is in the file's footer, so pages outside of what is asked for are not opened, and each page
that is opened is a task of its own. The stream's offset is ``since``: the least time that was not
read yet. As with any source that is paged by time, a row that lands after a later one was read, in a later batch,
is not seen by the stream; a batch read sees it. Rows without a time are on no page: ``raw.rejects``
of the landed files lists them.

Options: ``path``; ``since`` and ``until`` (seconds since 1970, or a time as ``2024-01-05 10:00:00``;
the first included, the second not); ``markets`` (``exchange:base/quote``, several with commas).
Folders may be anything that ``pyarrow.fs`` opens from its address.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tickloom import schema

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "landed_trades"
COLUMNS = schema.RAW_TRADES.fieldNames()
FIELDS = schema.RAW_TRADES.json()


def seconds(text: str) -> float:
    """A number of seconds, or a UTC time in ISO form."""
    try:
        return float(text)
    except ValueError:
        return datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()


@dataclass(frozen=True)
class Page(InputPartition):
    """One row group of one file, and the times that are wanted of it."""

    file: str
    group: int
    since: float
    until: float


class Folder:
    """The pages of a landing folder. Footers are read once for each file; files do not change."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.known: dict[str, list[tuple[float, float]]] = {}

    def open(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return pafs.FileSystem.from_uri(self.path)
        return pafs.LocalFileSystem(), self.path

    def pages(self) -> Iterator[tuple[str, int, float, float]]:
        """File, row group, least and greatest time, of files whose writing is over."""
        fs, root = self.open()
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in sorted(found, key=lambda i: i.path):
            parts = info.path[len(root) :].strip("/").split("/")
            if not info.is_file or not info.path.endswith(".parquet") or any(p[:1] in "._" for p in parts):
                continue
            if info.path not in self.known:
                with fs.open_input_file(info.path) as file:
                    self.known[info.path] = _ranges(pq.ParquetFile(file))
            for group, (low, high) in enumerate(self.known[info.path]):
                yield info.path, group, low, high

    def between(self, since: float, until: float) -> list[Page]:
        return [Page(f, g, since, until) for f, g, low, high in self.pages() if high >= since and low < until]

    def end(self) -> float:
        """The least time after all that has landed."""
        return math.nextafter(max((high for *_, high in self.pages()), default=-math.inf), math.inf)


def _ranges(file: pq.ParquetFile) -> list[tuple[float, float]]:
    """The time range of each row group; the widest one where the footer has none."""
    at = file.schema_arrow.get_field_index("time")
    found = []
    for group in range(file.num_row_groups):
        column = file.metadata.row_group(group).column(at)
        known = column.statistics
        if known is not None and known.has_min_max:
            found.append((float(known.min), float(known.max)))
        elif file.metadata.row_group(group).num_rows:
            found.append((-math.inf, math.inf))
        else:
            found.append((math.inf, -math.inf))
    return found


class _Pages:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError(f"{NAME} needs the option path")
        self.folder = Folder(options["path"])
        self.since = seconds(options.get("since", "-inf"))
        self.until = seconds(options.get("until", "inf"))
        self.markets = [m.strip() for m in options.get("markets", "").split(",") if m.strip()]

    def read(self, page: Page | None) -> Iterator[pa.RecordBatch]:
        if page is None:  # what Spark hands out when there are no pages
            return
        fs, _ = self.folder.open()
        with fs.open_input_file(page.file) as file:
            rows = pq.ParquetFile(file).read_row_group(page.group, columns=COLUMNS)
        time = rows["time"]
        wanted = pc.and_(pc.greater_equal(time, page.since), pc.less(time, page.until))
        if self.markets:
            named = pc.binary_join_element_wise(rows["exchange"], rows["instrument"], ":")
            wanted = pc.and_(wanted, pc.is_in(named, pa.array(self.markets)))
        yield from rows.filter(wanted).select(COLUMNS).to_batches()


class PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.folder.between(self.since, self.until)


class PageStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"since": self.since}

    def latestOffset(self) -> dict:
        return {"since": max(self.since, min(self.folder.end(), self.until))}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.folder.between(start["since"], end["since"])

    def commit(self, end: dict) -> None:
        pass


class LandedTrades(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(FIELDS))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PageStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to the session by its name."""
    spark.dataSource.register(LandedTrades)


def trades(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """Raw trades of a landing folder, once or as a stream."""
    register(spark)
    reader = spark.readStream if stream else spark.read
    return reader.format(NAME).options(path=path, **options).load()


def markets(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The markets that have landed: ``exchange, instrument``."""
    return trades(spark, path, **options).select("exchange", "instrument").distinct()


def pull(
    rows: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    until_now: bool = True,
    timeout: float | None = None,
    every: str = "1 second",
) -> StreamingQuery:
    """Pull a stream's pages into ``write``, and return when it has stopped.

    With ``until_now`` it stops once all that has landed is read, else it waits for more; in either
    case it stops after ``timeout`` seconds, leaving the batch at hand to the next pull, which goes
    on at the checkpoint's ``since``. Without both it would never stop, which is an error.
    """
    if not until_now and timeout is None:
        raise ValueError("a pull that does not end with what has landed needs a timeout")
    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if until_now else writer.trigger(processingTime=every)
    query = writer.start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
    return query

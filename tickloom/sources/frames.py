"""Capture files: length-prefixed frames with a checksum.

A frame is a two-byte big-endian length, the payload, and a four-byte big-endian CRC32
over length and payload. Lengths chain, so one task walks one file; it only hops over the
headers and hands out slices. The checksum is compared by Spark's own ``crc32``. A file must
fit Spark's limit for one binary value (2 GB); ``sources/frame_ranges.py`` reads larger ones, in
many tasks each.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator
from itertools import count
from typing import BinaryIO

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Executors get the functions below with the job; they need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD, TAIL = 2, 4
FRAMES_PER_BATCH = 10_000
UNPACK_BYTES = 1 << 20
SPLIT = "path string, seq bigint, raw binary, crc bigint"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of capture files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _open(path: str, content: bytes) -> BinaryIO:
    """The file's frames as a stream; ``.zst`` files are unpacked piece by piece."""
    if not path.endswith(".zst"):
        return io.BytesIO(content)
    import zstandard

    unpacked = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
    return io.BufferedReader(unpacked, UNPACK_BYTES)


def _walk(path: str, content: bytes) -> Iterator[tuple]:
    """Frames of one file; what is left when no whole frame remains has a null checksum."""
    file = _open(path, content)
    for seq in count():
        head = file.read(HEAD)
        if not head:
            return
        raw = head + file.read(int.from_bytes(head, "big") if len(head) == HEAD else 0)
        tail = file.read(TAIL)
        whole = len(head) == HEAD and len(tail) == TAIL
        if not whole:
            yield path, seq, raw + tail, None
            return
        yield path, seq, raw, int.from_bytes(tail, "big")


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def table(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["path", "seq", "raw", "crc"])
        return frame.astype({"crc": "Int64"})

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows: list[tuple] = []
            for row in _walk(path, bytes(content)):
                rows.append(row)
                if len(rows) == FRAMES_PER_BATCH:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)


def with_status(frames: DataFrame) -> DataFrame:
    """``path, seq, payload, length, status`` of frames ``path, seq, raw, crc``."""
    status = (
        F.when(F.col("crc").isNull(), "truncated")
        .when(F.crc32("raw") == F.col("crc"), "valid")
        .otherwise("bad_crc")
    )
    payload = F.when(F.col("crc").isNotNull(), F.substring(F.col("raw"), HEAD + 1, 1 << 16))
    return frames.select(
        "path",
        "seq",
        payload.alias("payload"),
        F.octet_length(payload).alias("length"),
        status.alias("status"),
    )


def split_frames(captures: DataFrame) -> DataFrame:
    """``path, seq, payload, length, status`` with status valid, bad_crc or truncated."""
    return with_status(captures.select("path", "content").mapInPandas(_split, SPLIT))


def valid_frames(captures: DataFrame) -> DataFrame:
    return split_frames(captures).where(F.col("status") == "valid").drop("status")


def rejected_frames(captures: DataFrame) -> DataFrame:
    return split_frames(captures).where(F.col("status") != "valid")


def encode_frame(payload: Column) -> Column:
    """The bytes of one frame; payloads hold at most 65,535 bytes."""
    size = F.octet_length(payload)
    head = F.unhex(F.lpad(F.hex(size), 2 * HEAD, "0"))
    body = F.concat(head, payload)
    return F.concat(body, F.unhex(F.lpad(F.hex(F.crc32(body)), 2 * TAIL, "0")))


def frame_stats(frames: DataFrame, every: int) -> DataFrame:
    """Frames and bytes per capture file after each ``every`` frames, with running totals."""
    chunk = F.floor(F.col("seq") / every).cast("bigint")
    upto = (
        Window.partitionBy("path")
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        frames.groupBy("path", chunk.alias("chunk"))
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.sum(F.col("length").cast("bigint")).alias("bytes"),
        )
        .select(
            "path",
            "chunk",
            "frames",
            "bytes",
            F.sum("frames").over(upto).alias("total_frames"),
            F.sum("bytes").over(upto).alias("total_bytes"),
        )
    )

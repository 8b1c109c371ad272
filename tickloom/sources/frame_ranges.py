"""Capture files of any size, each read by many tasks.

A file is read in byte ranges by Spark's text source, which cuts at the byte of a line feed and hands
the bytes between out unchanged, so one file is as many tasks as its size asks for and none holds
the whole. Frames chain by their lengths and a range begins anywhere, so each piece looks for the chain: the
first place from which several frames in a row have the right checksum. What lies between the last
whole frame of one piece and the first of the next is a seam, and seams are walked on their own.
A seam that does not end where the next piece began shows that this beginning was no frame (a payload may
itself hold frames); the piece then joins the seam and is walked again, until all fit. Frames,
numbers and statuses are those of ``sources/frames.py``. Packed files cannot be cut; read them there.
"""

from __future__ import annotations

import binascii
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.plans.settle import dimension, settle
from tickloom.sources.frames import HEAD, TAIL, with_status

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a piece, about; a longer stretch without a line feed makes a longer piece.
PIECE = 4 << 20
#: Frames in a row whose checksums must fit where a piece's chain is taken up.
CHAIN = 2
#: Offsets that are tried for that. Any chain has a frame start within the longest frame's size.
LONGEST = HEAD + 0xFFFF + TAIL
MOST_TRIED = 2 * LONGEST

BOM = b"\xef\xbb\xbf"
FRAME = "path string, piece bigint, part int, no bigint, raw binary, crc bigint"


def read_pieces(spark: SparkSession, path: str, glob: str | None = None, piece: int = PIECE) -> DataFrame:
    """Pieces ``path, piece, content`` of the files, which are written once to the shared folder;
    ``piece`` counts from 0 in a file. Range sizes are those of ``spark.sql.files.maxPartitionBytes``."""
    reader = spark.read.format("text").option("lineSep", "\n")
    lines = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    at = F.col("_metadata")
    rows = lines.select(
        at["file_path"].alias("path"), at["file_block_start"].alias("range"), at["file_size"].alias("size"),
        F.col("value").cast("binary").alias("value"),
    )

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines of a range come in order; they are put together again to pieces."""
        key, no, held, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            names = ["path", "range", "size", "no", "content"]
            return pa.RecordBatch.from_pydict(
                dict(zip(names, [[key[0]], [key[1]], [key[2]], [no], [b"\n".join(held) + b"\n"]], strict=True)),
                pa.schema([("path", pa.string()), ("range", pa.int64()), ("size", pa.int64()), ("no", pa.int64()), ("content", pa.binary())]),
            )

        for batch in batches:
            keys = zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)
            for new, line in zip(keys, batch.column(3).to_pylist(), strict=True):
                if held and (new != key or size >= piece):
                    yield out()
                    no, held, size = (no + 1 if new == key else 0), [], 0
                key = new
                held.append(line)
                size += len(line) + 1
        if held:
            yield out()

    cut = settle(rows.mapInArrow(glue, "path string, range bigint, size bigint, no bigint, content binary"), "ranges")
    file = Window.partitionBy("path")
    order = file.orderBy("range", "no")
    # One row for each piece, without its bytes.
    places = cut.select("path", "range", "no", "size", F.octet_length("content").cast("bigint").alias("n"))
    # The reader drops a byte order mark, and does not tell whether the last line has an end.
    lost = F.col("size") - F.sum("n").over(file)
    numbered = places.select(
        "path", "range", "no",
        (F.row_number().over(order) - 1).cast("bigint").alias("piece"),
        lost.isin(2, 3).alias("marked"),
        lost.isin(-1, 2).alias("open"),
        (F.lead("no").over(order).isNull()).alias("last"),
    )
    whole = cut.join(dimension(numbered, "places"), ["path", "range", "no"])
    bytes_ = F.when((F.col("piece") == 0) & F.col("marked"), F.concat(F.lit(BOM), "content")).otherwise(F.col("content"))
    kept = F.when(F.col("last") & F.col("open"), F.substring("content", F.lit(1), F.octet_length("content") - 1))
    whole = whole.withColumn("content", bytes_).withColumn("content", F.coalesce(kept, "content"))
    return whole.select("path", "piece", "content")


def _frame(content: bytes, at: int) -> int | None:
    """The end of the whole frame that begins here."""
    end = at + HEAD + int.from_bytes(content[at : at + HEAD], "big") + TAIL
    return end if at + HEAD <= len(content) and end <= len(content) else None


def _good(content: bytes, at: int, end: int) -> bool:
    return binascii.crc32(content[at : end - TAIL]) == int.from_bytes(content[end - TAIL : end], "big")


def take_up(content: bytes, chain: int = CHAIN) -> int | None:
    """The first offset at which ``chain`` good frames follow each other, if one is found."""
    for at in range(min(len(content), MOST_TRIED)):
        place = at
        for _ in range(chain):
            end = _frame(content, place)
            if end is None or not _good(content, place, end):
                break
            place = end
        else:
            return at
    return None


def walk(content: bytes, at: int) -> tuple[list[tuple[bytes, int]], int]:
    """The whole frames (without checksum, checksum) from an offset on, and where they end."""
    found = []
    while (end := _frame(content, at)) is not None:
        found.append((content[at : end - TAIL], int.from_bytes(content[end - TAIL : end], "big")))
        at = end
    return found, at


# Parts of a piece: its whole frames, the seam that follows, and bytes that go into a seam.
BODY, SEAM, BEFORE, AFTER = 0, 1, 2, 3


def _walked(pieces: DataFrame) -> DataFrame:
    """Rows of :data:`FRAME`: the frames of each piece, then its bytes before and behind them. A piece
    whose chain is not found is all ``before``. ``start`` says that a piece must not take up a chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, piece, content, lost in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                start = 0 if piece == 0 else None if lost else take_up(content)
                rows = []
                if start is None:
                    rows.append((path, piece, BEFORE, 0, content, None))
                else:
                    found, end = walk(content, start)
                    rows += [(path, piece, BODY, k, raw, crc) for k, (raw, crc) in enumerate(found)]
                    rows.append((path, piece, BEFORE, 1, content[:start], None))
                    rows.append((path, piece, AFTER, 0, content[end:], None))
                yield _frames(rows)

    return pieces.select("path", "piece", "content", "lost").mapInArrow(run, FRAME)


def _frames(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("path", pa.string()), ("piece", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("raw", pa.binary()), ("crc", pa.int64())]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def _seams(edges: DataFrame) -> DataFrame:
    """Frames of the seams. ``crc`` is null for what is left; where something is left and a piece
    follows, the seam does not fit."""
    fresh = F.when((F.col("part") == BEFORE) & (F.col("no") == 1), 1).otherwise(0)
    # Bytes before a chain close the seam of the pieces before; those behind open a new one.
    order = Window.partitionBy("path").orderBy("piece", "part").rowsBetween(Window.unboundedPreceding, -1)
    ends = edges.select("path", "piece", "part", fresh.alias("ends"))
    named = ends.select("path", "piece", "part", F.coalesce(F.sum("ends").over(order), F.lit(0)).alias("seam"))
    grouped = edges.join(dimension(named, "seams"), ["path", "piece", "part"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["piece", "part"])
        path, piece = frame["path"].iloc[0], int(frame["piece"].iloc[0])
        content = b"".join(map(bytes, frame["raw"]))
        found, end = walk(content, 0)
        rows = [(path, piece, SEAM, k, raw, crc) for k, (raw, crc) in enumerate(found)]
        closed = bool(((frame["part"] == BEFORE) & (frame["no"] == 1)).any())
        if end < len(content):
            next_piece = int(frame["piece"].iloc[-1]) if closed else -1
            rows.append((path, piece, SEAM, len(found), content[end:], None if next_piece < 0 else -1 - next_piece))
        out = pd.DataFrame(rows, columns=["path", "piece", "part", "no", "raw", "crc"])
        return out.astype({"crc": "Int64"})

    return grouped.drop("crc").select("path", "piece", "part", "no", "raw", "seam").groupBy("path", "seam").applyInPandas(run, FRAME)


def split_pieces(pieces: DataFrame) -> DataFrame:
    """``path, seq, payload, length, status`` as of :func:`frames.split_frames`, in as many tasks as
    there are pieces."""
    lost = pieces.select("path", "piece").limit(0)
    while True:
        marked = lost.select("path", "piece", F.lit(True).alias("lost"))
        taken = pieces.join(marked, ["path", "piece"], "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
        walked = settle(_walked(taken), "walked")
        seams = settle(_seams(walked.where(F.col("part") >= BEFORE)), "seams")
        # A negative checksum names the piece at which a seam did not end.
        wrong = seams.where("crc < 0").select("path", (-1 - F.col("crc")).alias("piece"))
        if wrong.isEmpty():
            break
        lost = settle(lost.unionByName(wrong).distinct(), "lost")
    frames = walked.where(F.col("part") == BODY).unionByName(seams)
    # One row for each piece's frames and each seam tells how many frames come before.
    segments = frames.groupBy("path", "piece", "part").count()
    order = Window.partitionBy("path").orderBy("piece", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("path", "piece", "part", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("first"))
    found = frames.join(dimension(starts, "starts"), ["path", "piece", "part"])
    return with_status(found.select("path", (F.col("first") + F.col("no")).alias("seq"), "raw", "crc"))

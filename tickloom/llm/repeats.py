"""Long repeats across documents, found by a run-length compressed index of suspect passages.

A window is a string of ``WINDOW`` bytes. Documents are packed into blocks; the windows of a block
that share their smallest 16-byte hash form a segment, and all windows with one content have one
such value, wherever they stand. So values (and the segments that carry them) can be dealt out to
shards, and each shard sees every copy of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.columns import tasks
from tickloom.llm.words import mix

#: Bytes that must match, bytes of the hashed pieces, and windows of a segment at most.
WINDOW, PIECE, LONGEST = 50, 16, 64

#: Bytes of text in a block, and text behind each shard.
BLOCK, SHARD = 4 << 20, 16 << 20

#: Segment bytes that are indexed together.
INDEX = 1 << 20

#: Of a window's places for its smallest piece, how many are told apart by one stretch around that piece.
NEAR = 9

#: Sorts after every document; the id of rows without one.
NO_ID = (1 << 63) - 1

#: Ends a segment. UTF-8 has no such byte.
END = 0xFF


def _press(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpress(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _join(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _split(data: bytes, number: int) -> list[bytes]:
    ends = 8 * number + np.cumsum(np.frombuffer(data[: 8 * number], np.int64))
    return [data[a:b] for a, b in zip([8 * number, *ends[:-1]], ends, strict=True)]


@dataclass
class Segments:
    """Runs of neighbouring windows of a block: the first one's place, how many, their value,
    and the index of their document."""

    start: np.ndarray
    number: np.ndarray
    value: np.ndarray
    owner: np.ndarray


def segments(data: np.ndarray, sizes: np.ndarray) -> Segments:
    """Of all documents in a block; ``data`` holds their bytes one after the other."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return Segments(none, none, none.astype(np.uint64), none)
    words = np.ndarray((len(data) - 7,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,)).copy()
    least = mix(mix(words[: len(words) - 8]) + words[8:])
    reach, span = 1, WINDOW - PIECE + 1  # pieces that a window holds
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    ends = np.cumsum(sizes)
    edges = np.zeros(len(data) + 1, np.int64)
    inner = sizes >= WINDOW
    np.add.at(edges, (ends - sizes)[inner], 1)
    np.add.at(edges, (ends - WINDOW + 1)[inner], -1)
    places = np.flatnonzero(np.cumsum(edges)[: len(least)] > 0)
    if not len(places):
        return Segments(none, none, none.astype(np.uint64), none)
    values = least[places]
    fresh = np.ones(len(places), bool)
    fresh[1:] = (places[1:] != places[:-1] + 1) | (values[1:] != values[:-1])
    begin = np.flatnonzero(fresh)
    along = np.arange(len(places)) - np.repeat(begin, np.diff(begin, append=len(places)))
    begin = np.flatnonzero(along % LONGEST == 0)
    start = places[begin]
    return Segments(
        start, np.diff(begin, append=len(places)), values[begin], np.searchsorted(ends, start, "right")
    )


def _by_shard(found: Segments, ids: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard: its distinct values in the block, sorted, and which several documents have."""
    order = np.argsort(found.value, kind="stable")
    values, docs = found.value[order], ids[found.owner[order]]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)
    several = np.zeros(0, bool)
    if len(values):
        several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
    values = values[first]
    target = (mix(values) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order], prepend=-1))
    for at, to in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        mine = order[at:to]
        yield int(target[mine[0]]), values[mine], several[mine]


class RunIndex:
    """A run-length compressed Burrows-Wheeler transform of segments, with a sample for each run.

    Suffixes are sorted up to the end of their segment, then by the segment's number. A run holds
    neighbouring rows whose preceding byte is the same and whose windows are, too; its sample is
    the smallest document that has the window. ``number[r]`` counts the run's byte before it, which
    gives the step to the row of the suffix that is one byte longer.
    """

    def __init__(self, parts: list[bytes], docs: np.ndarray) -> None:
        text = np.frombuffer(bytes([END]).join(parts) + bytes([END]) * 9, np.uint8)
        n = len(text) - 8
        self.lengths = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(self.lengths + 1) - 1
        owner = np.repeat(np.arange(len(parts)), self.lengths + 1)
        left = ends[owner] - np.arange(n)  # bytes up to the end of the segment
        rows, at_window = self._sort(text, n, left)
        there = left >= WINDOW
        sample = np.full(int(at_window.max()) + 1, NO_ID, np.int64)
        np.minimum.at(sample, at_window[there], docs[owner[there]])
        whole = there[rows]
        window = np.where(whole, at_window[rows], -1)
        before = text[rows - 1]  # for the first byte of all, the last separator
        change = np.ones(n, bool)
        change[1:] = (before[1:] != before[:-1]) | (window[1:] != window[:-1])
        self.begin = np.flatnonzero(change)
        self.byte = before[self.begin]
        self.sample = np.where(window[self.begin] >= 0, sample[window[self.begin]], NO_ID)
        sizes = np.diff(self.begin, append=n)
        bits = np.packbits(change, bitorder="little")
        self.heads = np.append(bits, np.zeros(-len(bits) % 8, np.uint8)).view("<u8")
        counts = np.bitwise_count(self.heads).astype(np.int64)
        self.before = np.cumsum(counts) - counts  # runs that begin before each 64 rows
        order = np.argsort(self.byte, kind="stable")
        counted = np.cumsum(sizes[order]) - sizes[order]
        heads = np.flatnonzero(np.diff(self.byte[order].astype(np.int64), prepend=-1))
        base = np.repeat(counted[heads], np.diff(heads, append=len(order)))
        self.number = np.empty(len(order), np.int64)
        self.number[order] = counted - base
        self.first = np.zeros(257, np.int64)  # rows of suffixes that begin with a smaller byte
        self.first[1:] = np.cumsum(np.bincount(text[:n], minlength=256))
        self.last_rows = n - len(parts) + np.arange(len(parts))

    @staticmethod
    def _sort(text: np.ndarray, n: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted rows' places, and for each place a number of its first ``WINDOW`` bytes."""
        words = np.ndarray((n,), ">u8", buffer=text, strides=(1,)).astype(np.uint64)
        short = left < 8
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.minimum(left, 7).astype(np.uint64))
        words[short] |= keep[short]
        rank, depth, half = RunIndex._rank(words), 8, None
        while depth < LONGEST + WINDOW:
            if depth == 32:
                half = rank
            following = np.full(n, n, np.uint64)
            there = left >= depth
            following[there] = rank[np.flatnonzero(there) + depth]
            rank = RunIndex._rank(rank * np.uint64(n + 1) + following)
            depth *= 2
        there = np.flatnonzero(left >= WINDOW)
        window = np.zeros(n, np.int64)
        pair = half[there] * np.uint64(n + 1) + half[there + WINDOW - 32]
        window[there] = RunIndex._rank(pair).astype(np.int64)
        # Equal ends of segments: in the segments' order.
        return np.argsort(rank * np.uint64(n + 1) + np.arange(n, dtype=np.uint64)), window

    @staticmethod
    def _rank(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        fresh = np.zeros(len(keys), np.uint64)
        fresh[1:] = keys[order[1:]] != keys[order[:-1]]
        out = np.empty(len(keys), np.uint64)
        out[order] = np.cumsum(fresh)
        return out

    def _runs(self, rows: np.ndarray) -> np.ndarray:
        """The run that each row is in, by the rank of its bit among the heads of runs."""
        word = rows >> 6
        upto = self.heads[word] << (63 - (rows & 63)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(upto) - 1

    def stream(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Read all segments from their ends, side by side, one byte a round.

        Gives, once the match is as long as a window, (bytes read, segments, sample): the smallest
        document that has the window at the segment's length less the bytes read.
        """
        lanes = np.argsort(-self.lengths, kind="stable")
        rows = self.last_rows[lanes]
        for matched in range(1, int(self.lengths.max(initial=0)) + 1):
            active = int(np.searchsorted(-self.lengths[lanes], -matched, "right"))
            lanes, rows = lanes[:active], rows[:active]
            run = self._runs(rows)
            rows = self.first[self.byte[run]] + self.number[run] + rows - self.begin[run]
            if matched >= WINDOW:
                run = self._runs(rows)
                yield matched, lanes, self.sample[run]


def first_documents(parts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each segment and window of it: the smallest document whose segments have that window."""
    index = RunIndex(parts, docs)
    numbers = index.lengths - WINDOW + 1
    starts = np.cumsum(numbers) - numbers
    flat = np.empty(int(numbers.sum()), np.int64)
    for matched, lanes, sample in index.stream():
        flat[starts[lanes] + index.lengths[lanes] - matched] = sample
    return np.split(flat, starts[1:])


def may_meet(parts: list[bytes], values: np.ndarray) -> np.ndarray:
    """For each segment: whether it may have a window in common with another one of its value.

    A window holds its smallest piece at one of 35 places. Any ``NEAR`` neighbouring places have a
    stretch of 42 bytes around the piece in common, so segments with a common window have one of
    the four stretches in common, and segments that have none need no search.
    """
    lengths = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(parts)), lengths)
    n = len(owner)
    data = np.frombuffer(b"".join(parts) + bytes(PIECE), np.uint8)
    words = np.ndarray((n + 8,), "<u8", buffer=data, strides=(1,)).copy()
    pieces = mix(mix(words[:n]) + words[8 : n + 8])
    at = np.flatnonzero(pieces == values[owner])
    size = WINDOW - NEAR + 1
    keys, whose = [], []
    for before in range(0, WINDOW - PIECE + 1, NEAR):
        start, own = at - before, owner[at]
        inside = (start >= ends[own] - lengths[own]) & (start + size <= ends[own])
        start, own = start[inside], own[inside]
        key = values[own] + np.uint64(before)
        for step in (*range(0, size - 7, 8), size - 8):
            key = mix(key + words[start + step])
        keys.append(key)
        whose.append(own)
    keys, whose = np.concatenate(keys), np.concatenate(whose)
    found = np.zeros(len(parts), bool)
    if len(keys):
        order = np.argsort(keys)
        keys, whose = keys[order], whose[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        several = np.minimum.reduceat(whose, first) != np.maximum.reduceat(whose, first)
        found[whose[np.repeat(several, np.diff(first, append=len(keys)))]] = True
    return found


def firsts_of(parts: list[bytes], docs: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """As ``first_documents``, of all distinct segments of some values; only those that may have a
    window in common are indexed."""
    firsts = [np.full(len(p) - WINDOW + 1, doc) for p, doc in zip(parts, docs.tolist(), strict=True)]
    some = np.flatnonzero(may_meet(parts, values))
    if len(some):
        for i, own in zip(some, first_documents([parts[i] for i in some], docs[some]), strict=True):
            firsts[i] = own
    return firsts


def _pack(rows: DataFrame) -> DataFrame:
    """Blocks of documents: (block, ids, sizes, text), the text compressed."""
    schema = pa.schema(
        [
            ("block", pa.string()),
            ("ids", pa.list_(pa.int64())),
            ("sizes", pa.list_(pa.int64())),
            ("text", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, number = [], [], 0, 0

        def block(part: int) -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            row = {"block": f"{part}-{number}", "ids": ids, "sizes": [len(t) for t in texts], "text": data}
            return pa.RecordBatch.from_pylist([row], schema)

        part = 0
        for batch in batches:
            for at, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = at
                ids.append(own)
                texts.append(text)
                size += len(text)
                if size >= BLOCK:
                    yield block(part)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield block(part)

    kind = "block string, ids array<long>, sizes array<long>, text binary"
    return rows.select(F.spark_partition_id(), "doc_id", "text").mapInArrow(run, kind)


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
    return ids, np.array(row["sizes"], np.int64), _unpress(row["text"], "u1")


_DEALT = pa.schema([("shard", pa.int64()), ("block", pa.string()), ("data", pa.binary())])
_DEALT_SQL = "shard long, block string, data binary"


def _dealt(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _DEALT)


def _chosen(found: Segments, ids: np.ndarray, shards: int, bits: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which segments have a value that several documents have, and the shards of those."""
    parts = []
    for shard, values, _ in _by_shard(found, ids, shards):
        if shard in bits:
            parts.append(values[np.unpackbits(np.frombuffer(bits[shard], np.uint8), count=len(values)).astype(bool)])
    wanted = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    place = np.searchsorted(wanted, found.value)
    hit = place < len(wanted)
    hit[hit] = wanted[place[hit]] == found.value[hit]
    mine = np.flatnonzero(hit)
    return mine, (mix(found.value[mine]) % np.uint64(shards)).astype(np.int64)


def _strings(data: np.ndarray, found: Segments, mine: np.ndarray, target: np.ndarray):
    """Per shard, the distinct segments in a fixed order: (shard, texts, for each of the chosen
    segments of that shard its index among them, their places in ``mine``)."""
    text = data.tobytes()
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order], prepend=-1))
    for at, to in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        places = order[at:to]
        known: dict[bytes, int] = {}
        begins = found.start[mine[places]].tolist()
        numbers = found.number[mine[places]].tolist()
        index = [
            known.setdefault(text[b : b + n + WINDOW - 1], len(known))
            for b, n in zip(begins, numbers, strict=True)
        ]
        yield int(target[places[0]]), list(known), np.array(index), mine[places]


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id (a long), n_bytes, spans (array of start, stop), kept (binary).

    A byte belongs to a span if a window of 50 bytes that covers it also starts in a document with
    a smaller id, judged on the texts as given; ``kept`` is the text without its spans.

    1. Documents are packed into blocks, moved once, compressed; all later steps read these.
    2. Each block deals the values of its segments out to shards, which answer which of them
       several documents have.
    3. Each block sends the distinct segments with such values, and the smallest document of each,
       to their shards. A shard takes those whose value several distinct segments have, indexes
       those of them that have a longer stretch in common too (``may_meet``, ``RunIndex``), reads them through the index, and answers with the smallest document of
       every window.
    4. Each block marks the windows whose smallest document is smaller than their own.

    A passage in very many documents comes to its shard once from each block, and a shard indexes
    its segments in portions of about 1 MB that hold a value's segments together. Null texts count
    as empty. Null ids come after all others and do not mark each other. Equal ids do not mark
    each other either. Only the two named columns are read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(tasks(docs), -(-total // SHARD))
    blocks = _pack(rows).repartition("block")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, sizes, data = _open(row)
                out = []
                for shard, values, several in _by_shard(segments(data, sizes), ids, shards):
                    steps = _press(np.diff(values, prepend=np.uint64(0)))
                    packed = _join(steps, np.packbits(several).tobytes())
                    out.append({"shard": shard, "block": row["block"], "data": packed})
                yield from _dealt(out).to_batches()

    def compare(table: pa.Table) -> pa.Table:
        given = []
        for row in table.to_pylist():
            steps, flags = _split(row["data"], 2)
            values = np.cumsum(_unpress(steps, "u8"), dtype=np.uint64)
            several = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(values)).astype(bool)
            given.append((row, values, several))
        all_values = np.sort(np.concatenate([values for _, values, _ in given]))
        twice = np.unique(all_values[1:][all_values[1:] == all_values[:-1]])
        out = []
        for row, values, several in given:
            place = np.searchsorted(twice, values)
            there = place < len(twice)
            there[there] = twice[place[there]] == values[there]
            if (there | several).any():
                out.append(row | {"data": np.packbits(there | several).tobytes()})
        return _dealt(out)

    def send(block: pa.Table, answers: pa.Table) -> pa.Table:
        bits = {row["shard"]: row["data"] for row in answers.to_pylist()}
        out = []
        for row in block.to_pylist() if bits else []:
            ids, sizes, data = _open(row)
            found = segments(data, sizes)
            for shard, texts, index, mine in _strings(data, found, *_chosen(found, ids, shards, bits)):
                least = np.full(len(texts), NO_ID, np.int64)
                np.minimum.at(least, index, ids[found.owner[mine]])
                value = np.zeros(len(texts), np.uint64)
                value[index] = found.value[mine]
                lengths = np.array([len(t) for t in texts], np.int32)
                body = np.frombuffer(b"".join(texts), np.uint8)
                packed = _join(bits[shard], *map(_press, (lengths, least, value, body)))
                out.append({"shard": shard, "block": row["block"], "data": packed})
        return _dealt(out)

    def answer(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        least: list[int] = []
        value_of: list[int] = []
        sent = []
        for row in table.to_pylist():
            flags, lengths, docs_of, values, body = _split(row["data"], 5)
            body = _unpress(body, "u1").tobytes()
            at, index = 0, []
            columns = (_unpress(lengths, "i4"), _unpress(docs_of, "i8"), _unpress(values, "u8"))
            for length, doc, value in zip(*(c.tolist() for c in columns), strict=True):
                place = known.setdefault(body[at : at + length], len(known))
                if place == len(least):
                    least.append(doc)
                    value_of.append(value)
                elif doc < least[place]:
                    least[place] = doc
                index.append(place)
                at += length
            sent.append((row["block"], row["shard"], flags, np.array(index)))
        texts, docs_of, values_of = list(known), np.array(least, np.int64), np.array(value_of, np.uint64)
        # All copies of a window are in segments of one value. If that is one segment, which may
        # have many copies, there is nothing to search.
        _, same, number = np.unique(values_of, return_inverse=True, return_counts=True)
        found = [None] * len(texts)
        for i in np.flatnonzero(number[same] == 1).tolist():
            found[i] = np.full(len(texts[i]) - WINDOW + 1, docs_of[i])
        searched = np.flatnonzero(number[same] > 1)
        order = searched[np.lexsort((docs_of[searched], values_of[searched]))]
        sizes = np.cumsum([len(texts[i]) for i in order])
        portion = 0
        while portion < len(order):
            stop = int(np.searchsorted(sizes, (sizes[portion - 1] if portion else 0) + INDEX)) + 1
            while stop < len(order) and value_of[order[stop]] == value_of[order[stop - 1]]:
                stop += 1
            some = order[portion:stop]
            for i, firsts in zip(
                some, firsts_of([texts[i] for i in some], docs_of[some], values_of[some]), strict=True
            ):
                found[i] = firsts
            portion = stop
        out = []
        for block, shard, flags, index in sent:
            firsts = np.concatenate([found[i] for i in index])
            out.append({"shard": shard, "block": block, "data": _join(flags, _press(np.diff(firsts, prepend=0)))})
        return _dealt(out)

    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    result = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("spans", pa.list_(span)),
            ("kept", pa.binary()),
        ]
    )

    def mark(block: pa.Table, answers: pa.Table) -> pa.Table:
        replies = {row["shard"]: _split(row["data"], 2) for row in answers.to_pylist()}
        out = []
        for row in block.to_pylist():
            ids, sizes, data = _open(row)
            covered = np.zeros(len(data) + 1, np.int64)
            found = segments(data, sizes) if replies else None
            bits = {shard: flags for shard, (flags, _) in replies.items()}
            groups = _strings(data, found, *_chosen(found, ids, shards, bits)) if replies else ()
            for shard, texts, index, mine in groups:
                firsts = np.cumsum(_unpress(replies[shard][1], "i8"))
                numbers = np.array([len(t) - WINDOW + 1 for t in texts], np.int64)
                starts = np.cumsum(numbers) - numbers
                size = found.number[mine]
                step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                first = firsts[np.repeat(starts[index], size) + step]
                later = first < np.repeat(ids[found.owner[mine]], size)
                windows = (np.repeat(found.start[mine], size) + step)[later]
                np.add.at(covered, windows, 1)
                np.add.at(covered, windows + WINDOW, -1)
            gone = np.cumsum(covered[:-1]) > 0
            at = 0
            for own, size in zip(row["ids"], row["sizes"], strict=True):
                part = gone[at : at + size]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], part, [False])).astype(np.int8)))
                spans = [{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()]
                kept = data[at : at + size][~part].tobytes()
                out.append({"doc_id": own, "n_bytes": size, "spans": spans, "kept": kept})
                at += size
        return pa.Table.from_pylist(out, result)

    values = blocks.mapInArrow(deal, _DEALT_SQL)
    shared = values.groupBy("shard").applyInArrow(compare, _DEALT_SQL)
    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, _DEALT_SQL)
    replies = sent.groupBy("shard").applyInArrow(answer, _DEALT_SQL)
    kind = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(mark, kind)

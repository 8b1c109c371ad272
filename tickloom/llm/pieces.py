"""SentencePiece encoding by a streaming Viterbi search, and decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.columns import ragged

#: The sign that stands for a space inside pieces, and a stand-in (never in valid text) for that
#: sign where a text itself holds it: it is spelled in bytes, so that decoding gives it back.
MARK, LITERAL_MARK = "▁", "\ud800"

#: Costs are whole numbers, so that sums do not depend on where a search starts.
SCALE = 1 << 16

#: A character outside the vocabulary costs this much more (in log probability) than any piece.
UNKNOWN_PENALTY = 10.0

#: Bytes of the longest stretch that is searched beside others, and stretches searched together.
LANE, TOGETHER = 64, 1 << 14

#: Bytes of text that a task searches at a time; characters that a long stretch is fed by.
MOST_BYTES, PORTION = 4 << 20, 1 << 16

#: Ids whose bytes a task puts together at a time.
DECODED = 1 << 19

UNREACHED = 1 << 62


@dataclass
class Vocabulary:
    """``trie``: by character, [cost and ids of the piece that ends here or None, what follows].

    ``flat``: the same over bytes, a space for the mark: (state * 256 + byte of each step, its next
    state, and by state the cost and id of the piece that ends there, -1 for none).
    """

    trie: dict[str, list]
    byte_ids: list[int]
    outputs: list[bytes]
    longest: int
    unknown_cost: int
    prefix: bool
    marks_lead: bool
    flat: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

    def spelled(self, char: str) -> list[int]:
        plain = {LITERAL_MARK: MARK, MARK: " "}.get(char, char)
        return [self.byte_ids[b] for b in plain.encode("utf-8", errors="surrogateescape")]


def make_vocabulary(
    pieces: list[tuple[int, str, float]], byte_ids: list[int], size: int, prefix: bool, ranks: bool
) -> Vocabulary:
    """Of pieces (id, text, score). ``ranks``: scores only order the pieces, as merge numbers do;
    then a piece's probability is taken as inverse to its rank (Zipf)."""
    order = sorted(pieces, key=lambda p: (-p[2], p[0]))
    if ranks:
        total = math.log(sum(1 / r for r in range(1, len(order) + 1)))
        costs = {p[0]: math.log(r) + total for r, p in enumerate(order, 1)}
    else:
        costs = {p[0]: -p[2] for p in order}
    trie: dict[str, list] = {}
    steps: dict[int, int] = {}
    ends = {}
    outputs = [b""] * size
    for byte, at in enumerate(byte_ids):
        outputs[at] = bytes([byte])
    for at, text, _ in pieces:
        follow = trie
        for char in text[:-1]:
            follow = follow.setdefault(char, [None, {}])[1]
        cost = round(costs[at] * SCALE)
        follow.setdefault(text[-1], [None, {}])[0] = (cost, (at,))
        if " " not in text:  # texts hold marks for spaces, so such a piece never fits
            state = 0
            for byte in text.replace(MARK, " ").encode():
                state = steps.setdefault(state * 256 + byte, len(steps) + 1)
            ends[state] = (cost, at)
        outputs[at] = text.replace(MARK, " ").encode()
    worst = max(costs.values(), default=0.0) + UNKNOWN_PENALTY
    by_state = [ends.get(state, (0, -1)) for state in range(len(steps) + 1)]
    texts = [p[1] for p in pieces]
    return Vocabulary(
        trie,
        byte_ids,
        outputs,
        max(map(len, texts), default=1),
        round(worst * SCALE),
        prefix,
        not any(MARK in text.lstrip(MARK) for text in texts),
        (
            np.array(list(steps), np.int64),
            np.array(list(steps.values()), np.int32),
            np.array([cost for cost, _ in by_state], np.int64),
            np.array([at for _, at in by_state], np.int32),
        ),
    )


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a model file with byte fallback and without text normalisation.

    A merge-based (BPE) model has no probabilities, only merge numbers; see ``make_vocabulary``.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if any(not model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte fallback")
    plain = [
        i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    ]
    pieces = [(i, model.id_to_piece(i), model.get_score(i)) for i in plain]
    ranks = all(float(score).is_integer() for _, _, score in pieces)
    return make_vocabulary(pieces, byte_ids, size, model.encode("x", out_type=str)[0] != "x", ranks)


class Stream:
    """The search over a text that comes in portions: ``feed`` gives the ids that are certain.

    What is held: a cursor in the trie for each boundary that a piece may still start from, at most
    ``longest`` of them, and of the back pointers those that a path to such a boundary uses. After
    every character, ids up to the last boundary that all surviving paths share are given out
    and forgotten. Among equal costs the longer last piece wins.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.base = self.at = 0
        self.cursors = [(0, 0, vocabulary.trie)]  # (boundary, its cost, what may follow), by boundary
        # By boundary: where its best path comes from and by which ids; how many surviving
        # boundaries and cursors need it; the sum of these boundaries (if there is one: it).
        self.back: dict[int, tuple] = {0: (0, ())}
        self.needs, self.next = {0: 1}, {0: 0}

    @property
    def held(self) -> int:
        return len(self.back)

    def _release(self, boundary: int) -> None:
        """One need less; what nobody needs goes, and so on backwards."""
        back, needs = self.back, self.needs
        needs[boundary] -= 1
        while not needs[boundary]:
            before = back.pop(boundary)[0]
            del needs[boundary], self.next[boundary]
            needs[before] -= 1
            self.next[before] -= boundary
            boundary = before

    def feed(self, text: str) -> list[int]:
        back, needs, following = self.back, self.needs, self.next
        trie, unknown = self.vocabulary.trie, self.vocabulary.unknown_cost
        out: list[int] = []
        for char in text:
            best, parent, ids = UNREACHED, self.at, ()
            going, ended = [], []
            for start, cost, follow in self.cursors:
                hit = follow.get(char)
                if hit is None:
                    ended.append(start)
                    piece = None
                    continue
                piece, follow = hit
                if piece is not None and cost + piece[0] < best:
                    best, parent, ids = cost + piece[0], start, piece[1]
                if follow:
                    going.append((start, cost, follow))
                else:
                    ended.append(start)
            if piece is None and cost + unknown < best:  # of the last cursor: no such character
                best, parent, ids = cost + unknown, start, self.vocabulary.spelled(char)
            self.at = at = self.at + 1
            going.append((at, best, trie))
            self.cursors = going
            back[at], needs[at], following[at] = (parent, ids), 1, 0
            needs[parent] += 1
            following[parent] += at
            for start in ended:
                self._release(start)
            base, first = self.base, going[0][0]
            while base < first and needs[base] == 1:
                then = following.pop(base)
                del needs[base], back[base]
                out += back[then][1]
                self.base = base = then
        return out

    def close(self) -> list[int]:
        """The ids of what is still open, as the text is over."""
        steps, at = [], self.at
        while at > self.base:
            at, ids = self.back[at]
            steps.append(ids)
        return [i for ids in reversed(steps) for i in ids]


class Lanes:
    """The same search for many short stretches at once, over their UTF-8 bytes in numpy.

    At each step all stretches stand at the same byte. A piece starts and ends between characters,
    so boundaries inside one are never reached. Bytes of unknown characters are steps of their own.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        keys, self.then, self.cost, self.piece = vocabulary.flat
        self.unknown = vocabulary.unknown_cost
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)
        # Steps of the trie in an open hash table: state * 256 + byte -> next state.
        self.shift = np.uint64(64 - max(len(keys) * 4, 16).bit_length())
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        slot, rows = self._slot(keys), np.arange(len(keys))
        while len(rows):
            empty = self.keys[slot] < 0
            self.keys[slot[empty]] = keys[rows[empty]]  # of several the last one stays
            placed = self.keys[slot] == keys[rows]
            self.values[slot[placed]] = self.then[rows[placed]]
            rows, slot = rows[~placed], (slot[~placed] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def _step(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The states that follow, 0 for none (the root follows nothing)."""
        keys = states.astype(np.int64) * 256 + bytes_
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.values[slot], 0)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            there = self.keys[slot[open_]]
            same = there == keys[open_]
            found[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return found

    def ids(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of one stretch after the other, number of ids of each)."""
        order = np.argsort(sizes, kind="stable")
        counts = np.zeros(len(sizes), np.int64)
        parts = []
        for at in range(0, len(order), TOGETHER):
            rows = order[at : at + TOGETHER]
            ids, counts[rows] = self._chunk(data, starts[rows], sizes[rows])
            parts.append(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        begins = np.zeros(len(order), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ragged(begins, counts)], counts

    def _chunk(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` of stretches in order of their sizes."""
        n, longest = len(sizes), int(sizes.max(initial=0))
        places = np.minimum(starts + np.arange(longest)[:, None], len(data) - 1)
        chars = data[places]
        costs = np.full((longest + 1, n), UNREACHED, np.int64)
        costs[0] = 0
        before = np.zeros((longest + 1, n), np.int16)
        steps = np.zeros((longest + 1, n), np.int32)
        for at in range(longest):
            lanes = np.flatnonzero(costs[at] < UNREACHED)
            lanes = lanes[sizes[lanes] > at]
            here, first = costs[at, lanes], chars[at, lanes]
            width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            width = np.minimum(width, sizes[lanes] - at)
            single = np.zeros(len(lanes), bool)
            alive, states = np.arange(len(lanes)), np.zeros(len(lanes), np.int32)
            for end in range(at + 1, longest + 1):
                states = self._step(states, chars[end - 1, lanes[alive]])
                on = np.flatnonzero(states)
                alive, states = alive[on], states[on]
                if not len(alive):
                    break
                stops = np.flatnonzero(self.piece[states] >= 0)
                who, state = alive[stops], states[stops]
                single[who[width[who] == end - at]] = True
                lane, cost = lanes[who], here[who] + self.cost[state]
                better = np.flatnonzero(cost < costs[end, lane])
                lane = lane[better]
                costs[end, lane], before[end, lane] = cost[better], at
                steps[end, lane] = self.piece[state[better]]
                more = np.flatnonzero(sizes[lanes[alive]] > end)
                alive, states = alive[more], states[more]
            single |= here + self.unknown >= costs[at + width, lanes]
            lanes, here, width = lanes[~single], here[~single], width[~single]
            costs[at + width, lanes] = here + self.unknown
            for k in range(int(width.max(initial=0))):
                lane = lanes[width > k]
                before[at + k + 1, lane] = at + k
                steps[at + k + 1, lane] = self.byte_ids[chars[at + k, lane]]
        counts, lanes, place = np.zeros(n, np.int64), np.arange(n), sizes.astype(np.int64)
        columns = []
        while len(lanes):
            on = np.flatnonzero(place)
            lanes, place = lanes[on], place[on]
            columns.append((lanes, steps[place, lanes]))
            counts[lanes] += 1
            place = before[place, lanes].astype(np.int64)
        ids, last = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - 1
        for k, (lanes, found) in enumerate(columns):
            ids[last[lanes] - k] = found
        return ids, counts


class Encoder:
    """Encodes many texts at once.

    If no piece holds a mark after another sign, paths always meet before a run of marks, so the
    stretches between such boundaries are independent of each other, and equal ones are searched
    once in a portion: short ones in ``Lanes``, longer ones as a ``Stream``.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.lanes = Lanes(vocabulary)

    def _long(self, stretch: bytes) -> np.ndarray:
        text = stretch.decode("utf-8", errors="surrogateescape")
        text = text.replace(MARK, LITERAL_MARK).replace(" ", MARK)
        stream, parts = Stream(self.vocabulary), []
        for at in range(0, len(text), PORTION):
            parts.append(np.array(stream.feed(text[at : at + PORTION]), np.int32))
        return np.concatenate([*parts, np.array(stream.close(), np.int32)])

    def _stretches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(ids, counts) of stretches that follow each other."""
        low = int(starts[0])
        offsets = (np.append(starts, ends[-1]) - low).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[low : int(ends[-1])])]
        coded = pa.Array.from_buffers(pa.binary(), len(starts), buffers).dictionary_encode()
        codes, known = coded.indices.to_numpy(), coded.dictionary
        bounds = np.frombuffer(known.buffers()[1], np.int32, len(known) + 1).astype(np.int64)
        held = np.frombuffer(known.buffers()[2], np.uint8)
        begins, sizes = bounds[:-1], np.diff(bounds)
        short = np.flatnonzero(sizes <= LANE)
        ids, found = self.lanes.ids(held, begins[short], sizes[short])
        counts, parts = np.zeros(len(known), np.int64), [ids]
        at = np.zeros(len(known), np.int64)
        counts[short], at[short] = found, np.cumsum(found) - found
        total = len(ids)
        for k in np.flatnonzero(sizes > LANE).tolist():
            parts.append(self._long(known[k].as_py()))
            at[k], counts[k] = total, len(parts[-1])
            total += len(parts[-1])
        return np.concatenate(parts)[ragged(at[codes], counts[codes])], counts[codes]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): null gives none. Portions end between stretches, so what
        is held beside texts and ids depends on ``TOGETHER`` and the longest stretch only."""
        blank = b" " if self.vocabulary.prefix else b""
        raw = [t.as_buffer() if t.is_valid else b"" for t in texts.cast(pa.large_binary())]
        data = np.frombuffer(b"".join([part for t in raw if len(t) for part in (blank, t)]), np.uint8)
        sizes = np.array([len(t) + len(blank) if len(t) else 0 for t in raw], np.int64)
        text_ends = np.cumsum(sizes)
        opens = np.zeros(len(data) + 1, bool)
        if self.vocabulary.marks_lead and len(data):
            space = data == 32
            opens[1:-1] = space[1:] & ~space[:-1]
        opens[text_ends - sizes] = True
        starts = np.flatnonzero(opens[:-1])
        ends = np.append(starts[1:], len(data))
        parts, ids_before = [np.zeros(0, np.int32)], np.zeros(len(starts) + 1, np.int64)
        at = 0
        while at < len(starts):
            until = max(int(np.searchsorted(ends, starts[at] + MOST_BYTES, "right")), at + 1)
            ids, ids_before[at + 1 : until + 1] = self._stretches(data, starts[at:until], ends[at:until])
            parts.append(ids)
            at = until
        ids_before = np.cumsum(ids_before)
        upto = np.searchsorted(starts, text_ends)  # stretches before the end of each text
        return np.concatenate(parts), np.append(0, ids_before[upto])

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text]))[0].tolist()


class Decoder:
    """The texts of lists of ids; control pieces give nothing, bad byte runs a replacement sign."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.sizes = np.array([len(o) for o in vocabulary.outputs], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(vocabulary.outputs), np.uint8)
        self.prefix = vocabulary.prefix

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray, missing: pa.Array) -> pa.Array:
        """``offsets``: where the ids of each text begin, and the end."""
        parts, total = [np.zeros(0, np.uint8)], 0
        bounds = np.zeros(len(offsets), np.int64)
        for at in range(0, len(ids), DECODED):
            some = ids[at : at + DECODED]
            sizes = self.sizes[some]
            low, high = np.searchsorted(offsets, [at, at + len(some)])
            bounds[low:high] = total + np.append(0, np.cumsum(sizes))[offsets[low:high] - at]
            parts.append(self.bytes[ragged(self.begins[some], sizes)])
            total += len(parts[-1])
        bounds[np.searchsorted(offsets, len(ids)) :] = total
        data = np.concatenate(parts)
        if self.prefix and len(data):
            first = bounds[:-1][np.diff(bounds) > 0]
            first = first[data[first] == 32]
            data, bounds = np.delete(data, first), bounds - np.searchsorted(first, bounds)
        buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]
        texts = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, buffers)
        try:
            texts = texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([t.as_py().decode("utf-8", errors="replace") for t in texts], pa.large_string())
        return pc.if_else(missing, pa.scalar(None, pa.large_string()), texts)


def decode_ids(ids: Sequence[int], vocabulary: Vocabulary) -> str:
    """The text of one list of ids."""
    bounds = np.array([0, len(ids)], np.int64)
    return Decoder(vocabulary).decode_all(np.array(ids, np.int32), bounds, pa.array([False]))[0].as_py()


def portions(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` by the sizes given; a larger row is a slice of its own."""
    upto = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            yield batch.slice(low, high - low)


def add_ids(
    docs: DataFrame,
    vocabulary: Vocabulary,
    text_col: str = "text",
    name: str = "ids",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The input's rows with the columns ``keep`` (all, if not given) and the ids of each whole text.

    One map-side pass; nothing is shuffled, so copies and hot sources cost nothing beyond their
    rows. The vocabulary's size is that of its file. A null text gives null, an empty one an empty
    list. A column of the same name is refused.
    """
    if name in docs.columns:
        raise ValueError(f"the input has a column {name} already")
    at = docs.columns.index(text_col)
    kept = [docs.columns.index(c) for c in (docs.columns if keep is None else keep)]

    names = [*(docs.columns[k] for k in kept), name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in portions(batch, pc.binary_length(batch.column(at)), MOST_BYTES):
                ids, offsets = encoder.encode_all(part.column(at))
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(ids), mask=part.column(at).is_null()
                )
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), lists], names)

    fields = [docs.schema.fields[k] for k in kept]
    kind = T.StructType([*fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(run, kind)


def encode(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, ids) for each input row; only the two named columns are read. See ``add_ids``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return add_ids(rows, vocabulary, keep=["doc_id"])


def decode(
    rows: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """Rows (doc_id, ids, text): ``encode`` undone, null for null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary)
        for batch in batches:
            for part in portions(batch, pc.list_value_length(batch.column(1)), DECODED):
                lists = part.column(1)
                flat = lists.flatten().to_numpy()  # without what lies below nulls
                offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))
                texts = decoder.decode_all(flat, offsets, lists.is_null()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, texts], ["doc_id", "ids", "text"])

    given = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    kind = T.StructType([*given.schema.fields, T.StructField("text", T.StringType())])
    return given.mapInArrow(run, kind)

"""Documents ranked for query items by the terms they share, exactly, through blocked postings.

A term is a maximal run of characters other than ASCII control, space and punctuation, A-Z
lower-cased. A document's impact of a term grows with the term's count and falls with the
document's length; its score for an item is the sum of weight times impact over the item's terms.

The index holds, for chunks of documents, the postings of each term that may lift a document into
the best ten. A posting list is clustered: some of its documents are taken as centres, each other
one goes to the centre whose projected term vector is most like its own, and large clusters are
cut. Every block stores the largest impact that any of its documents has, for each term that
matters to a reader of the list. The weighted sum of these is never below a score inside the
block, so a block is passed over exactly when that sum is below the tenth best score known.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.columns import settle

#: Terms of the items that are searched together; more items are searched in several rounds.
ROUND = 1 << 17
#: Cells of the matrix (terms by documents) of one chunk, and the most documents in it.
CELLS, MOST_DOCS = 1 << 24, 4096
#: Documents of a block, as a rule; a cluster of more than twice as many is cut.
BLOCK = 32
#: Dimensions of the projection that tells how alike documents are.
DIMENSIONS = 16
#: One document in so many gives the first lower bound of each item's tenth best score. It only
#: decides how much can be passed over, never what is found.
PILOT = 32
#: Scale of impacts, and the share of length in them, in percent.
SCALE, LENGTH = 1_000_000_000, 75

_FOLD = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32
    for c in range(256)
)

FORWARD = "doc_id long, n long, terms array<int>, counts array<int>"
CHUNK = (
    "doc_ids array<long>, starts array<int>, terms array<int>, impacts array<int>, "
    "block_terms array<int>, block_ends array<int>, block_docs array<int>, peaks array<int>"
)
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of UTF-8 text. Every byte of a character beyond ASCII belongs to a term."""
    return text.translate(_FOLD).split() if text else []


@dataclass
class Plan:
    """What one round of items needs: for each item its terms (numbers) with count times weight,
    and the terms whose postings it reads."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    read: list[np.ndarray]
    least: np.ndarray
    documents: int
    total: int
    size: int

    def impacts(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Impacts of counts in documents with n terms, below 1,000,000."""
        spread = 100 - LENGTH + (LENGTH * n * self.documents) // max(self.total, 1)
        return ((SCALE * counts) // (1000 * counts + 8 * spread)).astype(np.int32)

    @cached_property
    def lists(self) -> dict[int, tuple[list[int], np.ndarray]]:
        """By term, the items that read its postings, and the terms for which blocks of these keep
        their largest impacts: all terms of such an item."""
        readers: dict[int, list[int]] = {}
        for item, terms in enumerate(self.read):
            for term in terms.tolist():
                readers.setdefault(term, []).append(item)
        return {
            term: (items, np.unique(np.concatenate([self.terms[i] for i in items])))
            for term, items in readers.items()
        }

    def chunk_docs(self) -> int:
        return min(MOST_DOCS, max(16, CELLS // max(self.size, 1)))


def forward(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """For each document the number of its terms, and the counts of those that are numbered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(text)
                own = Counter(map(numbers.get, words))
                own.pop(None, None)
                n.append(len(words))
                terms.append(list(own))
                counts.append(list(own.values()))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int32())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, FORWARD)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts = column.offsets.to_numpy()
    return starts - starts[0], column.flatten().to_numpy(zero_copy_only=False)


def _matrix(size: int, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Impacts as a matrix of terms by documents."""
    full = np.zeros((size, len(starts) - 1), np.int32)
    full[terms, np.repeat(np.arange(len(starts) - 1), np.diff(starts))] = impacts
    return full


def _projected(full: np.ndarray) -> np.ndarray:
    """Unit vectors, one for each document, whose products tell how alike their terms are."""
    signs = np.random.default_rng(3).integers(0, 2, (DIMENSIONS, len(full))).astype(np.float32) * 2 - 1
    rows = (signs @ full.astype(np.float32)).T
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _blocks(docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A posting list in the order of its clusters, and where each block begins."""
    count = -(-len(docs) // BLOCK)
    if count == 1:
        return docs, np.zeros(1, np.int64)
    centres = docs[np.linspace(0, len(docs) - 1, count).astype(np.int64)]
    nearest = (places[docs] @ places[centres].T).argmax(axis=1)
    order = np.argsort(nearest, kind="stable")
    edges = np.flatnonzero(np.diff(nearest[order], prepend=-1))
    starts = []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(docs)], strict=True):
        pieces = max(1, (b - a) // BLOCK) if b - a > 2 * BLOCK else 1
        starts += [a + (b - a) * k // pieces for k in range(pieces)]
    return docs[order], np.array(starts)


def index_chunk(
    plan: Plan, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray
) -> tuple[list, list, list, list]:
    """Blocks of the postings that items read: term, end and documents of each block, and the
    largest impacts, in the order of the terms in ``Plan.lists``."""
    full = _matrix(plan.size, starts, terms, impacts)
    places = _projected(full)
    block_terms, block_ends, block_docs, peaks, at = [], [], [], [], 0
    for term in np.unique(terms).tolist():
        if term not in plan.lists:
            continue
        docs, begins = _blocks(np.flatnonzero(full[term]), places)
        wanted = plan.lists[term][1]
        largest = np.maximum.reduceat(full[np.ix_(wanted, docs)], begins, axis=1)
        block_terms += [term] * len(begins)
        block_ends += (at + np.append(begins[1:], len(docs))).tolist()
        block_docs.append(docs)
        peaks.append(largest.T.ravel())
        at += len(docs)
    return block_terms, block_ends, block_docs, peaks


def build(rows: DataFrame, plan: Plan) -> DataFrame:
    """The index over a forward table: one row for each chunk of documents."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = plan.chunk_docs()
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                starts, terms = _flat(part.column(2))
                _, counts = _flat(part.column(3))
                n = np.repeat(part.column(1).to_numpy(), np.diff(starts))
                impacts = plan.impacts(counts.astype(np.int64), n)
                own, ends, docs, peaks = index_chunk(plan, starts, terms, impacts)
                one = [
                    part.column(0).to_pylist(), starts, terms, impacts,
                    own, ends, np.concatenate(docs) if docs else [], np.concatenate(peaks) if peaks else [],
                ]
                kinds = [pa.int64()] + [pa.int32()] * 7
                names = [f.split(" ")[0] for f in CHUNK.split(", ")]
                values = [pa.array([x], pa.list_(kind)) for x, kind in zip(one, kinds, strict=True)]
                yield pa.record_batch(values, names)

    return rows.where(F.size("terms") > 0).mapInArrow(chunks, CHUNK)


def best(doc_ids: list, docs: np.ndarray, scores: np.ndarray, top: int) -> list[tuple[int, int]]:
    """The highest (score, document), equal scores by ascending id, null ids last."""
    if len(docs) > top:
        floor = np.partition(scores, len(scores) - top)[len(scores) - top]
        docs, scores = docs[scores >= floor], scores[scores >= floor]
    found = zip(scores.tolist(), docs.tolist(), strict=True)
    key = lambda x: (-x[0], doc_ids[x[1]] is None, doc_ids[x[1]] or 0)
    return sorted(found, key=key)[:top]


def search_chunk(plan: Plan, chunk: dict, top: int) -> tuple[list[tuple[int, int, int]], int, int]:
    """(item, document, score) of a chunk's best, and how many of its blocks items read and passed over."""
    starts, terms = chunk["starts"], chunk["terms"]
    full = _matrix(plan.size, starts, terms, chunk["impacts"])
    marked = np.zeros((len(plan.terms), full.shape[1]), bool)
    own, ends = chunk["block_terms"], chunk["block_ends"]
    begins = np.concatenate(([0], ends[:-1]))
    lists = np.flatnonzero(np.diff(own, prepend=-1))
    at = seen = passed = 0
    for a, b in zip(lists.tolist(), [*lists[1:].tolist(), len(own)], strict=True):
        items, wanted = plan.lists[int(own[a])]
        peaks = chunk["peaks"][at : at + (b - a) * len(wanted)].reshape(b - a, -1).astype(np.int64)
        at += peaks.size
        docs, sizes = chunk["block_docs"][begins[a] : ends[b - 1]], ends[a:b] - begins[a:b]
        for item in items:
            bound = peaks[:, np.searchsorted(wanted, plan.terms[item])] @ plan.weights[item]
            reach = bound >= plan.least[item]
            marked[item, docs[np.repeat(reach, sizes)]] = True
            seen += int(reach.sum())
            passed += int((~reach).sum())
    found = []
    for item, of in enumerate(marked):
        docs = np.flatnonzero(of)
        if len(docs):
            scores = plan.weights[item] @ full[np.ix_(plan.terms[item], docs)].astype(np.int64)
            enough = scores >= plan.least[item]
            taken = best(chunk["doc_ids"], docs[enough], scores[enough], top)
            found += [(item, chunk["doc_ids"][doc], score) for score, doc in taken]
    return found, seen, passed


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = [pa.int32(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "doc_id", "score"])


def search(index: DataFrame, plan: Plan, top: int) -> DataFrame:
    """Rows (item, doc_id, score): the best of each chunk, of which the best of all are a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {n: batch.column(i)[k].values.to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if i}
                one["doc_ids"] = batch.column(0)[k].as_py()
                yield _found(search_chunk(plan, one, top)[0])

    return index.mapInArrow(run, FOUND)


def _pilot(rows: DataFrame, plan: Plan, top: int) -> DataFrame:
    """The best scores among one document in ``PILOT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = plan.chunk_docs()
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                starts, terms = _flat(part.column(2))
                counts = _flat(part.column(3))[1].astype(np.int64)
                n = np.repeat(part.column(1).to_numpy(), np.diff(starts))
                full = _matrix(plan.size, starts, terms, plan.impacts(counts, n))
                found = []
                for item, (own, weights) in enumerate(zip(plan.terms, plan.weights, strict=True)):
                    scores = np.sort(weights @ full[own].astype(np.int64))[::-1][:top]
                    found += [(item, None, s) for s in scores.tolist() if s > 0]
                yield _found(found)

    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(PILOT)) == 0)
    return chosen.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def make_plan(rows: DataFrame, items: list[Counter], numbers: dict[bytes, int], top: int) -> Plan:
    """Weights, lower bounds and lists to read, from a written forward table.

    Only numbers of one round go through the driver: a count, a weight and a largest impact for
    each term, and one score for each item.
    """
    whole = rows.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    plan = Plan([], [], [], np.ones(len(items), np.int64), whole.N, whole.L, len(numbers))
    each = rows.select("n", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    spread = f"{100 - LENGTH} + ({LENGTH} * n * {whole.N}L) div {max(whole.L, 1)}L"
    impact = F.expr(f"({SCALE}L * x.counts) div (1000L * x.counts + 8 * ({spread}))")
    held = each.groupBy(F.col("x.terms").alias("term")).agg(F.count("*").alias("df"), F.max(impact).alias("peak"))
    weight, peak = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
    for r in held.collect():
        weight[r.term] = math.floor(1000 * math.log((2 * whole.N + 2) / (2 * r.df + 1)))
        peak[r.term] = r.peak
    for own in items:
        terms = np.array(sorted(numbers[t] for t in own), np.int64)
        by = {numbers[t]: c for t, c in own.items()}
        plan.terms.append(terms)
        plan.weights.append(np.array([by[t] for t in terms.tolist()], np.int64) * weight[terms])
    known = _ranked(_pilot(rows, plan, top), top).where(F.col("rank") == top).select("item", "score")
    for r in known.collect():
        plan.least[r.item] = max(1, r.score)
    for terms, weights, least in zip(plan.terms, plan.weights, plan.least.tolist(), strict=True):
        # Lists that even together cannot lift a document to the least score are not read.
        most = weights * peak[terms]
        order = np.argsort(most, kind="stable")
        plan.read.append(terms[order[np.cumsum(most[order]) >= least]])
    return plan


def _rounds(items: DataFrame) -> list[DataFrame]:
    """The items in parts of about ``ROUND`` terms."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // (ROUND * 4)))
    part = F.pmod(F.xxhash64("item_id"), F.lit(count))
    return [items.where(part == k) for k in range(count)]


def rank(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    ``docs`` has (doc_id, text), ``items`` (item_id, text), ids being longs; other columns are not
    read. Null and empty texts have no terms: such a document is never listed, such an item lists
    none, an empty table of either gives no rows. Texts count whole. Equal scores go by ascending
    doc_id, a null id last. Rows that repeat a doc_id are documents of their own; equal item rows
    count once, and different texts of one item_id (null is an id) are one item with the terms of
    all. The forward table and the index are written to the shared folder.
    """
    spark, found = docs.sparkSession, []
    for part in _rounds(items.select(F.col("item_id").cast("long"), "text").distinct()):
        own: dict[int | None, Counter] = {}
        for r in part.collect():
            own.setdefault(r.item_id, Counter()).update(terms_of((r.text or "").encode()))
        numbers = {t: k for k, t in enumerate(sorted(set().union(*own.values())))}
        if not numbers:
            continue
        rows = settle(forward(docs, numbers), "forward")
        plan = make_plan(rows, list(own.values()), numbers, top)
        index = settle(build(rows, plan), "postings")
        ids = spark.createDataFrame(list(enumerate(own)), "item int, item_id long")
        ranked = _ranked(search(index, plan, top), top).join(F.broadcast(ids), "item")
        found.append(ranked.select("item_id", "rank", "doc_id", "score"))
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else none

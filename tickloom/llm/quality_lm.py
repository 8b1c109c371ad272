"""Quality classifier: perplexity under a character n-gram model with modified Kneser-Ney
smoothing, trained on trusted text, with thresholds by language.

Characters are UTF-16 code units, and an n-gram of four fits a long: the earliest character in the
highest bits. Each document is preceded by three line feeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.columns import settle

ORDER = 4
PAD = "\n" * (ORDER - 1)

#: UTF-8 bytes of text that are counted, packed and scored together.
CHUNK = 8 << 20

#: Trusted ids up to this number are broadcast (64 MB); more are joined by a shuffle.
MOST_BROADCAST = 4_000_000

#: A tenth of the trusted documents is not counted but sets the thresholds.
FOLDS = 10


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, each behind its line feeds, and the texts' lengths."""
    parts = [(PAD + t).encode("utf-16-le", "surrogatepass") for t in texts]
    sizes = np.array([len(p) // 2 - len(PAD) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint16), sizes


def _grams(units: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The n-grams that end at each character of the texts."""
    if len(units) < ORDER:
        return np.zeros(0, np.int64)
    codes = np.zeros(len(units) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        part = units[k : len(units) - ORDER + 1 + k].astype(np.uint64)
        codes |= part << np.uint64(16 * (ORDER - 1 - k))
    starts = np.cumsum(sizes + len(PAD)) - sizes - len(PAD)
    edges = np.zeros(len(units) + 1, np.int8)  # sums of these are 0 or 1
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + sizes, -1)
    return codes[np.cumsum(edges, dtype=np.int8)[: len(codes)] > 0].view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[list[list]]:
    """Rows of the batches, column by column, in chunks of about ``CHUNK`` bytes of text."""
    held, size = None, 0
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        for row in zip(*columns, strict=True):
            held = held or [[] for _ in row]
            for column, value in zip(held, row, strict=True):
                column.append(value)
            size += len(row[text_at] or "")
            if size >= CHUNK:
                yield held
                held, size = None, 0
    if held:
        yield held


def marked(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows (doc_id, lang, text, role): role 1 is counted, 2 sets thresholds, null neither.

    ``trusted`` has a column doc_id. Its size is counted first: up to ``MOST_BROADCAST`` ids are
    sent to the texts, more meet them in a shuffle join.
    """
    role = F.when(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, 2).otherwise(1)
    ids = trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    ids = settle(ids.select("doc_id", role.alias("role")), "trusted")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(lang_col).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ids = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    return rows.join(ids, "doc_id", "left")


def gram_counts(rows: DataFrame) -> DataFrame:
    """Rows (gram, c): all n-grams of all texts, and how often the texts of role 1 have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, roles in _chunks(batches, 0):
            units, sizes = _units(texts)
            codes = _grams(units, sizes)
            trusted = codes[np.repeat(np.array([role == 1 for role in roles]), sizes)]
            grams = np.unique(codes)
            counts = np.zeros(len(grams), np.int64)
            found, times = np.unique(trusted, return_counts=True)
            counts[np.searchsorted(grams, found)] = times
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], ["gram", "c"])

    found = rows.select("text", "role").mapInArrow(run, "gram long, c long")
    return found.groupBy("gram").agg(F.sum("c").alias("c"))


def _low(gram: Column, units: int) -> Column:
    """The last ``units`` characters."""
    return gram.bitwiseAND(F.lit((1 << (16 * units)) - 1))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of modified Kneser-Ney, from how many types occur once to four times."""
    n = counts.agg(*[F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4)]).first()
    if not all(n):
        return [0.5, 0.75, 0.9]  # too few types to estimate them
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) for k in (0, 1, 2)]


def log_probabilities(counts: DataFrame) -> DataFrame:
    """Rows (gram, logp) for every n-gram of ``counts``, seen in training or not.

    Interpolated modified Kneser-Ney: each order below the highest counts the different characters
    that precede an n-gram. The tables of counts, contexts and lower orders meet by n-gram in
    shuffle joins, whose shards are as even as the n-grams are distinct; nothing is broadcast but
    three discounts for each order.
    """
    seen = {ORDER: counts.where("c > 0")}
    asked = {ORDER: counts.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        types = seen[k + 1].select(_low(F.col("gram"), k).alias("gram"))
        seen[k] = settle(types.groupBy("gram").agg(F.count("*").alias("c")), f"continued-{k}")
        asked[k] = settle(asked[k + 1].select(_low(F.col("gram"), k).alias("gram")).distinct(), f"asked-{k}")
    known = None
    for k in range(1, ORDER + 1):
        d = _discounts(seen[k])
        c = F.col("c")
        cut = F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
        types = seen[k].select("gram", "c", cut.alias("cut"), F.shiftrightunsigned("gram", 16).alias("context"))
        contexts = types.groupBy("context").agg(F.sum("c").alias("total"), F.sum("cut").alias("mass"))
        rows = (
            asked[k]
            .withColumn("context", F.shiftrightunsigned("gram", 16))
            .join(types.drop("context"), "gram", "left")
            .join(contexts, "context", "left")
        )
        own = F.coalesce(F.greatest(F.col("c") - F.col("cut"), F.lit(0.0)) / F.col("total"), F.lit(0.0))
        weight = F.coalesce(F.col("mass") / F.col("total"), F.lit(1.0))
        if known is None:
            symbols = seen[1].count() + 1  # and one for all that training never saw
            lower = F.lit(1.0 / symbols)
        else:
            rows = rows.withColumn("suffix", _low(F.col("gram"), k - 1)).join(
                known.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix", "left"
            )
            lower = F.col("lower")
        known = settle(rows.select("gram", (own + weight * lower).alias("p")), f"order-{k}")
    return known.select("gram", F.log("p").alias("logp"))


def _packed(rows: DataFrame) -> DataFrame:
    """One row for each chunk of documents: their columns as lists, the texts compressed, and the
    chunk's distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (part, ids, langs, texts, roles) in enumerate(_chunks(batches, 3)):
            units, sizes = _units(texts)
            grams = np.unique(_grams(units, sizes))
            press = zstandard.ZstdCompressor(level=3).compress
            row = {
                "block": f"{part[0]}-{number}",
                "ids": ids,
                "langs": langs,
                "roles": roles,
                "sizes": sizes.tolist(),
                "units": press(units.tobytes()),
                "grams": press(np.diff(grams, prepend=0).tobytes()),
            }
            yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema(
        [
            ("block", pa.string()),
            ("ids", pa.list_(pa.int64())),
            ("langs", pa.list_(pa.string())),
            ("roles", pa.list_(pa.int32())),
            ("sizes", pa.list_(pa.int64())),
            ("units", pa.binary()),
            ("grams", pa.binary()),
        ]
    )
    kind = (
        "block string, ids array<long>, langs array<string>, roles array<int>, sizes array<long>, "
        "units binary, grams binary"
    )
    part = F.spark_partition_id().alias("part")
    return rows.select(part, F.col("doc_id").cast("long"), "lang", "text", "role").mapInArrow(run, kind)


def _unpress(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def scores(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, role, n_chars, cost) with the negative log probability of each text.

    The documents are packed into blocks of about ``CHUNK`` bytes and moved once, compressed. Each
    block asks for the probabilities of its distinct n-grams; these rows (block, gram) meet the
    table in a shuffle join by n-gram, where a common n-gram has one row for each block only, and
    the answers meet their block. Both readers take the same shuffled blocks.
    """
    blocks = _packed(rows).repartition("block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["block", "grams"]).to_pylist():
                grams = pa.array(np.cumsum(_unpress(row["grams"], np.int64)))
                name = pa.array([row["block"]] * len(grams))
                yield pa.RecordBatch.from_arrays([name, grams], ["block", "gram"])

    answers = blocks.mapInArrow(ask, "block string, gram long").join(logs, "gram")

    def add_up(block: pa.Table, answer: pa.Table) -> pa.Table:
        grams, logp = answer.column("gram").to_numpy(), answer.column("logp").to_numpy()
        order = np.argsort(grams)
        grams, logp = grams[order], logp[order]
        out = []
        for row in block.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            codes = _grams(_unpress(row["units"], np.uint16), sizes)
            places = np.searchsorted(grams, codes)
            if len(codes) and not np.array_equal(grams[np.minimum(places, len(grams) - 1)], codes):
                raise RuntimeError("an n-gram of the texts has no probability")
            cost, filled = np.zeros(len(sizes)), sizes > 0
            if filled.any():
                starts = (np.cumsum(sizes) - sizes)[filled]
                cost[filled] = -np.add.reduceat(logp[places], starts)
            out.append(
                pa.table([row["ids"], row["langs"], row["roles"], sizes, cost], schema=result)
            )
        return pa.concat_tables(out) if out else result.empty_table()

    result = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("lang", pa.string()),
            ("role", pa.int32()),
            ("n_chars", pa.int64()),
            ("cost", pa.float64()),
        ]
    )
    kind = "doc_id long, lang string, role int, n_chars long, cost double"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, kind)


def thresholds(scored: DataFrame, quantile: float = 0.99, least: int = 20) -> DataFrame:
    """Rows (lang, threshold): the quantile of the perplexity of the trusted documents that were
    not counted. Languages with fewer than ``least`` of them (and null) take the quantile over all
    languages.

    With fewer than 1 / (1 - quantile) documents the quantile is no more than their largest value,
    which lies below it. It is then carried on from the median and that value as if the
    logarithm of the share above grew evenly.
    """
    perplexity = F.exp(F.col("cost") / F.col("n_chars"))
    kept_out = scored.where("role = 2 AND n_chars > 0").withColumn("perplexity", perplexity)
    high = F.percentile_approx("perplexity", quantile, 10_000)
    middle = F.percentile_approx("perplexity", 0.5, 10_000)
    enough, n = 1 / (1 - quantile), F.greatest(F.count("*"), F.lit(3))
    further = (high - middle) * F.greatest(F.log(enough / n), F.lit(0.0)) / F.log(n / 2)
    at = (high + further).alias("at")
    overall = kept_out.agg(at).first()[0]
    own = kept_out.groupBy("lang").agg(at, F.count("*").alias("n"))
    langs = scored.groupBy("lang").agg(F.count("*").alias("docs"))
    found = langs.alias("l").join(own.alias("o"), F.expr("l.lang <=> o.lang"), "left")
    value = F.when((F.col("n") >= least) & F.col("l.lang").isNotNull(), F.col("at")).otherwise(F.lit(overall))
    return found.select("l.lang", value.alias("threshold"))


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per input row: doc_id (a long), lang, n_chars, perplexity, threshold, kept.

    1. The n-grams of the trusted documents (column doc_id; a tenth is left out) are counted over
       their whole texts, inside tasks first.
    2. Every n-gram of the corpus gets its probability; what is gathered grows with the corpus.
    3. Each document gets its perplexity, and is kept up to its language's threshold.

    Null and empty texts have no perplexity and are not kept. Without trusted documents nothing
    has a threshold, and every text with a character is kept. Rows that repeat an id are scored
    one by one. Only the three named columns are read.
    """
    rows = marked(docs, trusted, id_col, text_col, lang_col)
    counts = settle(gram_counts(rows), "grams")
    scored = settle(scores(rows, log_probabilities(counts)), "scores")
    perplexity = F.when(F.col("n_chars") > 0, F.exp(F.col("cost") / F.col("n_chars")))
    limits = settle(thresholds(scored), "thresholds")
    judged = scored.alias("s").join(limits.alias("t"), F.expr("s.lang <=> t.lang"))
    return judged.select("doc_id", "s.lang", "n_chars", perplexity.alias("perplexity"), "threshold").withColumn(
        "kept", F.coalesce(F.col("perplexity") <= F.coalesce("threshold", F.lit(float("inf"))), F.lit(False))
    )

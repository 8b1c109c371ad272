"""Toxicity: a subword-bag embedding model in numpy, applied to whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.columns import ragged, settle

BUCKETS = 1 << 17
SIZES = (3, 4, 5, 6)

#: Words that are averaged together: every run of so many counts. Window and step size were chosen
#: on the rows to learn from, one half of them against the other.
WINDOW = 4

#: Words whose score a task remembers; the memory is emptied when full.
MOST_REMEMBERED = 400_000

# A-Z to lower case; ASCII punctuation parts words, as white space does.
_CLEAN = bytes(
    ord(chr(b).lower()) if chr(b).isupper() and b < 128 else b if b >= 128 or chr(b).isalnum() else 32
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """The distinct words in order of their first place: saying a word often adds nothing."""
    return list(dict.fromkeys((text or b"").translate(_CLEAN).split()))


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of ``<word>``, and the index of the word of each."""
    joined = np.frombuffer(b"<" + b"><".join(words) + b">" + b"\0" * max(SIZES), dtype=np.uint8)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    total = int(lengths.sum())
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.cumsum(lengths)[owner] - np.arange(total)  # bytes to the end of the own word
    code = np.zeros(total, dtype=np.uint64)
    buckets, owners = [], []
    for n in range(1, max(SIZES) + 1):
        code |= joined[n - 1 : n - 1 + total].astype(np.uint64) << np.uint64(8 * (n - 1))
        if n in SIZES:
            mixed = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            inside = left >= n
            buckets.append((mixed >> np.uint64(64 - 17)).astype(np.int32)[inside])
            owners.append(owner[inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """``pull[b]``: what subword b adds to the log odds of label 1. Averages are linear, so the
    product of the embeddings and the softmax's weights can be formed once."""

    pull: np.ndarray
    bias: float

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        buckets, owners = subwords(words)
        sums = np.bincount(owners, weights=self.pull[buckets], minlength=len(words))
        return sums / np.maximum(np.bincount(owners, minlength=len(words)), 1)

    def log_odds(self, scores: np.ndarray) -> float:
        """Of a text, from the scores of its words in order: those of its most toxic window."""
        if not len(scores):
            return self.bias
        sums, size = np.append(0.0, np.cumsum(scores)), min(WINDOW, len(scores))
        return self.bias + (sums[size:] - sums[:-size]).max() / WINDOW


def _choose(scores: np.ndarray, first: np.ndarray, counts: np.ndarray, y: np.ndarray, rng) -> np.ndarray:
    """Windows to learn from: each text's highest one; of texts of label 0 a random one, too."""
    highest = np.repeat(np.maximum.reduceat(scores, first), counts)
    at = np.flatnonzero(scores == highest)
    _, one_each = np.unique(np.repeat(np.arange(len(y)), counts)[at], return_index=True)
    clean = np.flatnonzero(y == 0)
    other = first[clean] + (rng.random(len(clean)) * counts[clean]).astype(np.int64)
    return rng.permutation(np.concatenate([at[one_each], other]))


def train(
    texts: list[bytes],
    labels: list[int],
    dim: int = 8,
    epochs: int | None = None,
    rate: float = 5.0,
    batch: int = 64,
    seed: int = 1,
) -> Model:
    """Fit embeddings and softmax together on the cross entropy, by plain gradient steps for the
    embeddings (so rare n-grams stay weak) and Adagrad for the softmax.

    Each run of ``WINDOW`` words is a window, so its place in the text does not matter. A window's
    vector is the average over its words of the average over a word's n-grams; words that a shorter
    text lacks count as zero. A text is as toxic as its most toxic window, so each epoch learns from the windows that are highest
    under the model so far (in the first, from random ones), or one abusive word would vanish
    among thousands. Few texts are gone through more often. Without labels of both kinds the model
    answers with their share.
    """
    split = [words_of(text) for text in texts]
    filled = [i for i, words in enumerate(split) if words]
    y = np.array([labels[i] for i in filled])
    share = (sum(labels) + 1) / (len(labels) + 2)
    if not filled or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    epochs = epochs or min(max(20, 100_000 // len(filled)), 60)
    rng = np.random.default_rng(seed)
    known: dict[bytes, int] = {}
    tokens = [np.array([known.setdefault(w, len(known)) for w in split[i]]) for i in filled]
    ids, owners = subwords(list(known))
    order = np.argsort(owners, kind="stable")
    ids, sizes = ids[order], np.bincount(owners, minlength=len(known))
    starts = np.cumsum(sizes) - sizes
    flat, n_words = np.concatenate(tokens), np.array([len(t) for t in tokens])
    counts = np.maximum(n_words - WINDOW + 1, 1)  # windows of each text
    first = np.cumsum(counts) - counts
    begins = ragged(np.cumsum(n_words) - n_words, counts)
    docs = np.repeat(np.arange(len(filled)), counts)
    lengths = np.minimum(WINDOW, n_words)[docs]
    embed = rng.normal(0, 0.1, (BUCKETS, dim))
    soft = rng.normal(0, 0.1, (dim, 2))
    bias = np.log([1 - share, share])
    seen_soft, seen_bias = np.full((dim, 2), 1e-6), np.full(2, 1e-6)
    kept = [np.zeros(BUCKETS), 0.0]  # sums over the second half of the epochs
    for epoch in range(epochs):
        pull = embed @ (soft[:, 1] - soft[:, 0])
        by_word = np.add.reduceat(pull[ids], starts) / sizes
        upto = np.append(0.0, np.cumsum(by_word[flat]))
        by_window = upto[begins + lengths] - upto[begins]
        chosen = _choose(by_window if epoch else rng.random(len(docs)), first, counts, y, rng)
        for at in range(0, len(chosen), batch):
            rows = chosen[at : at + batch]
            words = flat[ragged(begins[rows], lengths[rows])]
            row_of_word = np.repeat(np.arange(len(rows)), lengths[rows])
            row = np.repeat(row_of_word, sizes[words])
            weight = np.repeat(1 / sizes[words] / WINDOW, sizes[words])
            part, place = np.unique(ids[ragged(starts[words], sizes[words])], return_inverse=True)
            mix = np.bincount(row * len(part) + place, weights=weight, minlength=len(rows) * len(part))
            mix = mix.reshape(len(rows), len(part))
            vectors = mix @ embed[part]
            logits = vectors @ soft + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[docs[rows]]] -= 1
            grad, grad_soft, grad_bias = mix.T @ (p @ soft.T), vectors.T @ p, p.sum(axis=0)
            seen_soft += grad_soft**2
            seen_bias += grad_bias**2
            embed[part] -= rate * grad
            soft -= 0.1 * grad_soft / np.sqrt(seen_soft)
            bias = bias - 0.1 * grad_bias / np.sqrt(seen_bias)
        if epoch >= epochs // 2:
            kept[0] += embed @ (soft[:, 1] - soft[:, 0])
            kept[1] += bias[1] - bias[0]
    half = epochs - epochs // 2
    return Model((kept[0] / half).astype(np.float32), float(kept[1] / half))


def held_out(id_col: str) -> F.Column:
    """Of the third of ids that nothing is learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    most: int = 6000,
    most_bytes: int = 64 << 20,
) -> DataFrame:
    """Rows (doc_id, text, label): at most ``most`` labelled documents outside the held-out third,
    of ``most_bytes`` together.

    A third of them at most are of label 1; which ones is decided by a hash of the id. An id counts
    once: its labels must agree, or it is left out, and of several texts the greatest is taken.
    Null ids, null labels and ids without a document are left out; a null text is an empty one.
    Labels are thinned out by the hash where they are, so that only about as many as are wanted
    come together; what is broadcast to find the texts is bounded by ``most``.
    """
    known = (
        labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.col(label_col).cast("int")).alias("label"), F.max(F.col(label_col).cast("int")).alias("other"))
        .where("label = other")
        .select("doc_id", "label", F.xxhash64("doc_id").alias("hash"))
    )
    found = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}

    def pick(label: int, number: int) -> DataFrame:
        rows = known.where(F.col("label") == label)
        share = (number + 6 * number**0.5 + 10) / max(found.get(label, 0), 1)
        if share < 1:
            rows = rows.where(F.col("hash") < int(-(1 << 63) + share * (1 << 64)))
        return rows.orderBy("hash", "doc_id").limit(number)

    chosen = pick(1, most // 3).unionByName(pick(0, most - most // 3))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found_texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "hash")
    rows = settle(found_texts.agg(F.max("text").alias("text")), "toxicity-sample")
    before = Window.orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.select("doc_id", "hash", F.octet_length("text").alias("size"))  # at most ``most`` rows
    fit_in = sizes.withColumn("upto", F.sum("size").over(before)).where(F.col("upto") <= most_bytes)
    return rows.join(F.broadcast(fit_in.select("doc_id")), "doc_id").select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = 6000) -> Model:
    """The model of a bounded sample of labelled documents (see ``sample``)."""
    rows = sorted(sample(docs, labels, label_col, most).toArrow().to_pylist(), key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score): the probability of label 1 of each whole text.

    One map-side pass. A task remembers the scores of words, up to a bound, and computes those of
    new words together. Null, empty and wordless texts get the score of the bias alone. Rows are
    scored one by one, so copies and repeated ids all get theirs.
    """
    pull, bias = model.pull, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, known = Model(pull, bias), {}
        for batch in batches:
            odds = np.full(batch.num_rows, bias)
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_buffer().to_pybytes() if text.is_valid else None)
                if not words:
                    continue
                new = list(set(words).difference(known))
                if new:
                    if len(known) + len(new) > MOST_REMEMBERED:
                        known, new = {}, list(set(words))
                    known.update(zip(new, inner.word_scores(new).tolist(), strict=True))
                scores = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                odds[i] = inner.log_odds(scores)
            probability = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, kind)

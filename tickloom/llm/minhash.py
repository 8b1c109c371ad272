"""Near-duplicates: MinHash keys by tensored banding, links verified on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.columns import settle, tasks
from tickloom.llm.components import components
from tickloom.llm.skew import lookup, with_group
from tickloom.llm.words import mix, shingle_set, word_hashes

#: Groups in each of the two collections, and minhashes in each group. A table key joins one
#: group of either, so 2 * 7 * 2 = 28 minhashes make 49 tables of four minhashes each. At a
#: similarity of 0.85 a pair shares a group of one collection with 1 - (1 - 0.85^2)^7, and a table
#: with the square of that: 0.99975. At 0.80 that is 0.9984, at 0.50 it is 0.75.
GROUPS, WIDTH = 7, 2

#: Times at most that new leaders are drawn before what is left is joined, as long as links are found.
#: It decides how many pairs the join forms, not what is found.
TURNS = 6

#: Sets of a rare shingle up to which no leader is drawn.
FEW = 4


def _signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One key for each group: the minima of its hash functions, mixed."""
    least = np.empty(len(seeds), np.uint64)
    for at in range(0, len(shingles), 1 << 15):
        part = mix(shingles[at : at + (1 << 15), None] ^ seeds[None, :]).min(axis=0)
        least = part if at == 0 else np.minimum(least, part)
    keys = np.zeros(2 * GROUPS, np.uint64)
    for k in range(WIDTH):
        keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + least[k::WIDTH])
    return keys


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n_shingles, digest, keys). Texts of equal shingle sets have equal digests;
    without shingles, digest and keys are null."""
    seeds = np.random.default_rng(8).integers(1, 1 << 63, 2 * GROUPS * WIDTH, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, digests, keys = [], [], []
            for text in batch.column(1):
                words = word_hashes(text.as_buffer().to_pybytes()) if text.is_valid else np.zeros(0, np.uint64)
                own = shingle_set(words, size)
                numbers.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                keys.append(_signature(own, seeds).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(numbers, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "keys"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n_shingles", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("keys", T.ArrayType(T.LongType())),
        ]
    )
    return rows.mapInArrow(run, kind)


def shingle_sets(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, shingles) of the documents whose ids are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [
                shingle_set(word_hashes(t.as_buffer().to_pybytes()), size).view(np.int64) if t.is_valid else []
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = rows.join(ids, "id", "left_semi")
    kind = T.StructType([rows.schema["id"], T.StructField("shingles", T.ArrayType(T.LongType()))])
    return found.mapInArrow(run, kind).dropDuplicates(["id"])


def table_keys(sketch: DataFrame) -> DataFrame:
    """Rows (id, key), one for each pair of a group of the first and one of the second collection."""
    first = F.slice("keys", 1, GROUPS)
    second = F.slice("keys", GROUPS + 1, GROUPS)
    pairs = F.flatten(
        F.transform(
            first,
            lambda a, i: F.transform(second, lambda b, j: F.xxhash64(i * GROUPS + j, a, b)),
        )
    )
    return sketch.select(F.col("doc_id").alias("id"), F.explode(pairs).alias("key"))


def _rarest(sets: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """Rows (shingle, id, size, root, place) of the rarest shingles of the pool's sets.

    Two sets that reach the similarity share a shingle among the first size - percent % of size
    (rounded up) + 1 of either, in any common order; rare ones first makes such meetings few. ``place``
    counts from 0. Shingles that no other set of the pool has can meet nothing and are left out.
    """
    size, shingle = F.size("shingles").alias("size"), F.explode("shingles").alias("shingle")
    each = sets.join(pool, "id").select("id", "root", size, shingle)
    each = with_group(each, "shingle", "id", "n", F.lit(1), lambda c: F.sum(c.cast("long")), "shingles")
    order = Window.partitionBy("id").orderBy("n", "shingle")
    placed = each.withColumn("place", F.row_number().over(order) - 1)
    needed = F.ceil(F.col("size") * percent / F.lit(100.0))
    return placed.where((F.col("place") <= F.col("size") - needed) & (F.col("n") > 1)).drop("n")


def _possible(percent: int, x: str = "x", y: str = "y") -> Column:
    """Whether sets x and y that meet first at this shingle can reach the similarity: their
    intersection holds it and what comes behind it in either."""
    size, other = F.col(f"{x}.size"), F.col(f"{y}.size")
    most = F.least(size - F.col(f"{x}.place"), other - F.col(f"{y}.place"))
    return 100 * most >= percent * (size + other - most)


def _met(crowd: DataFrame, turn: int) -> DataFrame:
    """The rows of crowded rare shingles with ``lead``: one of the shingle's sets, another one in each turn.

    Left out are shingles whose sets are all in one component, and those of at most ``FEW`` sets: joining
    them forms less than two pairs for each row.
    """
    drawn = F.xxhash64("id", "shingle", F.lit(turn))
    one = F.struct(drawn.alias("drawn"), "id", "size", "root", "place")
    value = F.struct(one.alias("lead"), F.col("root").alias("low"), F.col("root").alias("high"), F.lit(1).alias("n"))

    def merge(c: Column) -> Column:
        return F.struct(
            F.max(c["lead"]).alias("lead"),
            F.min(c["low"]).alias("low"),
            F.max(c["high"]).alias("high"),
            F.sum(c["n"].cast("long")).alias("n"),
        )

    met = with_group(crowd, "shingle", "id", "all", value, merge)
    met = met.where((F.col("all.low") < F.col("all.high")) & (F.col("all.n") > FEW))
    return met.select(*crowd.columns, F.col("all.lead").alias("lead"))


def _led_again(met: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, ra, rb): each row's set with its ``lead``, where their components differ and they can
    reach the similarity."""
    met = met.withColumn("own", F.struct("id", "size", "root", "place"))
    found = met.where((F.col("root") != F.col("lead.root")) & _possible(percent, "own", "lead"))
    low = F.col("id") < F.col("lead.id")
    return found.select(
        F.least("id", "lead.id").alias("a"),
        F.greatest("id", "lead.id").alias("b"),
        F.when(low, F.col("root")).otherwise(F.col("lead.root")).alias("ra"),
        F.when(low, F.col("lead.root")).otherwise(F.col("root")).alias("rb"),
    ).dropDuplicates(["a", "b"])


def _raised(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """The rows of rare shingles with their component's new name, where ``tops`` (root, top) has one."""
    return lookup(rows, "root", "id", tops).withColumn("root", F.coalesce("top", "root")).drop("top")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union.

    An id that is in very many pairs as ``a`` is copied to as many salts as its partners have, so
    that its pairs are spread over the tasks.
    """
    keyed = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(tasks(pairs))))
    left = (
        keyed.select("a", "salt")
        .distinct()
        .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("one")), "a")
    )
    right = keyed.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("other")), "b")
    both = left.join(right, ["a", "salt"]).withColumn("shared", F.size(F.array_intersect("one", "other")))
    union = F.size("one") + F.size("other") - F.col("shared")
    return both.where(100 * F.col("shared") >= percent * union).select("a", "b")


def near_groups(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of ``size`` words, A-Z lower-cased (a shorter
    text is one shingle). Documents whose sets have ``percent`` % of their union in common are
    linked, and a component is named by its smallest id, whose document is kept.

    1. Equal sets are one class, represented by its smallest id; only classes go on.
    2. Table keys of the classes meet; a key that only one class has is dropped.
    3. In each table's bucket the class that meets most others leads. Each class is verified
       against its best leader, then against the other leaders that are not in its group yet.
    4. What is left are classes in buckets that hold several components: texts that share a
       passage, or copies changed too much for their leader. Sets that reach the similarity share
       one of their rarest shingles, and where they meet first bounds how much they can share.
       First each rare shingle that more than ``FEW`` sets have draws one of its sets as a new leader, and
       the others of other components are verified against it. Shingles that still lie in several
       components draw again, a few times over, and all rows take their components' new names once, at
       the end. So a large group of near copies, of which each is linked with some of the others, becomes
       one component at a cost in proportion to its size.
    5. Then the rest is joined exactly on rare shingles. Pairs of different components that can
       reach the similarity are verified, so no candidate is passed over; pairs inside one component can add
       nothing and are not formed.

    Shuffles of keys that may be hot (copies, buckets, leaders, components) are salted. Texts
    without words link with nothing. Rows with a null id form no links and are kept. Rows that
    repeat an id are one document and are listed as often as they occur. Empty tables give empty
    results. Only the two named columns are read.
    """
    sketch = settle(sketches(docs, size, id_col, text_col), "sketches")
    linkable = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    classed = settle(
        with_group(sketch.where(linkable), "digest", "doc_id", "id", F.col("doc_id"), F.min), "classes"
    )
    classes = classed.where("doc_id = id").dropDuplicates(["id"])
    keys = table_keys(classes.select("doc_id", "keys"))
    # A key is met by its classes' salts, so that the rows of a hot bucket stay spread.
    crowd = with_group(keys, "key", "id", "n", F.lit(1), lambda c: F.sum(c.cast("long")), "tables")
    crowd = settle(crowd.where("n > 1").select("id", "key", "n"), "buckets")
    sets = settle(shingle_sets(docs, crowd.select("id").distinct(), size, id_col, text_col), "sets")
    ranked = crowd.groupBy("id").agg(F.sum("n").alias("score")).join(crowd, "id")
    ranked = settle(ranked.select("id", "key", "score"), "ranked")
    rank = F.struct("score", (-F.col("id")).alias("id"))
    led = with_group(ranked, "key", "id", "first", rank, F.max)
    leader = (-F.col("first.id")).alias("leader")
    led = settle(led.select("id", "key", leader, F.col("first.score").alias("rank")), "led")
    led_pairs = led.where("id <> leader")
    best = led_pairs.groupBy("id").agg(F.max(F.struct("rank", (-F.col("leader")).alias("leader"))).alias("best"))
    tried = settle(best.select((-F.col("best.leader")).alias("a"), F.col("id").alias("b")), "first-pairs")
    links = settle(verified(tried, sets, percent), "first-links")
    # Each class is linked to one leader at most: its leader's leader names its group well enough
    # to leave out most pairs inside a component.
    led_by = links.select(F.col("b").alias("node"), F.col("a").alias("up"))
    higher = led_by.select(F.col("node").alias("up"), F.col("up").alias("top"))
    roots = settle(
        lookup(led_by, "up", "node", higher).select("node", F.coalesce("top", "up").alias("root")), "leaders"
    )

    def rooted(rows: DataFrame, name: str, root: str) -> DataFrame:
        named = roots.select(F.col("node").alias(name), F.col("root").alias(root))
        return lookup(rows, name, "key" if name == "id" else "id", named).withColumn(
            root, F.coalesce(root, name)
        )

    second = rooted(rooted(led_pairs.select("id", "key", "leader"), "id", "ra"), "leader", "rb")
    second = (
        second.where("ra <> rb")
        .select(F.col("leader").alias("a"), F.col("id").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    second = settle(second, "second-pairs")
    links = settle(links.unionByName(verified(second, sets, percent)), "second-links")
    roots = components(links)
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    tried = settle(tried.unionByName(second).select(*ordered).distinct(), "tried")

    mixed = settle(rooted(led.select("id", "key"), "id", "root"), "rooted")
    several = (
        mixed.groupBy("key")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
        .where("low <> high AND n > 2")  # of two classes, one led the other and is verified
        .select("key")
    )
    pool = settle(mixed.join(several, "key").select("id", "root").distinct(), "mixed")
    rare = settle(_rarest(sets, pool, percent), "rarest")
    drawn, crowd, moved = links.limit(0), rare, None
    for turn in range(TURNS):
        met = settle(_met(crowd, turn), "met")
        pairs = _led_again(met, percent).join(tried, ["a", "b"], "left_anti")
        pairs = settle(pairs, "drawn-pairs")
        if pairs.isEmpty():
            break
        found = settle(verified(pairs.select("a", "b"), sets, percent), "drawn-links")
        drawn, tried = drawn.unionByName(found), tried.unionByName(pairs.select("a", "b"))
        if found.isEmpty():
            break
        tied = components(pairs.join(found, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        tops = tied.select(F.col("node").alias("root"), F.col("root").alias("top"))
        crowd = settle(_raised(met.drop("lead"), tops), "crowd")
        if moved is not None:  # names of earlier turns that were tied to a smaller one now
            higher = tops.select(F.col("root").alias("top"), F.col("top").alias("higher"))
            moved = lookup(moved, "top", "root", higher).select("root", F.coalesce("higher", "top").alias("top"))
            tops = moved.unionByName(tops)
        moved = settle(tops, "moved")
    if moved is not None:
        rare = settle(_raised(rare, moved), "rarest")
    rest = (
        rare.alias("x")
        .join(rare.alias("y"), F.expr("x.shingle = y.shingle AND x.root < y.root") & _possible(percent))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    links = settle(verified(settle(rest, "rest"), sets, percent).unionByName(drawn), "links")
    if not links.isEmpty():  # the last links tie whole components together
        ends = rooted(links.select(F.col("a").alias("id"), F.col("b").alias("key")), "id", "ra")
        ends = rooted(ends.select("ra", F.col("key").alias("id")).withColumn("key", F.col("ra")), "id", "rb")
        joined = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        tops = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
        # A component's own smallest member is in no row of roots, but may be tied to a smaller one.
        roots = lookup(roots, "root", "node", tops).select("node", F.coalesce("top", "root").alias("root"))
        roots = settle(roots.unionByName(joined).distinct(), "roots")
    roots = roots.select(F.col("node").alias("id"), "root")

    found = lookup(classed.select("doc_id", "n_shingles", "id"), "id", "doc_id", roots).select(
        "doc_id", "n_shingles", F.coalesce("root", "id").alias("component_id")
    )
    alone = sketch.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.expr("doc_id <=> component_id"))

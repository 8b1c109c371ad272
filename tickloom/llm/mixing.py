"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.columns import md5_bits, settle, word_count

#: No source is taken more often than this.
MOST_COPIES = 3

#: The random offset has this many bits, so that adding it to a rank loses nothing.
OFFSET_BITS = 20


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = MOST_COPIES
) -> DataFrame:
    """Per source: source, source_size, target; sums of sizes shared out by weight.

    Sources in code-point order, null last, take the weights in turn. A target stops at ``most``
    times its source's size, and the excess goes to the others by weight until none is above.
    That fixed point is min(most * size, weight * level) with one level for all, found by sorting
    the sources by how soon they fill up. The windows here see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    every = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    rows = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .select(
            "source",
            "source_size",
            (F.col("source_size") * most).alias("cap"),
            F.row_number().over(by_name).alias("place"),
            F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
        )
        .withColumn("before", F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce("before", F.lit(0))) / F.col("left"))
        # The level grows up to the first source that it does not fill, and falls after it.
        .withColumn(
            "level",
            F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(every),
        )
    )
    share = F.coalesce(F.col("weight") * F.col("level"), F.lit(0.0))
    return rows.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target")
    )


def source_offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1), the same in each run with the seed."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return md5_bits(key, OFFSET_BITS // 4) / F.lit(float(1 << OFFSET_BITS))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    most: int = MOST_COPIES,
    seed: int = 7,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, and the columns
    named in ``carry``.

    A document's expected number of copies is its source's target over its source's size. Inside
    a source the expectations are summed up along the documents, one random offset is added, and a
    document is emitted once for each integer that its step crosses. Documents stand in order of
    their size (ties: MD5 of the id, then the id), so that every stretch of the sum holds sizes
    alike and the words taken stay near the target.

    The rank of a document comes from one range-partitioned sort over all sources, so a source
    that holds a third of the table is cut into many parts; the parts' counts, one row for each
    part and source, are then summed. Only ids, sources and sizes are shuffled.

    Null text: size 0. Null source: a source of its own. Sizes of 0 are never counted as words
    but may be emitted. Rows that repeat an id are documents of their own. An empty table gives
    an empty result. Only the named columns are read.
    """
    sizes = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            *carry,
        ),
        "mix-sizes",
    )
    order = ["source", "size", "tie", "doc_id"]
    place = F.monotonically_increasing_id()  # the part's number above, the row's number below
    ordered = settle(
        sizes.withColumn("tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "source", "size", *carry, place.alias("place"))
        .withColumn("part", F.shiftright("place", 33)),
        "mix-order",
    )
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy("source", "part")
        .agg(F.min("place").alias("first"), F.count("*").alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    )
    targets = source_targets(sizes, weights, most)
    plan = settle(
        starts.alias("s")
        .join(targets.alias("t"), F.expr("s.source <=> t.source"))
        .select("s.source", "part", "first", "start", "source_size", "target"),
        "mix-plan",
    )
    rank = F.col("start") + F.col("place") - F.col("first")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = source_offset(F.col("o.source"), seed)
    copies = F.floor((rank + 1) * rate + offset) - F.floor(rank * rate + offset)
    return (
        ordered.alias("o")
        .join(plan.alias("p"), F.expr("o.source <=> p.source AND o.part = p.part"))
        .select("doc_id", "size", "source_size", "target", copies.alias("copies"), *carry)
        .withColumn("taken", F.col("copies") * F.col("size"))
    )

"""Connected components by alternating stars, each round in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.columns import settle
from tickloom.llm.skew import with_group


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Rows (u, v), u > v: each node's neighbours (the larger or the smaller ones) and the node
    itself are tied to the smallest of all."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    both = settle(both, "star")
    found = with_group(both, "u", "v", "least", F.least("u", "v"), F.min)
    moved = found.where(F.col("v") > F.col("u")) if large else found
    moved = moved.select(F.col("v").alias("u"), F.col("least").alias("v"))
    if not large:
        own = found.select("u", F.col("least").alias("v"))
        moved = moved.unionByName(own)
    return moved.where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    hashed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), hashed).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the edges (a, b) that is not its component's smallest.

    Large stars and small stars in turn until nothing changes, about log(n) rounds. A node with
    very many neighbours is spread over the tasks by ``with_group``; nothing but a count and a
    checksum comes to the driver.
    """
    now = settle(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        now = settle(_star(settle(_star(now, True), "large"), False), "small")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

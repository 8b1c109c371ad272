"""Exact dedup: equal texts are merged inside tasks, then in salted groups, then globally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.columns import ascii_lower, tasks


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int | None = None,
    digest_bits: int = 256,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The row
    with the largest id stays. Every stage groups by digest *and* text, so texts that share a
    digest stay apart (``digest_bits=0`` gives all texts one digest, for tests).

    1. Inside a task: Spark's map-side combine merges equal texts; a text leaves a task once.
    2. Salted: rows meet by (digest, salt, text). The salt is the number of the task they come
       from, so a text that fills a third of the table spreads over ``salts`` groups, and no
       group lists more members than its share of the input.
    3. Global: the winners of the salted groups, ``salts`` per text at most, are merged by
       (digest, text), and what they find goes back to the salted groups by (digest, winner).

    A null id never wins against another one; a group of null ids keeps them all. Rows that
    repeat an id with the same text are listed (and kept) as often as they occur. An empty table
    gives an empty result. Only the two named columns are read.
    """
    salts = salts or tasks(docs)
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    digest = F.sha2("text", digest_bits) if digest_bits else F.lit("")
    merged = (
        rows.select("id", "text", digest.alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
        .groupBy("digest", "salt", "text")
        .agg(F.collect_list(F.struct("id")).alias("members"))
        .select("digest", "text", "members", F.array_max(F.col("members.id")).alias("winner"))
    )
    groups = (
        merged.select("digest", "text", "winner", F.size("members").alias("n"))
        .groupBy("digest", "text")
        .agg(
            F.max("winner").alias("keep_id"),
            F.sum("n").alias("group_size"),
            F.collect_list(F.struct("winner")).alias("winners"),
        )
        .select(
            "digest",
            "keep_id",
            "group_size",
            F.sha2("text", 256).alias("text_sha256"),
            F.explode(F.array_distinct("winners.winner")).alias("winner"),
        )
    )
    back = groups.alias("g").join(
        merged.select("digest", "winner", "members").alias("m"),
        F.expr("g.digest = m.digest AND g.winner <=> m.winner"),
    )
    return back.select(
        F.explode("m.members.id").alias("doc_id"), "g.keep_id", "g.group_size", "g.text_sha256"
    ).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )

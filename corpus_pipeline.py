"""From raw documents to token ids in five stages, each written before the next one begins.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. A stage sees only what its predecessor kept. Other columns of the input
pass through all stages with their values, whatever their names.

There is no SQL for the whole: the last stage's search has none. The tests hold ``run`` against
a plain Python version of the five stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import exact, minhash, mixing, pieces, rules
from tickloom.llm.columns import ascii_lower, settle
from tickloom.llm.queries import VOCABULARY, documents

ORACLE_SQL = None


def _own(docs: DataFrame, name: str) -> str:
    """A name that no column of the documents has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose ids are listed; a null id counts as a value."""
    name = _own(docs, "_chosen")
    chosen = ids.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def _unique(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own, written so that it stays the same, and its column."""
    row = _own(docs, "_row")
    return settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _firsts(numbered: DataFrame, row: str) -> DataFrame:
    """Rows (doc_id, text_sha256, row): one row for each id and text, null a value."""
    text = ascii_lower(F.coalesce("text", F.lit("")))
    keys = numbered.select("doc_id", F.sha2(text, 256).alias("text_sha256"), row)
    return keys.groupBy("doc_id", "text_sha256").agg(F.min(row).alias(row))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    judged = rules.apply_rules(docs)
    return judged.where(F.col("verdict")["kept"]).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays."""
    if _unique(docs):
        return _keep(docs, exact.exact_groups(docs).where("kept").select("doc_id"))
    numbered, row = _numbered(docs)
    kept = exact.exact_groups(numbered).where("kept").select("doc_id", "text_sha256").distinct()
    same = "f.doc_id <=> k.doc_id AND f.text_sha256 = k.text_sha256"
    firsts = _firsts(numbered, row).alias("f")
    rows = firsts.join(kept.alias("k"), F.expr(same), "left_semi").select(row)
    return numbered.join(rows, row, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 80 % of their shingles of five words, the one with the smallest id stays."""
    if _unique(docs):
        return _keep(docs, minhash.near_groups(docs, size=5, percent=80).where("kept").select("doc_id"))
    # Texts that share an id get ids of their own, in the same order; null ids stay null.
    numbered, row = _numbered(docs)
    own, chosen = _own(numbered, "_own"), _own(numbered, "_chosen")
    ordered = _firsts(numbered, row).orderBy("doc_id", "text_sha256")
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias(own)
    rows = settle(numbered.join(settle(ordered.select(row, number), "own-ids"), row), "one-each")
    groups = minhash.near_groups(rows, size=5, percent=80, id_col=own)
    kept = groups.where("kept").select(F.col("doc_id").alias(chosen))
    kept = kept.where(F.col(chosen).isNotNull()).distinct()
    found = rows.join(kept, F.col(own) == F.col(chosen), "left_semi")
    return found.unionByName(rows.where(F.col(own).isNull())).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source asks for, three times at most."""
    key = "doc_id"
    if _unique(docs):
        rows, copies = docs, mixing.mix(docs)
    else:
        rows, key = _numbered(docs)
        copies = mixing.mix(rows, carry=[key])
    taken, times, copy = (_own(rows, name) for name in ("_taken", "_copies", "_copy"))
    copies = copies.where("copies > 0").select(F.col(key).alias(taken), F.col("copies").alias(times))
    found = rows.join(copies, F.col(key).eqNullSafe(F.col(taken)))
    each = F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)
    return found.select(*docs.columns, each).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with the ids of each text; a column ``ids`` of the input gives way."""
    return pieces.add_ids(docs.drop("ids"), pieces.read_vocabulary(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each but the last keeps is written to the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to training sequences, in five stages; each works on all that the one before it kept.

toxicity        documents with a score of 0.3 or more go (linear-chain conditional random field, fitted on labels.toxic)
near_duplicates one document of each group of near copies stays, the one with the smallest doc_id (five-word shingles, 0.8);
                a document is a doc_id and a text, so other texts of the same doc_id are documents of their own
pii             spans of personal data, disguised ones too, become <EMAIL>, <IP>, <CARD>, <PHONE>
mixing          sources are mixed to target weights: documents repeat, shrink to their picked blocks or go
packing         token sequences of power-of-two lengths up to 1024, none across documents

Rows with a null doc_id have no place in near_duplicates' groups and stay there; the other stages take them like others. Texts without words are one
document only where id and text are the same. Empty tables go through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondeflow.llm import crf, mixing, neardup, packing, pii
from sondeflow.llm.common import forget, numbered, table, written
from sondeflow.llm.registry import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = crf.fitted(docs, table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).filter(crf.toxicity_of(F.col("text"), model)["predicted"] == 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = numbered(docs, COLUMNS).withColumn("digest", F.unhex(F.sha2("text", 256)))
    some = keyed.filter("doc_id IS NOT NULL")
    groups = neardup.near_duplicates(some.select(F.col("row").alias("doc_id"), "text"), width=5, percent=80)
    told = written(some.drop("text").join(groups.select(F.col("doc_id").alias("row"), "n_shingles", "component_id"), "row"), "told")
    # Texts without words are linked with nothing: of those, only rows of one id and text are one document.
    none = F.col("n_shingles") == 0
    group = (F.when(~none, F.col("component_id")).alias("g"), F.when(none, F.col("doc_id")).alias("i"), F.when(none, F.col("digest")).alias("d"))
    first = F.min(F.struct("doc_id", "digest", "source", "lang", "n_chars", "row"))
    stay = told.groupBy(*group).agg(first.alias("first")).select("first.row")
    lost = written(told.select("row").join(stay, "row", "left_anti"), "lost")  # fewer than those that stay, as a rule
    forget(told)
    return keyed.join(lost, "row", "left_anti").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", private), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stage's rows written as Parquet in the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed sequences: screen, deduplicate, decontaminate, pack.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of their documents, in which their decisions have taken
effect: rows go, nothing else changes. A stage works on all rows its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm import toxicity as screen
from webstrata.llm.bloom import split_off
from webstrata.llm.decontamination import contamination
from webstrata.llm.exact_dedup import exact_dedup
from webstrata.llm.frames import name, text_key
from webstrata.llm.jaccard import jaccard_classes
from webstrata.llm.packing import pack
from webstrata.session import cut


def _columns(docs: DataFrame) -> list[Column]:
    return [name(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language, by a classifier trained on the labels of the documents."""
    model = screen.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return screen.score(docs, model, out="_score").where(~screen.rejected(model, "_score")).select(*_columns(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup(docs.select(F.struct(*_columns(docs)).alias("row"), "doc_id", "text"), carry=["row"]).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by three-word shingles, the one with the least id.

    Rows that share id and text count as one document. Where several texts of a class share the least id, or no document
    of a class has an id, the one whose text has the least digest stays.
    """
    def key(id_: Column, text: Column) -> Column:
        return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), text)

    classes = cut(jaccard_classes(docs))
    least = F.col("component_id").eqNullSafe(F.col("doc_id"))
    told = key(F.col("doc_id"), F.col("text_key")).alias("gone")
    # Documents with the least id of their class: one per class, unless ids repeat.
    first = classes.where(least & F.col("class_number").isNotNull())
    kept = cut(first.groupBy("class_number").agg(F.min("text_key").alias("kept")))
    rest = first.join(kept, "class_number").where(F.col("text_key") != F.col("kept")).select(told)
    gone = classes.where(~least).select(told).unionByName(rest)
    return split_off(docs, key(name("doc_id"), text_key(name("text"))), cut(gone), "gone")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    report = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=text_key(name("text")))
    return split_off(docs, text_key(name("text")), cut(report.where("contaminated").select(F.col("key").alias("gone"))), "gone")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("exact_dedup", exact), ("ngram_jaccard", near), ("decontamination", decontaminated), ("packing", packed)]

#: The first stage applies a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

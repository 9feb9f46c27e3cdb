"""A corpus from raw documents to packed sequences: each stage reads what its predecessor wrote.

In every stage an empty table gives no rows, null ids, texts, languages and sources are values like others,
repeated rows are rows of their own, and extra columns of any name are carried to the packing, which drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import classifier, exact, jaccard, mixing, packing
from basalt.llm.common import WORD, mark, numbered, restored, stored, table
from basalt.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample takes; rows of one id and text have one decision."""
    judged = classifier.classify(docs, table(spark, sf_dir, "labels"), marks=True)
    taken = judged.where("kept").select(F.col("mark").alias("taken_mark")).distinct()
    return docs.join(taken, mark() == taken["taken_mark"], "left_semi")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without their white space the longest, then of the smallest id (a null id last); null and empty texts are one group."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links (five words, 0.8) the row of the smallest id (a null id last); texts without words all stay."""
    found = jaccard.components(docs, marks=True)
    first = found.where("n_shingles > 0").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first")).select(F.col("first.mark").alias("stays_mark"))
    stays = first.union(found.where("n_shingles = 0").select("mark").distinct())
    text = F.col(f"row_{docs.columns.index('text')}")
    rows = numbered(docs, mark()).where((F.col("row_nth") == 1) | ~F.coalesce(text, F.lit("")).rlike(WORD))
    return restored(rows.join(stays, rows["row_mark"] == stays["stays_mark"]), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, those at an arc's ends in part; rows without words are in no mix."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence of at most 1,024 ids; a row's copies are documents of their own."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact_copies), ("n-gram jaccard join", near_copies), ("mixing", mixture), ("packing", packed)]

#: The stages have no SQL: models, sketches and a tokenizer; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs

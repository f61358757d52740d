"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is
written as Parquet to the shared folder and read again as the next one's docs.
All but the last keep the columns of documents. Rows that a stage keeps are
whole rows of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowlattice.llm import exact_dedup, jaccard, mixing, packing, toxicity
from rowlattice.llm._common import new_place, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject; null and empty texts stay. A score of one half is rejected. Repeated rows are treated alike; an empty table gives an empty table."""
    return toxicity.clean_rows(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for the case of A-Z) the one with the largest doc_id; null and empty texts are equal. Of rows that repeat a doc_id and a text one stays, rows without a doc_id stay if their group has no other. An empty table gives an empty table."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 on five words connect the one with the smallest doc_id; null texts, texts without words and rows without a doc_id stay. An empty table gives an empty table."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, none to three times; texts without words once. Of equally long ones the larger doc_id is rounded first; a null source is a source. An empty table gives an empty table."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2048 tokens; a null text is a piece of one token, and repeated rows are packed each. An empty table gives an empty table."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The toxicity classifier and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = new_place(spark)  # deleted when the program ends
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    stage = STAGES[-1][1]
    stage(spark, docs, sf_dir).write.parquet(f"{place}/{STAGES[-1][0]}")
    return spark.read.parquet(f"{place}/{STAGES[-1][0]}")

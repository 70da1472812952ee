"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; `run` writes each
stage's result as Parquet in the shared folder and reads it back as the next one's docs. All stages but
the last return the columns of documents; the last adds size, source_size, target and taken.

In every stage null and empty texts are no error: they are not toxic, have no copies, hold no benchmark
item and no personal data, and stay until the mix, which takes nothing of a text without words. Texts are
read whole, however long. Rows that repeat a doc_id are judged by their own texts; one of them stays. Rows
without doc_id stay. An empty table gives an empty one. Further columns are passed on under any name, but
those named size, source_size, target and taken are replaced by the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import decontaminate, minhash, mixing, pii, toxicity
from lathe.llm.common import cut, table

#: The key of surrogates; production keys belong in a secret store.
PII_KEY = "lathe"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the label table, finds toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), texts=table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 of five-word shingles the one of least doc_id stays."""
    return minhash.without_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; n_chars follows the new text."""
    return pii.checked(pii.surrogates(docs, PII_KEY)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix of sources takes, with the number of words taken (repeats counted)."""
    return mixing.mix_sources(docs).filter("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", replace_private),
    ("mixing", mix),
]

#: No stage but the last can be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs

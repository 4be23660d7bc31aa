"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage gets the rows that the one before kept and returns the columns of documents, but for the last, which returns the
packed pieces. The stages work on whole tables and their decisions take effect: rejected rows go, boilerplate lines leave
the texts, one document of each group of near duplicates stays, and the mix repeats or leaves out documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.llm.line_dedup import dedup_lines
from genoloom.llm.mixing import mix_documents
from genoloom.llm.packing import pack_documents
from genoloom.llm.quality_rules import keep_quality
from genoloom.llm.simhash import keep_one_of_near_duplicates
from genoloom.session import drop_materialized, materialize, step

MIN_SITES = 10
CAPACITY = 2048


@step
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs)


@step
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are on MIN_SITES sources or more (but for each line's first place)."""
    return dedup_lines(docs, min_sites=MIN_SITES).withColumn("n_chars", F.length("text").cast("long"))


@step
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_of_near_duplicates(docs)


@step
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeated as often as it takes them."""
    return mix_documents(docs)


@step
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents."""
    import public_tokenizers

    return pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")), capacity=CAPACITY, added_tokens=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Tokenisation, SimHash and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written once to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_materialized(before)
    return STAGES[-1][1](spark, docs, sf_dir)

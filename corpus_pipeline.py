"""The corpus pipeline: documents without toxic ones, near duplicates and benchmark passages, packed into sequences.

Each stage takes all rows that the stage before kept and is written as Parquet in the shared folder before the next one.

Cases, for every stage: ids may be null or repeated, texts may be null, empty or very long, and the table may be empty or have
more columns, also such as the operators use inside; all but the last stage return the columns of ``documents`` and read whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowscope.llm import decontaminate, near_dedup, packing, toxicity
from flowscope.llm.store import staged
from flowscope.session import share_code


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain of classifiers doesn't call toxic.

    Texts without a letter or digit stay. Repeated rows are judged alike. Without labels of both kinds nothing goes.
    """
    return toxicity.reject(docs, share_code(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near duplicates: five-word shingles, similarity 0.8.

    A null id comes after all others; among different texts of one id a hash decides; of equal rows one stays. Texts without words are
    in no group and stay, but for repeats of an id and text.
    """
    share_code(spark)
    return near_dedup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item (or of all its words, if it has fewer).

    Texts without words stay; items without words match nothing; repeated rows are judged alike.
    """
    return decontaminate.decontaminate(docs, share_code(spark).read.parquet(f"{sf_dir}/benchmark.parquet"), "drop")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their places in sequences of 2048 tokens.

    A text without tokens is its end alone; a longer text than a sequence is cut; repeated rows are packed each.
    """
    share_code(spark)
    return packing.digest(docs)


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: Classifiers, components and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs

"""A training corpus from raw documents: five stages, each reading what the one before it kept.

Defined results: a null text is an empty one to every stage and stays null until packing. Rows are judged each by its own text,
whatever its id: a document goes if its score is toxic; of each group of near copies the row of the smallest id stays, of equal
rows one, and a row without an id only in a group without any; contaminated rows go; personal data is replaced; what is left is
packed. Repeated ids with different texts stay apart. Extra columns stay until packing, whatever their names. An empty table of
documents gives no rows; without usable labels no row is toxic, and an empty benchmark contaminates none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from tessera.llm import decontamination, jaccard_join, packing, surrogates, toxicity
from tessera.llm.common import Workspace, read
from tessera.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.replace(docs, count_col=None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("private_data", replace_private),
    ("packing", pack),
]

#: Neither the classifier nor the tokenizer can be put in SQL; tests hold the rows against plain versions of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs

"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality: documents that the classifier rejects go; all stay where the labels allow no classifier.
2. near_dedup: one document of each group of near copies stays: similarity 0.8 or more over shingles of five words.
3. decontamination: documents contaminated by the benchmark go.
4. pii: personal data becomes its kind, as in ``<EMAIL>``.
5. mixing: the documents of the mixture, repeated as often as it takes them.

Defined cases, for each stage: an empty table gives an empty one. Columns other
than doc_id, text and source are passed on, whatever their names. A null text
counts as empty: it is judged as such by quality, is a copy of other texts
without words, is never contaminated, stays null in pii, and has size 0 in
mixing. A null doc_id is a document like any other, told from others by its text
where one of several copies stays. Rows that repeat are judged alike; near_dedup
leaves one of them. Texts are read whole, however long. Documents of one id and
different texts are judged apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import decontaminate, mixing, nearcopies, pii, quality
from spanforge.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", mask_pii),
    ("mixing", mix_sources),
]

#: SQL can't train the classifier, so the pipeline is tested stage by stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From documents to a sharded training mix, in stages that each write what the next one reads.

Every stage but the last gives back the columns of its documents, further ones included,
whatever their names. Null and empty texts, null and repeated ids and empty tables are no
error; what becomes of them stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bagminhash, decontaminate, mix_sources, shard_ring, toxicity_chain
from tidemark.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    Null and empty texts have no words and stay, unless the base rates alone reach the
    threshold; null ids are judged like others. Equal texts share the verdict. Without labels all stay.
    """
    return toxicity_chain.clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the smallest id.

    Null and empty texts are one class. A class without any id keeps one row; of rows with
    the same id and text one stays, by a checksum of its columns.
    """
    return bagminhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other values, go.

    Null and empty texts hold none and stay. Rows are judged by their text, so null ids and
    repeated rows are treated alike. Without a benchmark all stay.
    """
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents stay out, or come once or twice.

    The null source is one source, in last place. Null and empty texts have no words: they
    come as often as their source has whole epochs. Null ids draw by their text; equal rows share a draw.
    """
    return mix_sources.mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest: every row's shard and slot, with all its columns but the text.

    Columns named like one that is made (``shard_ring.MADE``) are replaced. Null and empty
    texts have size 1; equal rows get slots of their own.
    """
    return shard_ring.sharded(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learned models and probabilistic signatures are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

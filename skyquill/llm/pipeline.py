"""A training corpus from documents: five operators, one after another, each on what its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it back as the next stage's docs. A stage's files are deleted once the next stage is written.

Defined cases: a row without a text is rejected by the quality rules, as is an empty one; a row without an id is judged by its text alone in the
first two stages, is no near copy of anything, and goes if any row without an id leaks an item; rows that share id and text are judged
alike, and of rows that share an id the near-duplicate stage keeps one; a null source is a source of its own; further columns go
along, and one named copy or shuffle_key keeps its name, the mixture's own then ends in ``_``; an empty table gives an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyquill.llm import decontaminate, jaccard_join, mixing, quality_rules, toxicity
from skyquill.llm.common import discard, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic; it is fitted on the labelled documents of the stage's input."""
    chain = toxicity.fit(docs, toxicity.training_labels(spark, sf_dir))
    return toxicity.remove_toxic(docs, chain)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies."""
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture in which every source has the same share."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
]

#: The classifier chain and the template join have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").lower())
        if before is not None:
            discard(before)
        before = docs
    return docs

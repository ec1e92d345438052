"""The corpus pipeline: rules, classifier, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next stage's documents. All stages but the last
keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aeroframe.llm import ngram_join, packing, pu_classifier, quality_rules, substring_dedup
from aeroframe.llm.common import prepare, scratch, table
from aeroframe.llm.queries import tokenizer


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The trees are fitted on labelled rows of this stage's input.

    Null and empty texts go, as too short ones do; repeated rows are judged alike.
    """
    return quality_rules.keep_good(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier takes for good ones.

    It is fitted on this stage's input; without labelled positives there every text
    has the score one half and stays. Repeated rows are judged alike.
    """
    return pu_classifier.keep_quality(docs, pu_classifier.fit_classifier(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id.

    Documents without a word and rows without a doc_id stay; rows that repeat a doc_id go or stay together.
    """
    prepare(spark)
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds. All rows stay, a text may become empty.

    Of rows that repeat a doc_id only those with the least text are cut.
    """
    prepare(spark)
    return substring_dedup.remove_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences that hold all that is left; a null or empty text is its end id alone."""
    prepare(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", pack),
]

#: The stages fit models and chain matches, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again. An empty table gives no piece.

    Columns beside doc_id and text go along, whatever their names, up to the last stage, which returns its own.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

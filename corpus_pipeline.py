"""From raw documents to packed sequences: quality, toxicity, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Nulls and empty texts: a null text counts as empty; the classifiers score empty texts as they score any other, all empty
texts are near copies of each other, passages leave them as they are, and packing gives them their closing id. Rows without
an id are documents of their own, which training leaves out. Ties and repeated rows: classifiers treat equal texts alike;
of rows that share an id or are near copies one stays, the least id's, then the least text's. An empty table gives no rows at
every stage, and without labels no document is rejected as toxic and all are kept as good. Columns beyond those of documents
pass through by name, whatever they are called. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import dedup, packing, quality, suffix, toxicity
from gridloom.llm.common import Scratch, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by SimHash and by verified MinHash links: the one with the least id."""
    return dedup.one_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's text without the passages that earlier documents hold; documents of which nothing is left go."""
    return suffix.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of the texts in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", good), ("toxicity", civil), ("near_dedup", distinct), ("passage_dedup", unrepeated), ("packing", packed)]

#: Gradient boosting, suffix sorting and tokenising aren't expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = scratch.keep(docs)
    return docs

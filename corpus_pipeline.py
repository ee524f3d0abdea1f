"""A corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Between stages run() writes a table to the
shared folder, as every stage reads its input more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazardspark.llm import common as c
from hazardspark.llm import language_id, ngram_jaccard, packing, substring_dedup, toxicity


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or that no learnt language clearly explains best, go; null and empty texts, too. Learnt from docs themselves; an empty table stays empty."""
    return language_id.identified(docs, language_id.fit(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learnt from those that have a label. Null and empty texts are scored as texts without words."""
    labels = c.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, language_id.fit(docs))
    return toxicity.clean(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five words, Jaccard 0.8 or more) the smallest id stays; rows without an id stay."""
    groups = ngram_jaccard.ngram_jaccard(docs)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 13 that a smaller id has go; what is left is the text of later stages."""
    return substring_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts left, with their sequence and offset. Null and empty texts are the end id alone; an empty table gives none."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("substring_dedup", no_repeated_passages),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = c.stored(docs)
    return docs

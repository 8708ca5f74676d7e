"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
has kept; all but the last return the columns of ``documents``, whatever further
columns there are and whatever their names. Texts are read whole. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepsake.llm import classifier, mixing, ngramjoin, rules
from keepsake.llm.common import META, Scratch, table, tokenizer_path
from keepsake.llm.packing import pack


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and empty texts have no words, null metadata is a value like any other;
    repeated rows go or stay together; without labels of both kinds all stay.
    """
    return classifier.keep_accepted(docs, classifier.fit(docs, table(spark, sf_dir, "labels"), META))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go.

    Null and empty texts and texts under 50 words go; repeated rows go or stay
    together; without labels the base rules decide alone.
    """
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays.

    Of repeated rows one stays; texts without words and rows without an id are
    copies of nothing.
    """
    return ngramjoin.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the raked weights of their source, language and topic.

    Null values are values like any other; rows of one id stay or go together if
    they are of one cell.
    """
    return mixing.sample(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, placed in sequences of 2048 tokens; a null text is its closing id alone."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Not expressible in SQL: the classifier, the rules and the tokenizer are models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written once and reread by the next."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.save(out, f"stage{i}")
    return docs

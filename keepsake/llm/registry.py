"""Queries and SQL of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, editcount, mainhtml, oracles
from .common import META, table, tokenizer_path
from .licences import scan
from .mixing import mix
from .ngramjoin import link_components
from .packing import pack
from .rules import judge
from .sharding import hilbert_shards
from .vectordups import near_duplicates


def op1_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", editcount.review_edits().alias("edits"))
    return editcount.count_edited(docs, "edits", tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(table(spark, sf_dir, "documents"), ["source", "lang"], shards=40, keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("curve").cast("long").alias("curve"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_decision_list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


def op6_max_subsequence_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return mainhtml.extract_all(pages, mainhtml.fit(pages), keep=["page_id", "url"])


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ","))


def op8_cotrained_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"), META)
    return classifier.score(docs, model, keep=["doc_id"])


def op9_pruned_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))[0]


def op10_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source", "lang"])
    return mixed.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.col("_probability").alias("probability"), F.col("_sampled").alias("sampled"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    import corpus_pipeline  # noqa: F401  the pipeline's module belongs to this subpackage

    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """The others are models, tokenizers or sampled quantiles; their tests compare them with brute force."""
    return {"op5_prefix_tree_join": oracles.NGRAM_JOIN, "op7_licence_digests": oracles.licence_digests(), "op9_pruned_graph_dedup": oracles.VECTOR_LINKS}

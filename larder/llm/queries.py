"""The operators of this package as registered queries over whole tables.

Each query maps the given tables to dossiers or pages, calls one operator and maps its rows back.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.language import learn_and_score
from larder.llm.leaks import mark_leaks
from larder.llm.manifest import build_manifest, check_dossiers
from larder.llm.nearcopies import near_copies
from larder.llm.packing import pack_dossiers
from larder.llm.quality import fit_quality, score_quality
from larder.llm.steptrie import grow_trie, number_steps
from larder.llm.substrings import drop_repeated_passages
from larder.llm.suffixes import repeated_passages
from larder.llm.textrules import judge_texts
from larder.llm.toxicity import fit_toxicity, score_toxicity
from larder.llm.urlrules import judge_urls
from larder.llm.warc import archived_pages

Query = Callable[[SparkSession, str], DataFrame]


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as dossiers."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("recipe_id"), "text")


def fetched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under the names of the page tables."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("source_url"), "html")


def fold(folds: int) -> Column:
    """The fold of a dossier: CRC-32 of its id as text."""
    return F.crc32(F.col("recipe_id").cast("string").cast("binary")) % folds


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document; ``doc_id`` differs from ``class_id`` in those to drop."""
    return near_copies(dossiers(spark, sf_dir)).withColumnRenamed("recipe_id", "doc_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items whose windows of ten words occur in each document, and how many of its words they hit."""
    marks = mark_leaks(dossiers(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marks.select(
        F.col("recipe_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a model of order 3 learnt outside the held-out fold. A null or empty text is the end alone."""
    docs = dossiers(spark, sf_dir)
    model, scores = learn_and_score(docs, fold(5) != 1)
    return scores.select(
        F.col("recipe_id").alias("doc_id"),
        (fold(5) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated passage of a document."""
    found = repeated_passages(dossiers(spark, sf_dir)).select("recipe_id", F.explode("spans").alias("span"))
    return found.select(
        F.col("recipe_id").alias("doc_id"),
        F.col("span.start").cast("long").alias("start_word"),
        F.col("span.size").cast("long").alias("n_words"),
        F.col("span.first_recipe_id").alias("first_doc_id"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labels outside the held-out fold. Empty texts have a score, too."""
    docs = dossiers(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("recipe_id"), F.col("quality").alias("good")
    )
    weights = fit_quality(docs, labels.filter(fold(3) != 1))
    return score_quality(docs, weights).select(
        F.col("recipe_id").alias("doc_id"),
        (fold(3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, compression ratios and verdict of every document. A null or empty text has no words and fails."""
    return judge_texts(dossiers(spark, sf_dir)).withColumnRenamed("recipe_id", "doc_id")


def tokenizer_path() -> str:
    """The byte-level BPE file: ``LARDER_TOKENIZER``, else that of the installed package of public tokenizers."""
    if given := os.environ.get("LARDER_TOKENIZER"):
        return given
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place; a null text is the end id alone."""
    return pack_dossiers(dossiers(spark, sf_dir), tokenizer_path()).withColumnRenamed("recipe_id", "doc_id")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of the address of every page; an address without ``://`` has neither host nor path."""
    return judge_urls(fetched_pages(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each page, after they were written and read again. A null page is an empty payload."""
    return archived_pages(fetched_pages(spark, sf_dir)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of 13 words that a document with a smaller id holds."""
    return drop_repeated_passages(dossiers(spark, sf_dir)).select(
        F.col("recipe_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; those of one fold are found again with A-Z in lower case, and folded to other roots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("recipe_id"), "source", F.col("lang").alias("language"), "n_chars", "text"
    )
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.when(fold(5) == 0, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    return check_dossiers(build_manifest(docs, found)).withColumnRenamed("recipe_id", "doc_id")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the conversations as recipes and their turns as steps; conversations in fives share the first turns of one of them."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = number_steps(turns.select(F.col("conv_id").alias("recipe_id"), F.col("turn").alias("step_no"), "role", "text"), ("role", "text"))
    own = own.withColumn("base", F.col("recipe_id") - F.col("recipe_id") % 5)
    sizes = own.groupBy("recipe_id", "base").agg(F.count(F.lit(1)).alias("steps")).withColumn("taken", fold(9))
    lent = own.filter("recipe_id = base and position <= 8").select("base", "position", "code")
    held = lent.groupBy("base").agg(F.count(F.lit(1)).alias("lent"))
    # who takes how many of how many: one row per conversation
    recipes = sizes.join(held, "base", "left").select("recipe_id", "base", "taken", F.coalesce("lent", F.lit(0)).alias("lent"))
    begins = recipes.join(lent, "base").filter("position <= taken").select("recipe_id", "position", "code")
    shift = F.least("taken", "lent") - F.col("taken")
    goes_on = own.drop("base").join(recipes, "recipe_id").filter("position > taken").select("recipe_id", (F.col("position") + shift).alias("position"), "code")
    nodes = grow_trie(recipes.select("recipe_id"), begins.unionByName(goes_on))
    named = {"recipe_id": "conv_id", "parent_recipe_id": "parent_conv_id", "n_recipes": "n_convs", "saved_bytes": "saved_tokens"}
    return nodes.withColumnsRenamed(named)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels outside the held-out fold."""
    docs = dossiers(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("recipe_id"), "toxic")
    model = fit_toxicity(docs, labels.filter(fold(5) != 0))
    return score_toxicity(docs, model).select(
        F.col("recipe_id").alias("doc_id"),
        (fold(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_minhash_near_dedup,
            op2_benchmark_decontamination,
            op3_lm_scoring,
            op4_suffix_array_dedup,
            op5_quality_classifier,
            op6_quality_rules,
            op7_packing,
            op8_url_filters,
            op9_warc,
            op10_substring_dedup,
            op11_merkle_manifest,
            op12_conversation_trie,
            op13_toxicity,
        )
    }

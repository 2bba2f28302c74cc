"""The corpus pipeline: quality, near copies, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. Between stages the documents are
written to the shared folder, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.leaks import mark_leaks
from larder.llm.nearcopies import near_copies
from larder.llm.packing import pack_dossiers
from larder.llm.quality import fit_quality, keep_good
from larder.llm.queries import tokenizer_path
from larder.llm.suffixes import without_repeated_passages
from larder.session import ensure_checkpoint_dir

#: Ids up to which a list of dropped documents is broadcast (8 MB); a longer one is joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


_ROW = "_pipeline_row_id"


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with the number that a decision on a row carries: its id where no other row has it.

    Rows that share an id get a number from id and text, after all others, and those without an id one after these: decisions are then
    made and carried out for each of their texts by itself.
    """
    after = F.when(F.col("doc_id").isNull(), F.lit(3 << 61)).otherwise(F.lit(1 << 62))
    from_text = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61)) + after
    again = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select(F.col("doc_id").alias("again_id"), F.lit(True).alias("again"))
    folder = _folder(docs.sparkSession)
    again.write.parquet(folder)
    again = docs.sparkSession.read.schema("again_id long, again boolean").parquet(folder)
    if again.isEmpty():
        return docs.withColumn(_ROW, F.col("doc_id").cast("long"))
    again = F.broadcast(again) if again.count() <= MAX_BROADCAST_IDS else again
    joined = docs.join(again, F.col("doc_id").cast("long").eqNullSafe(again["again_id"]), "left")
    return joined.withColumn(_ROW, F.when(again["again"], from_text).otherwise(F.col("doc_id").cast("long"))).select(*[docs[c] for c in docs.columns], _ROW)


def _dossiers(named: DataFrame) -> DataFrame:
    return named.select(F.col(_ROW).alias("recipe_id"), "text")


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def _without(named: DataFrame, dropped: DataFrame) -> DataFrame:
    """``named`` but for the rows whose number is in ``dropped`` (``recipe_id``), without the numbers."""
    folder = _folder(named.sparkSession)
    dropped.select(F.col("recipe_id").alias("dropped_id")).distinct().write.parquet(folder)
    dropped = named.sparkSession.read.parquet(folder)
    dropped = F.broadcast(dropped) if dropped.count() <= MAX_BROADCAST_IDS else dropped
    return named.join(dropped, named[_ROW] == dropped["dropped_id"], "left_anti").drop(_ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects. It learns from all labels of these documents.

    Each text is judged by itself, also those that share an id or have none. Without labels every document scores 0.5 and stays.
    An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.select(F.col("doc_id").alias("recipe_id"), F.col("quality").alias("good"))
    return keep_good(docs, fit_quality(docs.select(F.col("doc_id").alias("recipe_id"), "text"), labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near copies, and of repeated rows one.

    Different texts that share an id are judged each by itself. An empty table stays empty.
    """
    again = docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again_id"))
    if not again.isEmpty():
        same = docs["doc_id"].eqNullSafe(again["again_id"])
        once = docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
        docs = docs.join(again, same, "left_anti").unionByName(once)
    named = _named(docs)
    classes = near_copies(_dossiers(named))
    return _without(named, classes.filter("class_id != recipe_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that an earlier document holds; drop documents of which nothing is left.

    Null, empty and blank texts stay. A document without an id comes after all others. An empty table stays empty.
    """
    named = docs.withColumnRenamed("recipe_id", "_given_recipe_id").withColumn("recipe_id", F.col("doc_id"))
    cut = without_repeated_passages(named).drop("recipe_id").withColumnRenamed("_given_recipe_id", "recipe_id")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark.

    Of different texts that share an id only those that hold one go. An empty table stays empty.
    """
    named = _named(docs)
    marks = mark_leaks(_dossiers(named), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(named, marks.filter("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and place.

    Rows that share an id, have none or are alike are packed each; a null text is the end id alone. An empty table gives an empty one.
    """
    named = docs.select(F.col("doc_id").alias("recipe_id"), "text")
    return pack_dossiers(named, tokenizer_path()).withColumnRenamed("recipe_id", "doc_id")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Classifier, sampling and tokenizer have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), _folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}-{name}")
    return docs

"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes the rows that its predecessor kept. All stages but the last return the columns
of ``documents``. Rows are told apart by doc_id and text: of rows that repeat both, a stage that
drops copies keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabcascade.llm import decontaminate, exact_dedup, jaccard, packing, quality
from tabcascade.llm.common import shared, small_enough

TOKENIZER = "word_bpe_49k.json"


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` for which ``decided`` (doc_id, row_hash, kept; one per row) says so."""
    decided = shared(decided.select("doc_id", "row_hash", "kept"), "decided")
    mixed = decided.where("NOT kept").groupBy("doc_id", "row_hash").count()
    stays = decided.where("kept").select("doc_id", "row_hash").distinct()
    same = mixed["doc_id"].eqNullSafe(stays["doc_id"]) & (mixed["row_hash"] == stays["row_hash"])
    gone = shared(mixed.join(stays, same, "left_anti").select("doc_id", "row_hash"), "gone")
    rows = _without(docs, gone)
    repeats = shared(mixed.join(stays, same, "left_semi").select("doc_id", "row_hash"), "repeats")
    if repeats.isEmpty():
        return rows
    once = _without(rows, repeats, "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(rows, repeats).unionByName(once)


def _without(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    small = small_enough(keys.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")), keys.count(), 32)
    return docs.join(small, docs["doc_id"].eqNullSafe(F.col("__id")) & (own == F.col("__hash")), how)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, trained as in its query on these documents' labels.

    Null texts are scored as empty ones. Rows of one id and text share their score, so all of them
    stay or go.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.learn_from(4, 2))
    return quality.accepted_rows(docs, model)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for spaces; null texts are empty ones."""
    return _kept(docs, exact_dedup.deduplicate(docs))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of documents linked by shingles of five words.

    Documents without words, or with null text, are alone and stay; a component without any id
    stays whole.
    """
    found = jaccard.join_components(docs, width=5, percent=80)
    first = F.row_number().over(Window.partitionBy("component_id", "doc_id").orderBy("row_hash"))
    alone = F.col("component_id").isNull() | (F.col("n_shingles") == 0)
    return _kept(docs, found.withColumn("kept", alone | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (first == 1))))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, shared(found.select("doc_id", "row_hash").distinct(), "leaks"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, each with its place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact),
    ("n-gram Jaccard join", drop_near),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: Classifier, components and tokenizer are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

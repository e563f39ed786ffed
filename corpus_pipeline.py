"""A corpus pipeline: language, quality, near duplicates, benchmark passages, packing.

Each stage takes the rows that its predecessor kept and works on all of them.  A stage that drops
documents finds the rows to drop and leaves the others as they are, with all their columns; a row is
known by its id and a hash of all its columns, so repeated and null ids need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.decontamination import find_contamination
from turnwise.llm.language import document_rows, fit_languages, identify_languages
from turnwise.llm.packing import pack
from turnwise.llm.quality import fit_quality, score_quality
from turnwise.llm.similar import similar_groups
from turnwise.session import cut_lineage, cut_texts

TOKENIZER = "word_bpe_49k.json"


def row_key(docs: DataFrame) -> Column:
    """Id and content of a row; rows that are equal in all columns have equal keys."""
    content = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{c}`").isNull() for c in docs.columns])
    return F.struct(F.col("doc_id").alias("doc_id"), content.alias("content"))


def picked(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose key is (``left_semi``) or is not (``left_anti``) in ``keys`` (``key``)."""
    listed = keys.select(F.col("key.doc_id").alias("doc_id"), F.col("key.content").alias("content")).distinct()
    rows = docs.select(F.struct("*").alias("row"), row_key(docs).alias("key"))
    same = (rows["key.content"] == listed["content"]) & rows["key.doc_id"].eqNullSafe(listed["doc_id"])
    return rows.join(listed, same, how).select("row.*")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: no letters, or no language likely enough."""
    found = identify_languages(document_rows(docs, row_key(docs)), fit_languages(docs))
    return picked(docs, found.where(~F.col("accepted")).select(F.col("id").alias("key")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier predicts to be bad."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return score_quality(rows, model).where("predicted = 1").select("row.*")


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the first by id and content, one of rows that are all equal.

    Near duplicates share 0.8 or more of their shingles of five words, directly or by way of others.
    """
    keyed = docs.select(row_key(docs).alias("key"), "text")
    found = cut_lineage(similar_groups(keyed, id="key"))
    rest = picked(docs, found.where("key <> first"), "left_anti")
    repeated = found.where("key = first").groupBy("key").count().where("count > 1")
    if repeated.isEmpty():
        return rest
    return picked(rest, repeated, "left_anti").unionByName(picked(rest, repeated, "left_semi").distinct())


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    keyed = docs.select(row_key(docs).alias("key"), "text")
    found = cut_texts(find_contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id="key"))
    return picked(docs, found, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences of 4096 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", languages),
    ("quality classifier", quality),
    ("near-dedup", duplicates),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", packing),
]

# Trained models, fingerprints and tokens can't be said in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again; the places of the pieces that stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs

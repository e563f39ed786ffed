"""Word and subword labels of token classifiers.

Subword tables have ``item, side, tok, word`` (``word`` NULL for special tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.measures import col
from turnwise.functions.text import mark_upper
from turnwise.operators.evaluation import both_sides, threshold_labels

IGNORED = -100
SEPARATOR = "[SEP]"


def word_labels(subwords: DataFrame, value: str = "label") -> DataFrame:
    """The first subword of a word carries the prediction."""
    return subwords.where(F.col("word").isNotNull()).groupBy("item", "side", "word").agg(
        F.min_by(value, "tok").alias(value))


def subword_labels(subwords: DataFrame, words: DataFrame, value: str = "label") -> DataFrame:
    """Word labels on first subwords, IGNORED elsewhere.

    Special tokens have no word and skip the window, where they would form one group.
    """
    win = Window.partitionBy("item", "side", "word").orderBy("tok")
    real = subwords.where(F.col("word").isNotNull()).withColumn("nth", F.row_number().over(win))
    labelled = real.join(words, ["item", "side", "word"], "left").withColumn(
        value, F.when(F.col("nth") == 1, F.coalesce(F.col(value).cast("int"), F.lit(IGNORED))).otherwise(IGNORED))
    special = subwords.where(F.col("word").isNull()).withColumn(value, F.lit(IGNORED))
    cols = ["item", "side", "tok", "word", value]
    return labelled.select(cols).unionByName(special.select(cols))


def joined_words(first, second):
    return F.concat(col(first), F.array(F.lit(SEPARATOR)), col(second))


def joined_labels(first, second):
    return F.concat(col(first), F.array(F.lit(0).cast("int")), col(second))


def split_at_separator(words, labels):
    """Labels before and after the separator word."""
    at = F.array_position(col(words), SEPARATOR).cast("int")
    return F.struct(
        F.slice(col(labels), F.lit(1), at - 1).alias("first"),
        F.slice(col(labels), at + 1, F.size(col(labels)) - at).alias("second"))


def pair_verdicts(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Label and upper-cased texts from token probabilities of both sides."""
    labelled = rows.withColumns({
        "guest_labels": threshold_labels("guest_probs", threshold),
        "host_labels": threshold_labels("host_probs", threshold)})

    def marked(side: str):
        on = F.filter(F.transform(f"{side}_labels", lambda x, i: F.when(x == 1, i + 1)), lambda i: i.isNotNull())
        return mark_upper(f"{side}_toks", on).alias(f"{side}_text")

    return labelled.select("item", both_sides("guest_labels", "host_labels").alias("label"),
                           marked("guest"), marked("host"), "guest_labels", "host_labels")

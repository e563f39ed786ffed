"""Token highlights: weights, overlap and unitising agreement.

Highlight tables have ``item, annotator, hl`` with ``hl`` an array of 1-based token numbers; token
tables have ``item, toks``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.measures import jaccard, ratio
from turnwise.functions.text import dense, equal_spans, lexical_jaccard, marked_flags, marked_numbers, marked_text
from turnwise.operators.agreement import alpha_from_units
from turnwise.plans.tiles import pairwise_jaccard


def token_counts(marks: DataFrame) -> DataFrame:
    """How many annotators marked each token; only marked tokens get a row."""
    return marks.select("item", F.explode(F.array_distinct("hl")).alias("tok")).groupBy("item", "tok").agg(
        F.count(F.lit(1)).alias("c"))


def item_votes(marks: DataFrame) -> DataFrame:
    """Annotators with a non-empty highlight and all annotators per item."""
    return marks.groupBy("item").agg(
        F.count_if(F.size("hl") > 0).alias("yes"), F.count("hl").alias("n"))


def token_weights(marks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per item the array of weights: markers of a token over yes-voters, 0 for unmarked tokens.

    Only marked tokens are shuffled; they are at most as many as the text is long, and the zeros
    between them are filled in when the array is built.
    """
    marked = token_counts(marks).groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct(F.col("tok").cast("int").alias("pos"), F.col("c").alias("c")))).alias("at"))
    rows = tokens.join(item_votes(marks), "item").join(marked, "item", "left")
    entries = F.transform(F.coalesce("at", F.array().cast("array<struct<pos:int,c:bigint>>")), lambda m: F.struct(
        m["pos"].alias("pos"), (m["c"] / F.greatest("yes", F.lit(1))).alias("val")))
    return rows.select("item", "toks", dense(F.size("toks"), entries, F.lit(0.0)).alias("weights"), "yes", "n")


def individual_records(marks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per annotator the 0/1 array over the tokens and the label."""
    return marks.join(tokens, "item").select(
        "item", "annotator", (F.size("hl") > 0).cast("int").alias("label"), "toks",
        marked_flags(F.size("toks"), "hl").alias("flags"))


def zip_sum(arrays: DataFrame, value: str = "flags") -> DataFrame:
    """Position-by-position sum of the arrays of an item; only non-zero positions become rows."""
    sizes = arrays.groupBy("item").agg(F.max(F.size(value)).alias("len"))
    marked = F.array_compact(F.transform(value, lambda x, i: F.when(x != 0, F.struct((i + 1).alias("pos"), x.alias("v")))))
    sums = arrays.select("item", F.inline(marked)).groupBy("item", "pos").agg(F.sum("v").alias("val"))
    lists = sums.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("pos", "val"))).alias("at"))
    rows = sizes.join(lists, "item", "left")
    zero = F.lit(0).cast(sums.schema["val"].dataType)
    entries = F.coalesce("at", F.array().cast(lists.schema["at"].dataType))
    return rows.select("item", dense("len", entries, zero).alias("sums"))


def joint_jaccard(marks: DataFrame) -> DataFrame:
    """Overlap of all annotators of an item: tokens marked by all over tokens marked by any.

    Items with an empty highlight are skipped.  Works on counts, so no list of annotators is built.
    """
    people = item_votes(marks).where(F.col("yes") == F.col("n"))
    counts = token_counts(marks).join(people, "item")
    return counts.groupBy("item").agg(
        (F.count_if(F.col("c") == F.col("n")) / F.count(F.lit(1))).alias("jaccard"))


def mean_joint_jaccard(marks: DataFrame) -> DataFrame:
    """Mean over items; 0 when every item was skipped, NULL without any input."""
    skipped = marks.agg(F.when(F.count(F.lit(1)) > 0, F.lit(0.0)).alias("zero")).withColumn("k", F.lit(1))
    mean = joint_jaccard(marks).agg(F.avg("jaccard").alias("m")).withColumn("k", F.lit(1))
    return mean.join(skipped, "k").select(F.coalesce("m", "zero").alias("mean_jaccard"))


def mean_pairwise_jaccard(marks: DataFrame) -> DataFrame:
    """Mean over all pairs of non-empty highlights within an item."""
    per = pairwise_jaccard(marks)
    return per.agg((F.sum("overlap") / F.sum("pairs")).alias("pairwise_jaccard"), F.sum("pairs").cast("long").alias("n_pairs"))


def unitising_alpha(marks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Krippendorff alpha with the tokens as units; annotators with an empty highlight are missing.

    All unmarked tokens of an item have the same counts (0 marks), so they enter as one weighted row.
    """
    people = item_votes(marks).where("yes > 0").select("item", "yes")
    counts = token_counts(marks)
    marked = counts.join(people, "item").select(
        (F.col("yes") - F.col("c")).alias("n0"), F.col("c").alias("n1"), F.lit(1).cast("long").alias("w"))
    touched = counts.groupBy("item").agg(F.count(F.lit(1)).alias("k"))
    silent = tokens.select("item", F.size("toks").alias("len")).join(people, "item").join(touched, "item").select(
        F.col("yes").alias("n0"), F.lit(0).cast("long").alias("n1"), (F.col("len") - F.col("k")).alias("w"))
    return alpha_from_units(marked.unionByName(silent), weight="w")


def overlap_report(marks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairwise Jaccard, unitising alpha, mean text length and mean length of non-empty highlights."""
    key = F.lit(1).alias("k")
    parts = [
        mean_pairwise_jaccard(marks).select(key, "pairwise_jaccard"),
        unitising_alpha(marks, tokens).select(key, "alpha"),
        tokens.join(marks.select("item").distinct(), "item", "left_semi").agg(
            F.avg(F.size("toks")).alias("mean_len")).select(key, "mean_len"),
        marks.where(F.size("hl") > 0).agg(F.avg(F.size("hl")).alias("mean_hl_len")).select(key, "mean_hl_len"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "k")
    return out.drop("k")


def highlight_texts(marks: DataFrame, tokens: DataFrame) -> DataFrame:
    return marks.join(tokens, "item").select("item", "annotator", marked_text("toks", "hl").alias("text"))


def side_similarity(guest: DataFrame, host: DataFrame) -> DataFrame:
    """Token overlap of the guest and the host highlight text of each (item, annotator), with its mean.

    Both tables have ``item, annotator, text``; pairs of empty texts are left out.
    """
    both = guest.join(host.withColumnRenamed("text", "other"), ["item", "annotator"])
    j = lexical_jaccard("text", "other")
    return both.agg(F.avg(j).alias("mean_jaccard"), F.count(j).alias("n"))


def mean_cosine(vectors: DataFrame) -> DataFrame:
    """Mean pairwise cosine within each item (``item, vec``).

    The cosines of all pairs sum to (|sum of unit vectors|^2 - n) / 2, so the vectors are added up
    instead of paired.
    """
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = vectors.select("item", F.transform("vec", lambda x: x.cast("double")).alias("vec"), norm.alias("norm")) \
        .where("norm > 0")
    sums = unit.select("item", F.posexplode("vec").alias("d", "x"), "norm").groupBy("item", "d").agg(
        F.sum(F.col("x") / F.col("norm")).alias("s"), F.count(F.lit(1)).alias("n"))
    per = sums.groupBy("item").agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("sq"))
    return per.where("n > 1").select(
        "item", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"),
        ((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_cosine"))


def overall_cosine(vectors: DataFrame) -> DataFrame:
    per = mean_cosine(vectors)
    return per.agg(F.sum("n_pairs").alias("n_pairs"),
                   (F.sum(F.col("mean_cosine") * F.col("n_pairs")) / F.sum("n_pairs")).alias("mean_cosine"))


def weight_spans(weights: DataFrame) -> DataFrame:
    """Spans of tokens with equal weight: start, stop (exclusive), weight, text."""
    return weights.select("item", "toks", F.explode(equal_spans("weights")).alias("s")).select(
        "item", "s.start", "s.stop", "s.weight",
        F.array_join(F.slice("toks", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")), " ").alias("text"))


def inconclusive(weights: str = "weights"):
    """Some weight is positive but none reaches one half."""
    return ~F.exists(weights, lambda x: x >= 0.5) & (
        F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) > 0)


def average_highlight_length(weights: DataFrame, column: str = "weights") -> DataFrame:
    n = F.size(F.filter(column, lambda x: x >= 0.5))
    return weights.agg(F.avg(F.when(n > 0, n)).alias("mean_len"), F.count_if(inconclusive(column)).alias("inconclusive"))


def weight_jaccard(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean overlap of two weight arrays cut at one half, where both highlight something."""
    j = jaccard(marked_numbers(a), marked_numbers(b))
    return pairs.agg(F.avg(j).alias("mean_jaccard"), F.count(j).alias("n_both"), F.count(F.lit(1)).alias("n"))


def candidate_positions(marks: DataFrame) -> DataFrame:
    """Share of items per number of marked tokens (relative histogram)."""
    per = marks.groupBy(F.size("hl").alias("n_marked")).agg(F.count(F.lit(1)).alias("n"))
    total = marks.agg(F.count(F.lit(1)).alias("total")).withColumn("k", F.lit(1))
    return per.withColumn("k", F.lit(1)).join(F.broadcast(total), "k").select(
        "n_marked", "n", ratio("n", "total").alias("share"))

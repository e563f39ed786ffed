"""Classification quality from confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.measures import binary_entropy, majority, ratio


def confusion(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return pairs.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 for an empty denominator."""
    hit = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(F.lit(0).cast("long"))
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 hit.alias("hit")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    per = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                     F.sum("hit").alias("hit"))
    return per.select(
        "label", ratio("hit", "predicted").alias("precision"), ratio("hit", "support").alias("recall"),
        ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"), "support", "hit")


def macro_scores(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Accuracy and unweighted means of precision, recall and F1 over the classes."""
    return class_report(confusion(pairs, gold, pred)).agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def difficulty(pairs: DataFrame, share: str = "share") -> DataFrame:
    """Distance of the human share from 1/2 and its entropy, for right and wrong predictions."""
    return pairs.groupBy((F.col("gold") == F.col("pred")).alias("correct")).agg(
        F.avg(F.abs(F.lit(0.5) - F.col(share))).alias("mean_distance"),
        F.avg(binary_entropy(share)).alias("mean_entropy"), F.count(F.lit(1)).alias("support"))


def model_majority(counts: DataFrame) -> DataFrame:
    """Label of repeated answers: yes / (yes + no) >= 1/2, 0 when nothing was parsed."""
    seen = F.col("yes") + F.col("no")
    return counts.withColumn("pred", F.when(seen > 0, majority(F.col("yes") / seen)).otherwise(F.lit(0)))


def parse_rates(counts: DataFrame) -> DataFrame:
    """Unparsed answers over all answers, and items without any parsed answer."""
    total = F.sum(F.col("yes") + F.col("no") + F.col("unparsed"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_items"), (F.sum("unparsed") / total).alias("unparsed_rate"),
        F.count_if(F.col("yes") + F.col("no") == 0).alias("inconclusive"))


def highlight_error_rates(counts: DataFrame) -> DataFrame:
    yes = F.sum("yes")
    return counts.agg(
        yes.alias("n_positive"), *[ratio(F.sum(c), yes).alias(f"{c}_rate") for c in
                                   ("hl_errors", "invented", "no_pair", "no_identifier")])


def compare_models(pairs: DataFrame) -> DataFrame:
    """How often two models (``pred_a``, ``pred_b``) are right or wrong together."""
    ok_a, ok_b = F.col("pred_a") == F.col("gold"), F.col("pred_b") == F.col("gold")
    return pairs.groupBy(ok_a.alias("a_right"), ok_b.alias("b_right")).agg(F.count(F.lit(1)).alias("n"))


def both_sides(guest: str, host: str):
    """Rule label: both token-label arrays hold a 1."""
    return (F.array_contains(guest, 1) & F.array_contains(host, 1)).cast("int")


def one_side_only(guest: str, host: str):
    return F.array_contains(guest, 1) != F.array_contains(host, 1)


def threshold_labels(weights, threshold: float = 0.5):
    weights = F.col(weights) if isinstance(weights, str) else weights
    return F.transform(weights, lambda w: (w >= threshold).cast("int"))


def selection_quality(selected: DataFrame, gold: DataFrame, key: str = "item") -> DataFrame:
    """Precision and recall of a selected id set against a gold id set."""
    from turnwise.operators.sets import set_sizes
    s = set_sizes(selected, gold, key)
    return s.select(ratio("n_both", "n_a").alias("precision"), ratio("n_both", "n_b").alias("recall"),
                    F.col("n_both").alias("hits"))


def linear_fit(rows: DataFrame, x: str, y: str, seed: int = 1, key: str = "id") -> DataFrame:
    """Least squares on 60% of the rows, error and R2 on the next 20% and on the last 20%.

    The split is by the md5 of the key, so it needs no sort.
    """
    from turnwise.operators.sampling import draw
    u = F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))
    parts = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.when(
        u < 0.6, "train").when(u < 0.8, "validation").otherwise("test").alias("part"))
    fit = parts.where("part = 'train'").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")).withColumn("k", F.lit(1))
    scored = parts.withColumn("k", F.lit(1)).join(F.broadcast(fit), "k")
    err = F.col("y") - (F.col("slope") * F.col("x") + F.col("intercept"))
    return scored.groupBy("part").agg(
        F.any_value("slope").alias("slope"), F.any_value("intercept").alias("intercept"),
        F.count(F.lit(1)).alias("n"), F.avg(err * err).alias("mse"),
        (1 - F.sum(err * err) / (F.var_pop("y") * F.count("y"))).alias("r2"))

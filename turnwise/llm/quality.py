"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark column expressions over the whole text.  Small trees are boosted on a bounded
sample of labelled rows; every path from a root to a node is a rule, a conjunction of thresholds.  A
lasso logistic regression over the rules keeps few of them, and these are compiled into one Spark
column expression, so scoring is a projection without Python, joins or shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.base import full, query, table

SAMPLE = 12_000  # labelled rows that a model is fitted on, at most about
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
LASSO = 0.003
STATISTICS = [
    "chars", "words", "word_length", "upper", "digits", "stops", "marks", "symbols", "lines", "distinct", "repeats",
    "short"]


def statistics(text: Column) -> Column:
    """A struct of numbers that describe a text; shares are of its characters or words."""
    def share(pattern: str, of: Column) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / F.greatest(of, F.lit(1))

    chars = F.length(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    count = F.size(words)
    return F.struct(
        chars.cast("double").alias("chars"), count.cast("double").alias("words"),
        ((chars - F.regexp_count(text, F.lit(r"\s"))) / F.greatest(count, F.lit(1))).alias("word_length"),
        share(r"\p{Lu}", chars).alias("upper"), share(r"\p{N}", chars).alias("digits"),
        share("[.,;:]", chars).alias("stops"), share("[!?]", chars).alias("marks"),
        share(r"[^\p{L}\p{N}\s.,;:!?'()\"-]", chars).alias("symbols"), share(r"\n", count).alias("lines"),
        (F.size(F.array_distinct(words)) / F.greatest(count, F.lit(1))).alias("distinct"),
        # Each word that is followed by itself; possessive, so long words are not tried again from within.
        share(r"(?<!\S)(\S++)(?=\s\1(?!\S))", count).alias("repeats"),
        share(r"(?<!\S)\S{1,3}(?!\S)", count).alias("short"))


# -- fitting on a bounded sample ------------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold) of each condition


def cut_points(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds of each statistic: quantiles of the sample, halfway to the next value."""
    out = []
    for column in x.T:
        values = np.unique(column)
        at = np.unique(np.searchsorted(values, np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])))
        at = at[at < len(values) - 1]
        out.append((values[at] + values[at + 1]) / 2)
    return out


def tree_rules(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on the gradient: its paths, and its prediction for each row."""
    rules, value = [], np.zeros(len(gradient))

    def grow(rows: np.ndarray, path: Rule) -> None:
        total, mass = gradient[rows].sum(), weight[rows].sum() + 1.0
        best = (total ** 2 / mass + 1e-6, None, None)
        if len(path) < DEPTH and len(rows) >= 20:
            for j, points in enumerate(cuts):
                if not len(points):
                    continue
                g = np.cumsum(np.bincount(binned[rows, j], gradient[rows], len(points) + 1))[:-1]
                h = np.cumsum(np.bincount(binned[rows, j], weight[rows], len(points) + 1))[:-1]
                gain = g ** 2 / (h + 1.0) + (total - g) ** 2 / (mass - h)
                if gain.max() > best[0] + 1e-6:
                    best = (gain.max(), j, int(gain.argmax()))
        if best[1] is None:
            value[rows] = total / mass
            return
        _, j, at = best
        above = binned[rows, j] > at
        for side in (False, True):
            step = (*path, (j, side, float(cuts[j][at])))
            rules.append(step)
            grow(rows[above == side], step)

    grow(np.arange(len(gradient)), ())
    return rules, value


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, j] > t) == above for j, above, t in rule])


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct paths of boosted trees."""
    cuts = cut_points(x)
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], axis=1)
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        found, value = tree_rules(binned, cuts, y - p, p * (1 - p))
        rules |= {tuple(sorted(r)): None for r in found}
        margin += RATE * value
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal gradients."""
    z = np.column_stack([np.ones(len(z)), z]).astype(np.float32)
    rate = 4 * len(z) / max(np.linalg.norm(z.T @ z, 2), 1e-9)
    w = v = np.zeros(z.shape[1])
    momentum = 1.0
    for _ in range(steps):
        gradient = z.T @ (1 / (1 + np.exp(-(z @ v.astype(np.float32)))) - y) / len(y)
        new = v - rate * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        v, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return float(w[0]), w[1:]


@dataclass
class RuleModel:
    """Weighted rules; the score is the logistic function of the intercept and the weights of the rules that hold."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, stats: str) -> Column:
        """The score over a column that holds ``statistics``, as an expression."""
        def condition(rule: Rule) -> Column:
            parts = [
                F.col(f"{stats}.{STATISTICS[j]}") > t if above else F.col(f"{stats}.{STATISTICS[j]}") <= t
                for j, above, t in rule]
            return reduce(lambda a, b: a & b, parts)

        terms = [F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0)) for rule, weight in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = LASSO) -> RuleModel:
    """The ensemble for statistics ``x`` and labels ``y``; a constant if there are not two classes."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(p / (1 - p))), [])
    rules = grow_rules(x, y)
    intercept, weights = lasso_logistic(np.stack([holds(r, x) for r in rules], axis=1), y, penalty)
    return RuleModel(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6])


# -- on tables ------------------------------------------------------------------------------------


def held_out(id: Column) -> Column:
    """Every fifth id by the CRC-32 of its text; a null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality",
    sample: int = SAMPLE,
) -> RuleModel:
    """A model of ``label`` (0 or 1) on about ``sample`` labelled documents at most, none of them held out.

    The sample is drawn by a hash of the id.  Null ids, null labels and labels without a document are
    left out; a document with two labels counts twice.  Without labels of both kinds the model is the
    share of the labels there are, 0.5 without any.
    """
    usable = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).where(
        "id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id")))
    share = min(1.0, sample / max(1, usable.count()))
    drawn = usable.where(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1_000_000)) < int(share * 1_000_000))
    # Bounded by the sample.
    rows = docs.select(F.col(id).alias("id"), full(text).alias("text")).join(F.broadcast(drawn), "id").select(
        "label", statistics(F.col("text")).alias("stats")).collect()
    rows.sort(key=lambda r: (r["label"], tuple(r["stats"])))  # the order of rows must not matter
    x = np.array([tuple(r["stats"]) for r in rows], float).reshape(-1, len(STATISTICS))
    return fit_rules(x, np.array([r["label"] for r in rows], float))


def score_quality(
    docs: DataFrame, model: RuleModel, *, text: str = "text", threshold: float = THRESHOLD, score: str = "score",
    predicted: str = "predicted",
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is ``threshold`` or more, else 0).

    A null text is scored as an empty one; repeated rows and rows with null ids are scored one by one.
    Columns of ``docs`` that are named like the new ones are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in (score.lower(), predicted.lower())]
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), statistics(full(text)).alias("stats")).select(
        "row", model.score("stats").alias("score"))
    return scored.select("row.*", F.col("score").alias(score), (F.col("score") >= threshold).cast("int").alias(predicted))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

"""Keyword labels in free-text comments: flags in one scan, classes and counts over the flags.

Labelled tables have ``qid, choice`` ('Yes'/'No') ``, comment``, one row per id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keyword vocabulary of the comments.
KEYWORDS = {
    "repetition": "REPETITION",
    "reference": "REFERENCE",
    "it_reference": "IT-REFERENCE",
    "inspired": "INSPIRED-REFERENCE",
    "context": "CONTEXT",
    "conclusion": "CONCLUSION",
    "universal": "UNIVERSAL",
    "paraphrase": "CLEAR-PARAPHRASE",
    "non_paraphrase": "CLEAR-NON-PARAPHRASE",
    "ambiguous": "AMBIGUOUS",
    "difficult": "DIFFICULT",
    "coreference": "COREFERENCE",
    "pragmatic": "PRAGMATIC",
    "shift": "PERSPECTIVE-SHIFT",
    "alike": "HIGH-LEXICAL-SIMILARITY",
    "meta": "META-COMMENT",
    "surrogate": "SURROGATE-PARAPHRASE",
    "negated": "NEGATED-PARAPHRASE",
    "background": "BACKGROUND-KNOWLEDGE",
    "directional": "DIRECTIONAL",
    "partial": "PARTIAL",
    "side": "SIDE-PARAPHRASE",
    "unrelated": "UNRELATED",
    "related": "ONLY-RELATED",
    "error": "ERROR",
    "near_repetition": "REPETITION-SOME",
}

POSITIVE_FLAGS = ["repetition", "alike", "universal", "clear", "pragmatic", "shift", "directional"]
NEGATIVE_FLAGS = ["alike_non", "partial", "conclusion", "context", "unrelated", "related"]


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


class Vocabulary:
    """Predicates over choice and comment for one keyword vocabulary.

    A missing comment holds no keyword: it fails "with" and passes "without".
    """

    def __init__(self, words: dict[str, str] | None = None, choice: str = "choice", comment: str = "comment"):
        self.words = {**KEYWORDS, **(words or {})}
        self.choice = choice
        self.comment = comment

    @property
    def yes(self) -> Column:
        return F.coalesce(F.col(self.choice) == "Yes", F.lit(False))

    @property
    def no(self) -> Column:
        return F.coalesce(F.col(self.choice) == "No", F.lit(False))

    def has(self, role: str) -> Column:
        return F.coalesce(F.contains(F.col(self.comment), F.lit(self.words[role])), F.lit(False))

    def picked(self, *with_: str, without: tuple[str, ...] = (), choice: str = "yes") -> Column:
        """The choice test and ALL of ``with_`` and NONE of ``without``."""
        chosen = {"yes": self.yes, "no": self.no, "any": self.yes | self.no}[choice]
        return chosen & _all([self.has(w) for w in with_]) & ~_any([self.has(w) for w in without])

    def plain(self, role: str) -> Column:
        """First-pass relic: the keyword without any explicit verdict."""
        return self.picked(role, without=("paraphrase", "non_paraphrase", "ambiguous"))


def keyword_ids(labels: DataFrame, vocab: Vocabulary, with_: tuple[str, ...] = (), without: tuple[str, ...] = (),
                choice: str = "yes") -> DataFrame:
    return labels.where(vocab.picked(*with_, without=without, choice=choice)).select("qid")


def flag_columns(vocab: Vocabulary) -> dict[str, Column]:
    """Boolean membership of every id set of the review statistics."""
    v = vocab
    f: dict[str, Column] = {}
    f["context"] = v.picked("context", choice="any")
    f["ambiguous"] = v.picked("ambiguous")
    relic = v.plain("repetition")
    f["positive"] = (v.picked("paraphrase") | relic) & ~f["context"]
    f["clear"] = (v.picked("paraphrase", without=("difficult",)) | relic) & f["positive"]
    f["repetition"] = (v.picked("repetition", "paraphrase", without=("near_repetition",)) | relic) & f["positive"]
    f["alike"] = (v.picked("alike", "paraphrase") | relic) & f["positive"]
    for role in ("universal", "directional", "shift", "side"):
        f[role] = v.picked(role, "paraphrase") & f["positive"]
    f["pragmatic"] = v.picked("pragmatic", "paraphrase", without=("shift",)) & f["positive"]
    silent = v.picked(without=("repetition", "paraphrase", "non_paraphrase", "ambiguous"))
    f["negative"] = (v.picked("non_paraphrase") | silent | v.no) & ~f["context"] & ~f["ambiguous"]
    f["alike_non"] = v.picked("alike", "non_paraphrase", choice="any") & f["negative"]
    for role in ("partial", "unrelated"):
        f[role] = v.picked(role, "non_paraphrase", choice="any") & f["negative"]
    f["conclusion"] = (v.picked("conclusion", "non_paraphrase", choice="any") | v.plain("conclusion")) & f["negative"]
    f["related"] = (v.picked("related", "non_paraphrase", choice="any") | v.plain("inspired")) & f["negative"]
    for role in ("difficult", "meta", "negated", "surrogate"):
        f[role] = v.picked(role)
    f["misrepresented"] = v.picked("error")
    return f


def with_flags(labels: DataFrame, vocab: Vocabulary) -> DataFrame:
    return labels.withColumns(flag_columns(vocab))


def review_counts(flags: DataFrame) -> DataFrame:
    """All review counts as ``measure, n`` rows, from one scan of the flags."""
    c = {name: F.col(name) for name in flags.columns}
    outside = ~c["context"]
    counts = {
        "reviewed": F.lit(True),
        "context": c["context"],
        "ambiguous_not_context": c["ambiguous"] & outside,
        "context_and_ambiguous": c["ambiguous"] & c["context"],
        "positive": c["positive"], "clear": c["clear"], "repetition": c["repetition"],
        "positive_not_repetition": c["positive"] & ~c["repetition"],
        "clear_not_repetition": c["clear"] & ~c["repetition"],
        "universal": c["universal"], "universal_not_repetition": c["universal"] & ~c["repetition"],
        "universal_not_context": c["universal"] & outside,
        "alike": c["alike"], "clear_not_alike": c["clear"] & ~c["alike"],
        "positive_not_alike": c["positive"] & ~c["alike"],
        "repetition_not_alike": c["repetition"] & ~c["alike"],
        "alike_not_repetition": c["alike"] & ~c["repetition"],
        "directional": c["directional"], "directional_not_alike": c["directional"] & ~c["alike"],
        "directional_not_repetition": c["directional"] & ~c["repetition"],
        "shift": c["shift"], "shift_not_alike": c["shift"] & ~c["alike"],
        "shift_not_repetition": c["shift"] & ~c["repetition"],
        "pragmatic": c["pragmatic"], "pragmatic_not_alike": c["pragmatic"] & ~c["alike"],
        "pragmatic_not_repetition": c["pragmatic"] & ~c["repetition"],
        "side": c["side"], "negative": c["negative"], "alike_non": c["alike_non"],
        "related": c["related"], "partial": c["partial"], "conclusion": c["conclusion"],
        "unrelated": c["unrelated"],
        "difficult_negative": c["difficult"] & c["negative"], "difficult_positive": c["difficult"] & c["positive"],
        "meta": c["meta"] & outside, "negated": c["negated"] & outside,
        "surrogate": c["surrogate"] & outside, "misrepresented": c["misrepresented"] & outside,
    }
    wide = flags.agg(*[F.count_if(test).alias(name) for name, test in counts.items()])
    return wide.unpivot([], list(counts), "measure", "n")


def combination(flag_names: list[str]) -> Column:
    """Flag vector as text, ``"0100000"``."""
    return F.concat(*[F.col(name).cast("int").cast("string") for name in flag_names])


def positive_combinations(flags: DataFrame) -> DataFrame:
    rows = flags.where(F.col("positive") & ~F.col("context"))
    return rows.groupBy(combination(POSITIVE_FLAGS).alias("combo")).agg(F.count(F.lit(1)).alias("n"))


def negative_combinations(flags: DataFrame) -> DataFrame:
    rows = flags.where(F.col("negative") | (F.col("context") & ~F.col("ambiguous") & ~F.col("positive")))
    return rows.groupBy(combination(NEGATIVE_FLAGS).alias("combo")).agg(F.count(F.lit(1)).alias("n"))


def class_columns(vocab: Vocabulary, first_batch: bool = False) -> dict[str, Column]:
    """Disjoint hierarchy error > context > ambiguous > positive / negative, and finer marks.

    In the first batch ERROR marked something else, so nothing is an error there; its positives are
    checked against the second-batch context and ambiguity.
    """
    v = vocab
    error2 = v.picked("error", choice="any")
    context2 = v.picked("context", choice="any") & ~error2
    ambiguous2 = v.picked("ambiguous", choice="any") & ~context2 & ~error2
    error = F.lit(False) if first_batch else error2
    context = v.picked("context", choice="any") & ~error
    ambiguous = v.picked("ambiguous", choice="any") & ~context & ~error
    if first_batch:
        positive = v.picked("paraphrase") | v.picked("repetition", without=("paraphrase", "non_paraphrase"))
        positive = positive & ~context2 & ~ambiguous2
        silent = v.picked(without=("repetition", "paraphrase", "non_paraphrase", "ambiguous"))
        negative = v.no | v.picked("non_paraphrase") | silent
        repetition = v.picked("repetition", without=("near_repetition",)) & positive
    else:
        positive = v.picked(without=("non_paraphrase",)) & ~error2 & ~context2 & ~ambiguous2
        negative = v.no | v.picked("non_paraphrase")
        repetition = v.picked("repetition") & positive
    negative = negative & ~error & ~context & ~ambiguous
    related = v.yes & (negative | (v.has("related") & ~error & ~context))
    return {
        "error": error, "context": context, "ambiguous": ambiguous, "positive": positive, "negative": negative,
        "repetition": repetition,
        "alike": positive & v.has("alike") & ~v.has("repetition"),
        "related": related,
        "difficult": (v.yes | v.no) & v.has("difficult") & ~error & ~context & ~ambiguous & ~related & negative,
    }


def with_classes(labels: DataFrame, vocab: Vocabulary, first_batch: bool = False) -> DataFrame:
    return labels.withColumns(class_columns(vocab, first_batch))


def class_counts(classes: DataFrame) -> DataFrame:
    names = ["error", "context", "ambiguous", "positive", "negative", "repetition", "alike", "related", "difficult"]
    return classes.agg(*[F.count_if(n).alias(n) for n in names]).unpivot([], names, "class", "n")


def class_summary(classes: DataFrame, include_ambiguous: bool = False) -> DataFrame:
    """Negatives, positives without repetitions, repetitions."""
    negative = F.col("negative")
    if include_ambiguous:
        negative = negative | F.col("ambiguous") | F.col("context")
    return classes.agg(
        F.count_if(negative).alias("negatives"),
        (F.count_if("positive") - F.count_if("repetition")).alias("other_positives"),
        F.count_if("repetition").alias("repetitions"))


def class_overlaps(classes: DataFrame) -> DataFrame:
    """Rows that break the disjointness of the classes; all zero in sound data."""
    c = {n: F.col(n) for n in ("positive", "negative", "context", "ambiguous", "repetition")}
    return classes.agg(
        F.count_if(c["repetition"] & ~c["positive"]).alias("repetition_outside"),
        F.count_if(c["positive"] & c["negative"]).alias("both_verdicts"),
        F.count_if((c["positive"] | c["negative"]) & c["context"]).alias("verdict_without_context"),
        F.count_if((c["positive"] | c["negative"]) & c["ambiguous"]).alias("verdict_on_ambiguous"))


def choice_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("choice").agg(F.count(F.lit(1)).alias("n"))


def percentages(counts: DataFrame, group: str | None = None, value: str = "n") -> DataFrame:
    """Counts as percent of their group's total (two aggregates, no window)."""
    if group:
        totals = counts.groupBy(group).agg(F.sum(value).alias("__t"))
        joined = counts.join(totals, group)
    else:
        totals = counts.agg(F.sum(value).alias("__t")).withColumn("__k", F.lit(1))
        joined = counts.withColumn("__k", F.lit(1)).join(F.broadcast(totals), "__k").drop("__k")
    return joined.withColumn("percent", 100.0 * F.col(value) / F.col("__t")).drop("__t")


def sample_label_counts(flags: DataFrame, sample: DataFrame) -> DataFrame:
    """Label counts inside a drawn sample (``qid``)."""
    rows = flags.join(sample, "qid", "left_semi")
    c = {n: F.col(n) for n in flags.columns}
    counts = {
        "positive": c["positive"], "unclear": c["positive"] & ~c["clear"], "clear": c["positive"] & c["clear"],
        "repetition": c["positive"] & c["repetition"], "universal": c["positive"] & c["universal"],
        "context_dependent": c["positive"] & ~c["universal"], "shift": c["positive"] & c["shift"],
        "alike": c["positive"] & c["alike"], "pragmatic": c["positive"] & c["pragmatic"],
        "directional": c["positive"] & c["directional"],
        "negative": c["negative"], "negative_context": c["context"] & ~c["positive"] & ~c["ambiguous"],
        "alike_non": c["alike_non"], "partial": c["partial"], "unrelated": c["unrelated"],
        "conclusion": c["conclusion"], "related": c["related"],
    }
    return rows.agg(*[F.count_if(t).alias(n) for n, t in counts.items()]).unpivot([], list(counts), "measure", "n")

"""Inter-annotator agreement from counts.

Vote tables have ``item, annotator, vote`` with one row per (item, annotator).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.measures import col, kappa, majority, ratio
from turnwise.operators.votes import vote_tuples
from turnwise.plans.ordered import row_numbers
from turnwise.plans.quantiles import beside, exact_quantiles
from turnwise.plans.tiles import LISTED, VOTES_PER_TASK, pair_tables
from turnwise.session import cut_lineage


def table_of(a, b) -> list:
    """The four cells of two 0/1 columns as aggregates."""
    a, b = col(a), col(b)
    return [F.count_if((a == x) & (b == y)).alias(f"n{x}{y}") for x, y in ((1, 1), (1, 0), (0, 1), (0, 0))]


CELLS = ("n11", "n10", "n01", "n00")


def two_list_scores(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Relative overlap and kappa of two label columns, optionally per group."""
    cells = pairs.groupBy(*(by or [])).agg(*table_of(a, b))
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    return cells.select(*(by or []), n.alias("n"),
                        ((F.col("n11") + F.col("n00")) / n).alias("overlap"), kappa(*CELLS).alias("kappa"))


def pairwise_kappa(votes: DataFrame, min_shared: float = 15, study: str | None = None,
                   sized_by: DataFrame | None = None, most: int | None = None, tally: bool = False,
                   prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Kappa and agreement of every annotator pair with at least ``min_shared`` common items.

    With ``tally`` one row without names stands for all ``c`` pairs of the same counts.  ``prepare`` makes the votes out
    of raw ones, item by item; it is better given here, as then the raw votes are sent once.
    """
    cells = pair_tables(votes, study, max(1, min_shared), sized_by=sized_by, most=most, tally=tally, prepare=prepare)
    shared = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    return cells.withColumns({
        "shared": shared, "kappa": kappa(*CELLS), "agreement": (F.col("n11") + F.col("n00")) / shared,
    })


def kappa_summary(pairs: DataFrame) -> DataFrame:
    """Pairs, mean, population deviation, exact median, negatives and those above 0.2.

    A row is a pair, or ``c`` pairs if it has such a column.
    """
    kappas = cut_lineage(pairs.groupBy("kappa").agg(F.sum(_times(pairs)).alias("c")))
    mean = kappas.agg(*kappa_measures(F.col("kappa")))
    return beside(mean, exact_quantiles(kappas, F.col("kappa"), {"median_kappa": 0.5}, F.col("c"))).select(
        "n_pairs", "mean_kappa", "std_kappa", "median_kappa", "n_negative", "n_above")


def _times(pairs: DataFrame) -> Column:
    return F.col("c") if "c" in pairs.columns else F.lit(1).cast("long")


def kappa_measures(value: Column) -> list[Column]:
    """Aggregates over kappas that occur ``c`` times each; NULLs don't count."""
    c = F.when(value.isNotNull(), F.col("c"))
    n = F.coalesce(F.sum(c), F.lit(0).cast("long"))
    mean = F.sum(value * c) / F.nullif(n, F.lit(0).cast("long"))
    # Kappas lie within [-1, 1], so the squares lose nothing that shows.
    square = F.sum(value * value * c) / F.nullif(n, F.lit(0).cast("long"))
    some = lambda test: F.coalesce(F.sum(F.when(test, c)), F.lit(0).cast("long"))
    return [n.alias("n_pairs"), mean.alias("mean_kappa"),
            F.when(n > 0, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).alias("std_kappa"),
            some(value < 0).alias("n_negative"), some(value > 0.2).alias("n_above")]


def study_numbers(items: DataFrame, size: int = 10, item: str = "item") -> DataFrame:
    """The items with their study: every ``size`` of them in their order form one."""
    return row_numbers(items, [], [item], "__r").withColumn("study", F.floor((F.col("__r") - 1) / size)).drop("__r")


def study_blocks(votes: DataFrame, size: int = 10, item: str = "item") -> DataFrame:
    """Numbers the studies: every ``size`` items in item order form one."""
    votes = cut_lineage(votes)  # read to list the items, to number them and to be joined
    return votes.join(study_numbers(votes.select(item).distinct(), size, item), item)


def study_kappa(rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], min_shared: float = 3, size: int = 10,
                tally: bool = False) -> DataFrame:
    """Kappa of annotator pairs within studies of ``size`` items; ``prepare`` makes the votes out of ``rows``, item by item."""
    counts = cut_lineage(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    studies = cut_lineage(study_numbers(counts, size))

    def blocks(raw: DataFrame) -> DataFrame:
        return prepare(raw).join(studies.select("item", "study"), "item")

    return pairwise_kappa(rows, min_shared, "study", studies.where("item IS NOT NULL"), tally=tally, prepare=blocks)


def pair_agreement(votes: DataFrame, sized_by: DataFrame | None = None,
                   prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Mean over annotator pairs with a common item of their share of equal votes."""
    pairs = pairwise_kappa(votes, 1, sized_by=sized_by, tally=True, prepare=prepare)
    return pairs.agg((F.sum(F.col("agreement") * F.col("c")) / F.sum("c")).alias("pair_agreement"))


def fleiss_kappa(votes: DataFrame, raters: int) -> DataFrame:
    """Fleiss' kappa over the items that have exactly ``raters`` votes."""
    per = vote_tuples(votes).where(F.col("n") == raters).select(
        F.col("yes").alias("y"), (F.col("n") - F.col("yes")).alias("x"), "n")
    sums = per.agg(
        F.count(F.lit(1)).alias("items"), F.sum("y").alias("ones"), F.sum("n").alias("total"),
        F.avg((F.col("y") ** 2 + F.col("x") ** 2 - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("po"))
    share = F.col("ones") / F.col("total")
    pe = share * share + (1 - share) * (1 - share)
    return sums.select("items", F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).alias("fleiss"))


def alpha_from_units(units: DataFrame, n0: str = "n0", n1: str = "n1", weight: str | None = None) -> DataFrame:
    """Nominal Krippendorff alpha of 0/1 values counted per unit; NULL when one value only occurs.

    ``weight`` is the number of units that share the counts.
    """
    w = col(weight) if weight else F.lit(1)
    a, b = col(n0), col(n1)
    sums = units.where(a + b >= 2).agg(
        F.sum(w * 2 * a * b / (a + b - 1)).alias("seen"), F.sum(w * a).alias("zeros"), F.sum(w * b).alias("ones"))
    total = F.col("zeros") + F.col("ones")
    chance = 2 * F.col("zeros") * F.col("ones") / (total - 1)
    return sums.select(F.when(chance > 0, 1 - F.col("seen") / chance).alias("alpha"))


def krippendorff_alpha(votes: DataFrame) -> DataFrame:
    units = vote_tuples(votes).select((F.col("n") - F.col("yes")).alias("n0"), F.col("yes").alias("n1"))
    return alpha_from_units(units)


def nominal_alpha(values: DataFrame, unit: str, value: str) -> DataFrame:
    """Krippendorff alpha for any number of categories."""
    counts = values.where(F.col(value).isNotNull()).groupBy(unit, value).agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy(unit).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).where("n >= 2")
    seen = per.agg(F.sum((F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") - 1)).alias("seen"),
                   F.sum("n").alias("total"))
    marg = counts.join(per.select(unit), unit, "left_semi").groupBy(value).agg(F.sum("c").alias("c")) \
        .agg(F.sum(F.col("c") * F.col("c")).alias("msq"))
    # Two one-row tables.
    both = seen.withColumn("k", F.lit(1)).join(marg.withColumn("k", F.lit(1)), "k")
    chance = (F.col("total") * F.col("total") - F.col("msq")) / (F.col("total") - 1)
    return both.select(F.when(chance > 0, 1 - F.col("seen") / chance).alias("alpha"))


def item_agreement(votes: DataFrame) -> DataFrame:
    """Mean and population deviation of the larger vote share of each item."""
    top = F.greatest("share", 1 - F.col("share"))
    return vote_tuples(votes).agg(F.avg(top).alias("mean_agreement"), F.stddev_pop(top).alias("std_agreement"))


def against_others(votes: DataFrame, include_self: bool = False) -> DataFrame:
    """Each vote with the share of the other (or all) votes on the item, NULL when there is none."""
    totals = votes.groupBy("item").agg(F.sum("vote").alias("yes"), F.count("vote").alias("n"))
    return _against(votes.where(F.col("vote").isNotNull()).join(totals, "item"), include_self)


def _against(votes: DataFrame, include_self: bool = False) -> DataFrame:
    """The same for votes beside the ``yes`` and ``n`` of their items."""
    own = F.lit(0) if include_self else F.col("vote")
    left = F.lit(0) if include_self else F.lit(1)
    return votes.withColumn("others", F.when(F.col("n") - left > 0, (F.col("yes") - own) / (F.col("n") - left)))


def majority_accuracy(votes: DataFrame, include_self: bool = False) -> DataFrame:
    """Share of votes per annotator that equal the majority of the others, ties counting as yes."""
    rows = against_others(votes, include_self).where(F.col("others").isNotNull())
    return rows.groupBy("annotator").agg(
        F.avg((majority("others") == F.col("vote")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def majority_kappa(votes: DataFrame, include_self: bool = False) -> DataFrame:
    """Kappa per annotator against the rounded mean of the others; 0.5 rounds to the even 0."""
    rows = against_others(votes, include_self).where(F.col("others").isNotNull()).withColumn(
        "mv", F.bround("others", 0).cast("int"))
    return two_list_scores(rows, "vote", "mv", ["annotator"])


def spread(scores: DataFrame, value: str) -> DataFrame:
    return scores.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def agreement_report(votes: DataFrame, cut: str, min_shared: float = 1,
                     sized_by: DataFrame | None = None, most: int | None = None,
                     prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All measures of one data cut as ``cut, measure, value`` rows.

    Three passes over the stored votes: annotator pairs, item tallies, and votes against the other votes.  ``prepare``
    makes the votes out of raw ones, item by item; then these are sent once, and small items are stored as lists.
    """
    tallies = others = None
    if prepare is not None:
        rows, top = votes.groupBy("item").count().agg(F.sum("count"), F.max("count")).first()
        if (top or 0) <= LISTED:
            votes = votes.repartition(max(1, -(-(rows or 0) // VOTES_PER_TASK)), "item")
            cast = F.collect_list(F.struct("annotator", "vote")).alias("cast")
            lists = cut_lineage(prepare(votes).groupBy("item").agg(
                F.sum("vote").alias("yes"), F.count("vote").alias("n"), F.avg("vote").alias("share"), cast))
            tallies, votes = lists.drop("cast"), lists.select("item", F.inline("cast"))
            others = _against(lists.where("item IS NOT NULL").select("item", "yes", "n", F.inline("cast")).where("vote IS NOT NULL"))
        else:
            votes = prepare(votes)
    if tallies is None:
        votes = cut_lineage(votes.select("item", "annotator", "vote"))
        tallies, others = vote_tuples(votes), against_others(votes)
    sizes = votes if sized_by is None else sized_by
    pairs = pairwise_kappa(votes, 1, sized_by=sizes, most=most, tally=True)
    pairs = cut_lineage(pairs.groupBy("kappa", "shared", "agreement").agg(F.sum("c").alias("c")))
    kept = F.when(F.col("shared") >= min_shared, F.col("kappa"))
    top = F.greatest("share", 1 - F.col("share"))
    one, zero = F.col("yes"), F.col("n") - F.col("yes")
    shared = F.col("n") >= 2
    others = others.where("others IS NOT NULL").withColumn("all", F.col("yes") / F.col("n"))
    labelled = others.withColumns({
        "right": (majority("others") == F.col("vote")).cast("int"), "a": F.bround("others", 0).cast("int"),
        "b": F.bround("all", 0).cast("int")})
    ab = [c.alias(f"{m}_{name}") for m in ("a", "b") for c, name in zip(table_of("vote", m), CELLS)]
    people = labelled.groupBy("annotator").agg(F.avg("right").alias("right"), *ab)
    parts = [
        pairs.agg(*kappa_measures(kept), (F.sum(F.col("agreement") * F.col("c")) / F.sum("c")).alias("pair_agreement")),
        exact_quantiles(pairs, kept, {"median_kappa": 0.5}, F.col("c")),
        tallies.agg(
            F.avg(top).alias("item_agreement"), F.stddev_pop(top).alias("item_agreement_std"),
            F.sum(F.when(shared, 2 * zero * one / (F.col("n") - 1))).alias("seen"),
            F.sum(F.when(shared, zero)).alias("zeros"), F.sum(F.when(shared, one)).alias("ones")),
        people.agg(
            F.avg("right").alias("majority_accuracy"),
            F.avg(kappa(*[f"a_{c}" for c in CELLS])).alias("majority_kappa"),
            F.avg(kappa(*[f"b_{c}" for c in CELLS])).alias("majority_kappa_incl")),
    ]
    row = parts[0].withColumn("k", F.lit(1))
    for part in parts[1:]:
        row = row.join(part.withColumn("k", F.lit(1)), "k")
    total = F.col("zeros") + F.col("ones")
    chance = 2 * F.col("zeros") * F.col("ones") / (total - 1)
    row = row.withColumn("alpha", F.when(chance > 0, 1 - F.col("seen") / chance))
    names = ["n_pairs", "mean_kappa", "std_kappa", "median_kappa", "n_negative", "n_above", "alpha", "pair_agreement",
             "item_agreement", "item_agreement_std", "majority_accuracy", "majority_kappa", "majority_kappa_incl"]
    return row.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "measure", "value").select(
        F.lit(cut).alias("cut"), "measure", "value")


def gold_scores(votes: DataFrame, gold: DataFrame, strata: str | None = None) -> DataFrame:
    """F1 of the positive class and kappa against gold per annotator (and stratum)."""
    by = ["annotator"] + ([strata] if strata else [])
    cells = votes.join(gold, "item").groupBy(*by).agg(*table_of("gold", "vote"))
    f1 = ratio(2 * F.col("n11"), 2 * F.col("n11") + F.col("n01") + F.col("n10"))
    return cells.select(*by, f1.alias("f1"), kappa(*CELLS).alias("kappa"))


def seated_pairs(votes: DataFrame) -> DataFrame:
    """Annotators of a study paired by their position: first with second, third with fourth.

    ``votes`` has ``study, item, annotator, vote``.  One row per (study, seat pair, item).
    """
    people = row_numbers(votes.select("study", "annotator").distinct(), ["study"], ["annotator"], "seat")
    seated = votes.join(people, ["study", "annotator"]).withColumns({
        "duo": F.floor((F.col("seat") - 1) / 2), "side": (F.col("seat") - 1) % 2})
    # At most two votes per (study, duo, item).
    both = seated.groupBy("study", "duo", "item").agg(
        F.max(F.when(F.col("side") == 0, F.col("vote"))).alias("v1"),
        F.max(F.when(F.col("side") == 1, F.col("vote"))).alias("v2"))
    return both.where("v1 IS NOT NULL AND v2 IS NOT NULL")


def duo_scores(both: DataFrame) -> DataFrame:
    """Candidate share, kappas, overlap and the larger conditional no-share of every duo."""
    any_yes = F.greatest("v1", "v2")
    cells = both.groupBy("study", "duo").agg(
        *table_of("v1", "v2"),
        F.avg(any_yes).alias("candidate_share"), F.avg("v1").alias("share_1"), F.avg("v2").alias("share_2"),
        F.avg(F.when(F.col("v2") == 0, 1 - F.col("v1"))).alias("no1_given_no2"),
        F.avg(F.when(F.col("v1") == 0, 1 - F.col("v2"))).alias("no2_given_no1"))
    zero = F.lit(0).cast("long")
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    # Against "any yes": where the rater said yes the other label is yes as well.
    k1 = kappa(F.col("n11") + F.col("n10"), zero, F.col("n01"), F.col("n00"))
    k2 = kappa(F.col("n11") + F.col("n01"), zero, F.col("n10"), F.col("n00"))
    return cells.select(
        "study", "duo", n.alias("n_items"), "candidate_share", "share_1", "share_2", kappa(*CELLS).alias("kappa"),
        k1.alias("kappa_any_1"), k2.alias("kappa_any_2"), F.greatest(k1, k2).alias("kappa_any_max"),
        ((F.col("n11") + F.col("n00")) / n).alias("overlap"),
        F.greatest(F.coalesce("no1_given_no2", F.lit(0.0)), F.coalesce("no2_given_no1", F.lit(0.0))).alias("consumed"))


def lead_vs_crowd(votes: DataFrame, lead: DataFrame) -> DataFrame:
    """Lead labels (missing = 0) against crowd majorities."""
    crowd = vote_tuples(votes).select("item", majority("share").alias("mv"))
    rows = crowd.join(lead, "item", "left").withColumn("lead", F.coalesce("lead", F.lit(0)))
    return two_list_scores(rows, "lead", "mv")

"""Votes, shares, majority labels and orders within an item.

Vote tables have ``item, annotator, vote`` (0/1, NULL = abstained) and order columns that are total
within an item.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.measures import majority
from turnwise.plans.ordered import Ordered, row_numbers, rows_per_task
from turnwise.session import cut_lineage

# Executors get task functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = ["start", "session", "line"]


def binary_votes(marks: DataFrame, hl: str = "hl") -> DataFrame:
    """An empty highlight list is a no, any other a yes."""
    return marks.withColumn("vote", F.when(F.size(hl) == 0, 0).when(F.col(hl).isNotNull(), 1))


def choice_votes(choices: DataFrame, choice: str = "highlighted") -> DataFrame:
    return choices.withColumn("vote", F.when(F.col(choice) == "No", 0).when(F.col(choice).isNotNull(), 1))


def keep_last_vote(votes: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """Last vote of each (item, annotator); reduced before the shuffle, no window."""
    rest = [c for c in votes.columns if c not in ("item", "annotator")]
    # The largest row that begins with the order columns; it is sent once and not beside its place.
    whole = [*order, *[c for c in rest if c not in order]]
    last = votes.groupBy("item", "annotator").agg(F.max(F.struct(*whole)).alias("v"))
    return last.select("item", "annotator", *[F.col("v")[c].alias(c) for c in rest])


def drop_doubled_sessions(votes: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """When an annotator did an item in several sessions, every row of the earlier sessions goes."""
    sessions = votes.groupBy("item", "annotator", "session").agg(F.max(F.struct(*order)).alias("at"))
    last = sessions.groupBy("item", "annotator").agg(F.max_by("session", "at").alias("last"))
    stale = sessions.join(last, ["item", "annotator"]).where(F.col("session") != F.col("last")) \
        .select("session").distinct()
    return votes.join(stale, "session", "left_anti").select(*votes.columns)


def drop_unlisted_sessions(votes: DataFrame, listed: DataFrame) -> DataFrame:
    """Drop every row of a session in which an annotator not listed for an item touched that item."""
    invalid = votes.join(listed, ["item", "annotator"], "left_anti").select("session").distinct()
    return votes.join(invalid, "session", "left_anti").select(*votes.columns)


def vote_tuples(votes: DataFrame) -> DataFrame:
    """Yes votes, all votes and share per item."""
    return votes.groupBy("item").agg(
        F.sum("vote").alias("yes"), F.count("vote").alias("n"), F.avg("vote").alias("share"))


def majority_labels(votes: DataFrame) -> DataFrame:
    return vote_tuples(votes).withColumn("label", majority("share"))


def annotation_tuples(votes: DataFrame) -> DataFrame:
    """Distinct (item, annotator) with the first start, in time order."""
    return votes.groupBy("item", "annotator").agg(F.min("start").alias("start")).orderBy("start", "item", "annotator")


def total_annotations(votes: DataFrame) -> DataFrame:
    return vote_tuples(votes).agg(F.sum("n").alias("n_annotations"))


def unique_counts(votes: DataFrame) -> DataFrame:
    """Exact distinct items, annotators and sessions, one distinct set at a time."""
    names = ["item", "annotator", "session"]
    kinds = F.array(*[
        F.struct(F.lit(n).alias("what"), *[(F.col(n) if m == n else F.lit(None)).alias(m) for m in names]) for n in names])
    # One pass over the votes; the values of a column are distinct before they are counted.
    values = votes.select(F.explode(kinds).alias("v")).select("v.*").distinct()
    return values.groupBy("what").agg(
        F.count(F.coalesce(*[F.col(n).cast("string") for n in names])).alias("n"))


def ordered_votes(votes: DataFrame, order: list[str] = ORDER, probe: DataFrame | None = None) -> DataFrame:
    """Votes with their rank inside the item; ordered lists stay rows."""
    return row_numbers(votes, ["item"], order, "rank", probe)


def first_votes(votes: DataFrame, k: int, order: list[str] = ORDER) -> DataFrame:
    """First k votes of each item; the limit is applied before the shuffle as well."""
    win = Window.partitionBy("item").orderBy(*order)
    return votes.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)


def running_votes(votes: DataFrame, order: list[str] = ORDER, set_max: int = 0,
                  probe: DataFrame | None = None) -> DataFrame:
    """Cumulative yes and no, and the share after each vote.

    ``probe`` has at least the same votes and is cheaper to count (such as the raw submissions).
    """
    cast = votes.where(F.col("vote").isNotNull())
    if set_max:
        # No item has more than set_max votes left, so there is nothing to measure.
        cast = first_votes(cast, set_max, order).drop("rank")
    run = Ordered(cast, ["item"], order, probe=probe, sizes=(set_max, set_max) if set_max else None).running(cum_yes=F.col("vote").cast("long"), rank=F.lit(1).cast("long"))
    return run.result().withColumns({
        "cum_no": F.col("rank") - F.col("cum_yes"), "share": F.col("cum_yes") / F.col("rank")})


def shuffled_order(votes: DataFrame, seed: int) -> DataFrame:
    """Adds ``shuffle``, a seeded random order column that breaks ties by annotator."""
    return votes.withColumn("shuffle", F.md5(F.concat_ws("|", F.lit(str(seed)), "item", "annotator")))


def convergence(votes: DataFrame, order: list[str] = ORDER, probe: DataFrame | None = None) -> DataFrame:
    """Mean distance to the final share and accuracy of the label after n votes."""
    run = running_votes(votes, order, probe=probe)
    final = vote_tuples(votes).select("item", F.col("share").alias("final"))
    return run.join(final, "item").groupBy("rank").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg(F.abs(F.col("share") - F.col("final"))).alias("mean_distance"),
        F.avg((majority("share") == majority("final")).cast("int")).alias("accuracy"))


def arrival_progress(arrivals: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Running mean of ``value`` and number of accepted arrivals (``accepted`` 0/1)."""
    run = Ordered(arrivals, [group], order).running(
        nth=F.lit(1).cast("long"), total=F.col("value"), n_accepted=F.col("accepted").cast("long"))
    return run.result().withColumn("running_mean", F.col("total") / F.col("nth")).drop("total")


def running_median(arrivals: DataFrame, group: str, order: list[str], window_rows: int = 5_000) -> DataFrame:
    """Adds the median of the values seen so far, by arrival order; NULL values are not seen.

    A window keeps the counts of all values seen, which suits groups up to ``window_rows`` rows.
    Beyond that the wanted order statistics are found digit by digit (see ``_medians_by_digits``).
    """
    top = arrivals.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if (top or 0) <= window_rows:
        win = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return arrivals.withColumn("running_median", F.percentile("value", 0.5).over(win))
    numbered = cut_lineage(Ordered(arrivals, [group], order).running(
        __n=F.lit(1).cast("long"), __seen=F.col("value").isNotNull().cast("long")).result())
    medians = _medians_by_digits(
        numbered.select(F.col(group).alias("__group"), "__n", "__seen", "value"), "__group").withColumnRenamed("__n", "__at")
    return numbered.join(
        medians, numbered[group].eqNullSafe(medians["__group"]) & (numbered["__n"] == medians["__at"]), "left").drop(
            "__n", "__seen", "__group", "__at")


DIGIT = 8  # bits of a code that one pass looks at


def digit_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task function: the rows of ranges in order to the digits of values and of the answers to questions.

    Rows are (segment, kind, digit, k, ...): kind 0 says how many values with a digit precede the range, kind 1 are
    values and kind 2 questions for the ``k``th smallest so far, whose digit is where the running counts of the digits pass k.
    """
    segment, counts = None, np.zeros(1 << DIGIT, np.int64)
    for batch in batches:
        digits, ks = batch["digit"].to_numpy(np.int64).copy(), batch["k"].to_numpy(np.int64).copy()
        for i, (own, kind) in enumerate(zip(batch["segment"].tolist(), batch["kind"].tolist())):
            if own != segment:
                segment, counts = own, np.zeros(1 << DIGIT, np.int64)
            if kind == 0:
                counts[digits[i]] += ks[i]
            elif kind == 1:
                counts[digits[i]] += 1
            else:
                upto = counts.cumsum()
                digits[i] = np.searchsorted(upto, ks[i])
                if digits[i]:
                    ks[i] -= upto[digits[i] - 1]
        yield batch.assign(digit=digits, k=ks)[batch["kind"] > 0]


def _medians_by_digits(numbered: DataFrame, group: str) -> DataFrame:
    """``group, __n, running_median`` for rows numbered by ``__n`` in each group, ``__seen`` values up to each.

    Values are replaced by their dense codes.  A row asks for the one or two middle values among those up to it.  All
    values and questions descend the codes together, a digit of ``DIGIT`` bits at a time (a wavelet matrix of wide
    digits): in each node rows are in their order, and a question goes where the running counts of the digits pass
    its rank.  The rows of a pass are dealt by ranges of nodes and order, whatever the size of a group; what
    precedes a range is a table of counts for the node that it shares with earlier ranges.
    """
    present = numbered.where("value IS NOT NULL")
    codes = cut_lineage(row_numbers(present.select("value").distinct(), [], ["value"], "code"))
    levels = -(-max(1, int((codes.agg(F.max("code")).first()[0] or 1) - 1).bit_length()) // DIGIT)
    none = F.lit(0).cast("long")
    values = present.join(codes, "value").select(
        group, F.lit(0).cast("long").alias("node"), F.col("__n").alias("t"), F.lit(0).alias("q"), (F.col("code") - 1).alias("code"), none.alias("k"))
    middle = F.array_distinct(F.array(F.floor((F.col("__seen") + 1) / 2), F.floor((F.col("__seen") + 2) / 2)))
    asked = numbered.where("__seen > 0").select(group, F.col("__n").alias("t"), F.posexplode(middle).alias("p", "k")).select(
        group, F.lit(0).cast("long").alias("node"), "t", (F.col("p") + 1).alias("q"), none.alias("code"), "k")
    rows = cut_lineage(values.unionByName(asked))
    ranges = max(1, -(-2 * rows.count() // rows_per_task(rows)))
    kinds = f"`{group}` {rows.schema[group].dataType.simpleString()}, node long, t long, q int, code long, k long, digit long"
    for level in range(levels - 1, -1, -1):
        digit = F.when(F.col("q") == 0, F.shiftright("code", DIGIT * level).bitwiseAND((1 << DIGIT) - 1)).otherwise(none)
        dealt = cut_lineage(rows.withColumn("digit", digit).repartitionByRange(ranges, group, "node", "t", "q").withColumn(
            "range", F.spark_partition_id()))
        places = dealt.groupBy(group, "node", "range").count()
        shared = places.groupBy(group, "node").agg(F.min("range").alias("lo"), F.max("range").alias("hi")).where("lo < hi")
        own = F.col(group).eqNullSafe(F.col("s_group")) & (F.col("node") == F.col("s_node"))
        shared = shared.select(F.col(group).alias("s_group"), F.col("node").alias("s_node"))
        counts = dealt.where("q = 0").join(shared, own, "left_semi").groupBy(
            F.col(group).alias("c_group"), F.col("node").alias("c_node"), F.col("range").alias("c_range"), F.col("digit").alias("c_digit")).agg(
                F.count(F.lit(1)).alias("c"))
        slots = places.join(shared, own, "left_semi").select(group, "node", "range", F.explode(F.sequence(
            none, F.lit((1 << DIGIT) - 1).cast("long"))).alias("digit"))
        before = Window.partitionBy(group, "node", "digit").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        base = slots.join(counts, F.col(group).eqNullSafe(F.col("c_group")) & (F.col("node") == F.col("c_node")) & (
            F.col("range") == F.col("c_range")) & (F.col("digit") == F.col("c_digit")), "left").withColumn(
                "k", F.sum(F.coalesce("c", none)).over(before)).where("k > 0")
        work = dealt.withColumn("kind", F.when(F.col("q") == 0, 1).otherwise(2)).unionByName(base.select(
            group, "node", none.alias("t"), F.lit(0).alias("q"), none.alias("code"), "k", "digit", "range", F.lit(0).alias("kind")))
        # Within a range the counts of a node come first; values come before the questions of their row.
        work = work.withColumn("segment", F.xxhash64("range", group, "node")).repartition(ranges, "range").sortWithinPartitions(
            "range", group, "node", F.col("kind") > 0, "t", "q")
        done = work.mapInPandas(digit_task, f"{kinds}, range int, kind int, segment long")
        rows = done.select(group, (F.col("node") * (1 << DIGIT) + F.col("digit")).alias("node"), "t", "q", "code", "k")
    found = rows.where("q > 0").withColumn("code", F.col("node") + 1).join(codes, "code")
    return found.groupBy(group, F.col("t").alias("__n")).agg(F.avg("value").alias("running_median"))


def candidate_share(votes: DataFrame) -> DataFrame:
    """Items with at least one yes, absolute and relative."""
    any_yes = votes.groupBy("item").agg(F.max("vote").alias("any_yes"))
    return any_yes.agg(F.sum("any_yes").alias("n_candidates"), F.avg("any_yes").alias("share"))


def selection_frequency(marks: DataFrame) -> DataFrame:
    """Mean number of non-empty highlights per annotator, absolute and relative to the mean load.

    ``marks`` has ``annotator, hl``.  The load is the same constant for all annotators (rows divided
    by annotators), as in a balanced study.
    """
    per = marks.groupBy("annotator").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("hl") == 0).alias("empty"))
    tot = per.agg((F.sum("n") / F.count(F.lit(1))).alias("load"), F.avg("empty").alias("mean_empty"))
    return tot.select(
        (F.col("load") - F.col("mean_empty")).alias("mean_freq"),
        ((F.col("load") - F.col("mean_empty")) / F.col("load")).alias("rel_freq"))


def load_extremes(votes: DataFrame, annotators: DataFrame) -> DataFrame:
    """Fewest and most votes of an item among the given annotators."""
    per = votes.join(annotators, "annotator", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_items"), F.max("n").alias("max_n"), F.min("n").alias("min_n"))


def split_coverage(votes: DataFrame, ranked: DataFrame) -> DataFrame:
    """Fewest votes per touched item on both sides of every split point i of the ordered annotators.

    ``ranked`` has ``annotator, rank`` (1..m).  Between two of its voting ranks an item has constant
    counts, so it is a list of spans [lo, hi).  A span is the union of two of the longest power of two that fits;
    these repeat, so their minima are taken first.  Then a span is cut into at most 2*log2(m) aligned
    power-of-two blocks, the minimum is taken per block, and a split point looks up the one block
    per level that covers it.
    """
    m = ranked.agg(F.max("rank")).first()[0] or 0
    levels = int(m + 1).bit_length()
    per = votes.join(ranked, "annotator").groupBy("item", "rank").agg(F.count(F.lit(1)).alias("c"))
    tot = per.groupBy("item").agg(F.sum("c").alias("tot"), F.max("rank").alias("last"))
    run = Ordered(per, ["item"], ["rank"]).previous(prior="rank").running(seen=F.col("c")).result()
    zero = F.lit(0).cast("long")
    before = F.col("seen") - F.col("c")
    # The span that ends at a voting rank, and the one after the last voting rank.
    spans = run.join(tot, "item").select(
        F.coalesce(F.col("prior").cast("long"), zero).alias("lo"), F.col("rank").cast("long").alias("hi"),
        F.nullif(before, zero).alias("left"), (F.col("tot") - before).alias("right"))
    tail = tot.select(F.col("last").cast("long").alias("lo"), F.lit(m + 1).cast("long").alias("hi"),
                      F.col("tot").alias("left"), F.lit(None).cast("long").alias("right"))

    def blocks(k):
        size = F.pow(F.lit(2.0), k).cast("long")
        low, high = F.ceil(F.col("lo") / size), F.floor(F.col("hi") / size)
        open_ = low < high
        return F.array(
            F.when(open_ & (low % 2 == 1), F.struct(k.alias("level"), low.alias("block"))),
            F.when(open_ & (high % 2 == 1), F.struct(k.alias("level"), (high - 1).alias("block"))))

    # 2 ** (binary digits of the length - 1); at most m starts for each of log2(m) lengths are left.
    longest = F.pow(F.lit(2.0), F.length(F.bin(F.col("hi") - F.col("lo"))) - 1).cast("long")
    halves = spans.unionByName(tail).where("lo < hi").withColumn("size", longest).select(
        "left", "right", "size", F.explode(F.array("lo", F.col("hi") - F.col("size"))).alias("lo"))
    halves = halves.groupBy("size", "lo").agg(F.min("left").alias("left"), F.min("right").alias("right")).withColumn(
        "hi", F.col("lo") + F.col("size"))
    cover = halves.select(
        "left", "right",
        F.explode(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), blocks)))).alias("b"),
    ).groupBy("b.level", "b.block").agg(F.min("left").alias("left"), F.min("right").alias("right"))
    points = ranked.select(F.col("rank").cast("long").alias("i")).select(
        "i", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")).withColumn(
        "block", F.floor(F.col("i") / F.pow(F.lit(2.0), "level").cast("long")))
    return points.join(cover, ["level", "block"]).groupBy("i").agg(
        F.min("left").alias("min_left"), F.min("right").alias("min_right"))


def best_annotator_split(votes: DataFrame, ranked: DataFrame) -> DataFrame:
    """Last split point with equal minimum coverage on both sides, and that coverage."""
    equal = split_coverage(votes, ranked).where(F.col("min_left") == F.col("min_right"))
    return equal.agg(F.max("i").alias("split_at"), F.max_by("min_left", "i").alias("max_k"))

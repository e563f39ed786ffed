"""Set algebra over id tables and duplicate examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.plans.ordered import rows_per_task


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def common_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b, key, "left_semi")


def minus_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b, key, "left_anti")


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of both sets, their intersection, union and differences, from one grouped pass."""
    both = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(key).agg(
        F.max("a").alias("a"), F.max("b").alias("b"))
    ina, inb = F.col("a") == 1, F.col("b") == 1
    return both.agg(
        F.count_if(ina).alias("n_a"), F.count_if(inb).alias("n_b"), F.count_if(ina & inb).alias("n_both"),
        F.count(F.lit(1)).alias("n_any"), F.count_if(ina & ~inb).alias("n_only_a"),
        F.count_if(inb & ~ina).alias("n_only_b"))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether the sets are disjoint, a is a subset of b, and a and b are equal."""
    s = set_sizes(a, b, key)
    return s.select((F.col("n_both") == 0).alias("disjoint"), (F.col("n_only_a") == 0).alias("subset"),
                    ((F.col("n_only_a") == 0) & (F.col("n_only_b") == 0)).alias("equal"))


def deduplicate(examples: DataFrame, columns: list[str]) -> DataFrame:
    """Examples with equal contents, once each; array columns compare by value."""
    return examples.dropDuplicates(columns)


def in_every_study(members: DataFrame, studies: DataFrame) -> DataFrame:
    """Annotators remaining in all studies of a merged group.

    ``members`` has ``study, annotator``, ``studies`` has ``group, study``.
    """
    sizes = studies.groupBy("group").agg(F.count_distinct("study").alias("k"))
    # Dealt by number: tasks cut by the size of shuffled data hold many short rows in their tables.
    rows = members.join(studies, "study").select("group", "annotator", "study")
    tasks = max(1, -(-rows.count() // rows_per_task(rows)))
    seen = rows.repartition(tasks, "group", "annotator").groupBy("group", "annotator").agg(F.count_distinct("study").alias("c"))
    return seen.join(sizes, "group").where(F.col("c") == F.col("k")).select("group", "annotator")


def append_runs(runs: DataFrame) -> DataFrame:
    """Answers of several runs renumbered per id in run order.

    ``runs`` has ``run, qid, rep, reply``; answers stay rows.
    """
    from turnwise.plans.ordered import row_numbers
    return row_numbers(runs, ["qid"], ["run", "rep"], "nth").select("qid", (F.col("nth") - 1).alias("rep"), "reply")

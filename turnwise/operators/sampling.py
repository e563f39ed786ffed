"""Seeded samples, quotas and splits.

Random order is the order of md5(seed|key): the same on any partitioning, on retries and in other
engines.  Per-stratum limits are window limits, which Spark applies before the shuffle too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.plans.ordered import row_numbers, rows_per_task


def draw(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def random_sample(rows: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    return rows.orderBy(draw(seed, *keys), *keys).limit(n)


def per_stratum(rows: DataFrame, stratum: str, n: int, seed: int, *keys: str) -> DataFrame:
    win = Window.partitionBy(stratum).orderBy(draw(seed, *keys), *keys)
    return rows.withColumn("__r", F.row_number().over(win)).where(F.col("__r") <= n).drop("__r")


def combination_strata(strata: list[tuple[list[str], int]]) -> tuple[Column, dict[int, int]]:
    """Stratum number of a flag vector column ``combo`` and the wanted size of each stratum.

    A stratum is a union of flag vectors.
    """
    number = reduce(
        lambda acc, s: acc.when(F.col("combo").isin(s[1][0]), s[0]),
        enumerate(strata[1:], 1), F.when(F.col("combo").isin(strata[0][0]), 0))
    return number, {i: n for i, (_, n) in enumerate(strata)}


def sample_by_combination(flagged: DataFrame, strata: list[tuple[list[str], int]], seed: int,
                          key: str = "qid") -> DataFrame:
    """Fixed numbers per union of flag combinations; ``flagged`` has ``qid, combo``."""
    number, sizes = combination_strata(strata)
    rows = flagged.withColumn("stratum", number).where("stratum IS NOT NULL")
    win = Window.partitionBy("stratum").orderBy(draw(seed, key), key)
    ranked = rows.withColumn("__r", F.row_number().over(win)).where(F.col("__r") <= max(sizes.values()))
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), "stratum")
    return ranked.where(F.col("__r") <= limit).drop("__r")


def quota_sample(pool: DataFrame, first: int, quotas: dict[str, int], seed: int,
                 absorb: tuple[str, str] | None = None, offset_by: str | None = None) -> DataFrame:
    """Two-stage sample: ``first`` at random, then classes are filled up to their quotas.

    ``pool`` has ``qid, class``.  What stage one drew counts towards the quotas.  With ``absorb``
    (full, slack) the quota of ``full`` grows to what stage one drew and ``slack`` shrinks by the
    excess; stage-one rows of class ``offset_by`` shrink ``slack`` as well.  ``random`` is 1 for
    stage one.
    """
    stage1 = random_sample(pool, first, seed, "qid").withColumn("random", F.lit(1))
    drawn = {r["class"]: r["n"] for r in stage1.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = dict(quotas)
    if absorb:
        full, slack = absorb
        excess = max(0, drawn.get(full, 0) - wanted[full])
        wanted[full] += excess
        wanted[slack] -= excess + (drawn.get(offset_by, 0) if offset_by else 0)
    missing = {c: max(0, n - drawn.get(c, 0)) for c, n in wanted.items()}
    limit = F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(x) for kv in missing.items() for x in kv]), F.col("class")), F.lit(0))
    rest = pool.join(stage1.select("qid"), "qid", "left_anti")
    win = Window.partitionBy("class").orderBy(draw(seed + 1, "qid"), "qid")
    stage2 = rest.withColumn("__r", F.row_number().over(win)).where(
        (F.col("__r") <= max(missing.values())) & (F.col("__r") <= limit)).drop("__r").withColumn("random", F.lit(0))
    return stage1.unionByName(stage2)


def sample_ratio(pool: DataFrame, sample: DataFrame) -> DataFrame:
    """Class shares in the pool and in the sample."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy("class").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        tot = n.agg(F.sum(f"n_{name}").alias("__t")).withColumn("__k", F.lit(1))
        return n.withColumn("__k", F.lit(1)).join(F.broadcast(tot), "__k").select(
            "class", f"n_{name}", (F.col(f"n_{name}") / F.col("__t")).alias(f"share_{name}"))
    return shares(pool, "pool").join(shares(sample, "sample"), "class", "left").na.fill(0)


def _slices(weights: DataFrame, seed: int, key: str, digits: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a uniform slice of the md5 order, and the weight before each of the 16**digits slices."""
    rows = weights.withColumn("__h", draw(seed, key)).withColumn("__s", F.substring("__h", 1, digits))
    per = rows.groupBy("__s").agg(F.sum("weight").alias("w"))
    win = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    return rows, per.select("__s", F.coalesce(F.sum("w").over(win), F.lit(0)).alias("__before"))


def weighted_split(weights: DataFrame, seed: int, key: str = "qid",
                   cuts: tuple[tuple[str, float], ...] = (("train", 0.70), ("dev", 0.85), ("test", 1.0)),
                   digits: int | None = None) -> DataFrame:
    """Group-disjoint split by cumulative weight in md5 order.

    The order is cut into slices by its first ``digits``, by default as many as keep a slice within the
    rows of a task; each slice is a window of its own.

    ``weights`` has ``key, weight`` with one row per item, so no item is in two splits.  A row goes
    to the first split whose cut is above the share of the weight before it.
    """
    total = weights.agg(F.sum("weight").alias("__total")).withColumn("__k", F.lit(1))
    if digits is None:
        slices, digits = weights.count() / (rows_per_task(weights) / 4), 2
        while 16 ** digits < slices:
            digits += 1
    rows, before = _slices(weights, seed, key, digits)
    win = Window.partitionBy("__s").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, -1)
    cum = rows.join(before, "__s").withColumn(
        "__cum", F.col("__before") + F.coalesce(F.sum("weight").over(win), F.lit(0)))
    placed = cum.withColumn("__k", F.lit(1)).join(F.broadcast(total), "__k").withColumn(
        "__p", F.col("__cum") / F.col("__total"))
    split = reduce(lambda acc, c: acc.when(F.col("__p") < c[1], c[0]), cuts[1:-1],
                   F.when(F.col("__p") < cuts[0][1], cuts[0][0])).otherwise(cuts[-1][0])
    return placed.select(key, "weight", split.alias("split"))


def list_split(ids: DataFrame, seed: int, key: str = "qid", shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """Row split of an id list: rounded shares for train and dev, the rest is test."""
    n = ids.count()
    train = round(n * shares[0])
    dev = round(n * shares[1])
    ranked = row_numbers(ids.withColumn("__h", draw(seed, key)), [], ["__h", key], "__r")
    return ranked.select(key, F.when(F.col("__r") <= train, "train").when(
        F.col("__r") <= train + dev, "dev").otherwise("test").alias("split"))


def split_sizes(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_items"), F.sum("weight").alias("n_annotations"))


def items_of_random_annotators(votes: DataFrame, annotators: int, per_annotator: int, seed: int) -> DataFrame:
    chosen = random_sample(votes.select("annotator").distinct(), annotators, seed, "annotator")
    rows = votes.select("item", "annotator").distinct().join(F.broadcast(chosen), "annotator", "left_semi")
    return per_stratum(rows, "annotator", per_annotator, seed, "item")


def share_between(tuples: DataFrame, low: float, high: float) -> DataFrame:
    return tuples.where((F.col("share") > low) & (F.col("share") < high))


def batch_slice(rows: DataFrame, order: list[str], start: int, size: int) -> DataFrame:
    """Rows ``start .. start+size-1`` (1-based) of the ordered table."""
    ranked = row_numbers(rows, [], order, "nth")
    return ranked.where(F.col("nth").between(start, start + size - 1))


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Numbered batches of ``size`` consecutive rows."""
    return row_numbers(rows, [], order, "nth").withColumn("batch", F.floor((F.col("nth") - 1) / size))

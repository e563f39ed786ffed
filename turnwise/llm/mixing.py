"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words: its share by weight, at most ``most`` times what it holds; what is
above is shared again among the others.  A document is taken as often as its source needs it for
certain (the whole part of target by size).  For the rest each document has the fractional part p as
inclusion probability, unequal between sources, and documents are ranked within their source by random odds
divided by inclusion odds, u / (1 - u) : p / (1 - p) (Rosen's Pareto order sampling).  The first ranks are
taken until the words that are still missing are reached; as the size of a sample counts in words, a
document that is larger than what is missing is passed over, and smaller ones later in the order fill up.

No window holds a source.  Ranks are counted in ``BUCKETS`` buckets of the random odds, running sums over a
source's buckets find the bucket where the missing words are reached, and only the documents of that bucket
are put in order.  What is decided is a few cuts for each source, so one scan of the documents applies them.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from turnwise.llm.base import query, table
from turnwise.plans.ordered import row_numbers
from turnwise.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (1, 2, 3)
MOST = 3
NEAR = 0.005  # share of the target within which a source's words are filled up no further
BUCKETS = 4_096
DRAWS = 1 << 52  # the random numbers are odd multiples of half of its inverse
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def count_words(text: str | None) -> int:
    """Runs of bytes other than ASCII white space."""
    blank = SPACE[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    return int((blank[:-1] & ~blank[1:]).sum()) + int(len(blank) > 0 and not blank[0])


def counted(texts: pd.Series) -> pd.Series:
    return pd.Series([count_words(t) for t in texts], dtype="int64")


def words_of(text: str) -> Column:
    return F.pandas_udf(counted, LongType())(F.col(text))


def random_number(seed: int, *values: Column) -> Column:
    """A number in (0, 1) from the MD5 of the seed and the values."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("null")) for v in values])
    draw = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (draw + F.lit(0.5)) / F.lit(float(DRAWS))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``sizes`` (``source``, ``source_size``) with ``target``, stored.

    Sources in the order of code points, null last, weigh ``weights`` in turn.  A share is bounded by
    ``most`` times the size; the excess goes to the others by weight until none is above.
    """
    order = row_numbers(sizes.withColumn("unnamed", F.col("source").isNull()), [], ["unnamed", "source"], "place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    state = cut_lineage(order.select(
        "source", "source_size", F.get(turn, ((F.col("place") - 1) % len(weights)).cast("int")).alias("weight")))
    total = state.agg(F.sum("source_size")).first()[0] or 0
    bound = F.col("source_size") * F.lit(float(most))
    level = -1.0  # words for a weight of one; it only rises, so the bounded sources only become more
    while True:
        above = F.col("weight") * level > bound
        full, free = state.agg(
            F.sum(F.when(above, bound).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        following = (total - full) / free if free else level
        if following <= level:
            break
        level = following
    return state.select("source", "source_size", F.least(F.col("weight") * max(level, 0.0), bound).alias("target"))


def mixing_plan(
    sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, near: float = NEAR,
) -> DataFrame:
    """For each ``source`` its ``source_size``, ``target``, ``whole`` (copies of all its documents) and ``cuts``.

    ``sizes`` has ``source``, ``size`` and ``u`` of each document and should be stored.  A document has one
    copy more if a cut (``room``, ``odds``) has its size in ``room`` and its odds up to ``odds``, or is the
    single document ``last`` (``size``, ``u``).  See ``mix_documents`` for what is promised.
    """
    plan = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = cut_lineage(plan.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.col("whole")).withColumn(
        "missing", F.when(F.col("p") > 0, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)).withColumn(
        "cuts", F.expr("CAST(array() AS array<struct<room: double, odds: double>>)")).withColumn("open", F.col("p") > 0))
    while True:
        rows = with_plan(sizes, plan.where(F.col("open") & (F.col("missing") > F.lit(near) * F.col("target")))).where(
            "size > 0 AND size <= missing").where(~picked()).withColumn(
                "bucket", F.floor(F.col("odds") / (F.col("odds") + 1) * BUCKETS))
        filled = rows.groupBy("source", "bucket").agg(
            F.sum("size").alias("words"), F.max("odds").alias("top"), F.max("missing").alias("missing"))
        upto = Window.partitionBy("source").orderBy("bucket")
        filled = filled.withColumn("upto", F.sum("words").over(upto)).groupBy("source").agg(
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("missing"), F.col("upto"))), F.lit(0)).alias("base"),
            F.max(F.when(F.col("upto") <= F.col("missing"), F.col("top"))).alias("top"),
            F.min(F.when(F.col("upto") > F.col("missing"), F.col("bucket"))).alias("edge"))
        filled = cut_lineage(filled)
        if filled.isEmpty():
            break
        # The bucket in which the missing words are reached; equal rows have equal odds and go together.
        edge = rows.join(named(filled, "f_"), F.col("source").eqNullSafe(F.col("f_source")) & (F.col("bucket") == F.col("f_edge")))
        edge = edge.groupBy("source", "odds").agg(
            F.sum("size").alias("words"), F.max(F.col("missing") - F.col("f_base")).alias("room")).withColumn(
                "upto", F.sum("words").over(Window.partitionBy("source").orderBy("odds"))).where("upto <= room").groupBy(
                    "source").agg(F.max("odds").alias("odds"), F.max("upto").alias("words"))
        step = plan.join(named(filled, "f_"), F.col("source").eqNullSafe(F.col("f_source")), "left").join(
            named(edge, "e_"), F.col("source").eqNullSafe(F.col("e_source")), "left")
        cut = F.coalesce("e_odds", "f_top", F.lit(0.0))
        plan = cut_lineage(step.select(
            "source", "source_size", "target", "whole", "p",
            (F.col("missing") - F.coalesce("f_base", F.lit(0)) - F.coalesce("e_words", F.lit(0))).alias("missing"),
            F.when(F.col("f_base").isNull(), F.col("cuts")).otherwise(F.concat("cuts", F.array(F.struct(
                F.col("missing").alias("room"), cut.alias("odds"))))).alias("cuts"),
            # Without a document in the cut those that fit are larger than what is left: nothing more to take.
            (F.col("open") & F.col("f_base").isNotNull() & (F.coalesce("f_base", F.lit(0)) + F.coalesce("e_words", F.lit(0)) > 0)).alias("open")))
    # What is left is less than any document; the smallest one may still bring the words nearer to the target.
    wanting = plan.where(F.col("missing") > F.lit(near) * F.col("target"))
    last = with_plan(sizes, wanting).where("size > 0").where(~picked()).groupBy("source").agg(
        F.min(F.struct("size", "odds")).alias("last"), F.max("missing").alias("missing"))
    near_ones = last.where(F.col("last.size") - F.col("missing") < F.col("missing"))
    return cut_lineage(plan.join(
        named(near_ones.select("source", "last"), "l_"), F.col("source").eqNullSafe(F.col("l_source")), "left").select(
            "source", "source_size", "target", "whole", "p", "cuts", F.col("l_last").alias("last")))


def named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def with_plan(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with the plan of their source, and their ``odds``: random odds by inclusion odds."""
    joined = sizes.join(named(plan, "p_"), F.col("source").eqNullSafe(F.col("p_source"))).select(
        *sizes.columns, *[F.col(f"p_{c}").alias(c) for c in plan.columns if c != "source"])
    return joined.withColumn("odds", F.when(
        F.col("p") > 0, F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))))


def picked() -> Column:
    """Whether a document (with the plan of its source) is in one of the cuts."""
    return F.exists("cuts", lambda c: (F.col("size") <= c["room"]) & (F.col("odds") <= c["odds"]))


def mix_documents(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS,
    most: int = MOST, near: float = NEAR, seed: int = 12,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` of each row in one struct column ``mix`` beside ``row``.

    ``size`` is the number of words of the text (null: 0).  ``weights`` are given in turn to the sources in the order of
    their code points, null last.  All sizes together are shared by weight; no target is above ``most`` times its source's
    size.  The words taken from a source differ from its target by ``near`` of it or by less than any document
    that was left out could mend.  A rerun takes the same.  Rows with equal id and text are taken alike, empty texts
    have no words to take, a source without words has the target 0, an empty table gives an empty result.
    """
    sized = docs.select(F.struct("*").alias("row"), words_of(text).alias("size"), F.col(source).alias("source"),
                        random_number(seed, F.col(id), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("u"))
    sizes = cut_lineage(sized.select("source", "size", "u"))
    plan = mixing_plan(sizes, weights=weights, most=most, near=near)
    return taken(sized, plan)


def taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """All columns of ``sized`` but ``u``, and ``mix``."""
    extra = F.when(F.col("size") > 0, picked() | F.coalesce(
        (F.col("last.size") == F.col("size")) & (F.col("last.odds") == F.col("odds")), F.lit(False))).otherwise(False)
    return with_plan(sized, plan).select(
        *[c for c in sized.columns if c not in ("u", "source", "size")],
        F.struct("size", "source_size", "target", (F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int")).alias("copies")).alias("mix"))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as ``mix_documents`` takes it."""
    return mix_documents(docs, **how).where("mix.copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("mix.copies").cast("int"))).alias("copy")).select("row.*")


SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('12|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE)
      / {float(DRAWS)!r}::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
    (1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3)::DOUBLE AS weight
  FROM sized GROUP BY source),
levels(level, step) AS (
  SELECT -1.0::DOUBLE, 0
  UNION ALL
  SELECT ((SELECT sum(source_size) FROM sources) - sum(CASE WHEN s.weight * l.level > 3 * s.source_size THEN 3 * s.source_size ELSE 0 END))
      / nullif(sum(CASE WHEN s.weight * l.level > 3 * s.source_size THEN 0 ELSE s.weight END), 0), l.step + 1
  FROM levels l, sources s WHERE l.level IS NOT NULL GROUP BY l.level, l.step
  HAVING ((SELECT sum(source_size) FROM sources) - sum(CASE WHEN s.weight * l.level > 3 * s.source_size THEN 3 * s.source_size ELSE 0 END))
      / nullif(sum(CASE WHEN s.weight * l.level > 3 * s.source_size THEN 0 ELSE s.weight END), 0) > l.level),
targets AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM levels), 3 * source_size) AS target FROM sources),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS p FROM targets),
passes(step, doc_id, source, size, odds, target, missing, picked, going) AS (
  SELECT 0, doc_id, d.source, size, (u / (1 - u)) / (p / (1 - p)), target, target - whole * source_size, FALSE, TRUE
  FROM sized d JOIN plans t ON d.source IS NOT DISTINCT FROM t.source WHERE p > 0 AND size > 0
  UNION ALL
  SELECT step + 1, doc_id, source, size, odds, target,
    missing - sum(CASE WHEN new THEN size ELSE 0 END) OVER (PARTITION BY source), picked OR new, bool_or(new) OVER (PARTITION BY source)
  FROM (SELECT *, NOT picked AND size <= missing AND sum(CASE WHEN NOT picked AND size <= missing THEN size ELSE 0 END)
      OVER (PARTITION BY source ORDER BY odds) <= missing AS new
    FROM passes WHERE going AND missing > {NEAR} * target)),
ends AS (SELECT * FROM passes QUALIFY step = max(step) OVER (PARTITION BY source)),
lasts AS (
  SELECT *, NOT picked AND missing > {NEAR} * target AND size - missing < missing
    AND (size, odds) = min(CASE WHEN NOT picked THEN (size, odds) END) OVER (PARTITION BY source) AS is_last FROM ends),
extras AS (SELECT source, size, odds, bool_or(picked OR is_last) AS extra FROM lasts GROUP BY source, size, odds)
SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target,
  CAST(d.size * (t.whole + CASE WHEN coalesce(e.extra, FALSE) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN plans t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN extras e ON e.source IS NOT DISTINCT FROM d.source AND e.size = d.size AND e.odds = (d.u / (1 - d.u)) / (t.p / (1 - t.p))"""


@query("op12_source_mix", SQL)
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = cut_lineage(docs.select(
        "doc_id", "source", words_of("text").alias("size"),
        random_number(12, F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("u")))
    plan = mixing_plan(sized.select("source", "size", "u"))
    return taken(sized, plan).select(
        "doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))

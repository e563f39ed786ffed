"""Pseudonyms for annotator ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.plans.ordered import row_numbers

PREFIX = "PROLIFIC_"


def extend_map(known: DataFrame, seen: DataFrame, order: str, lead: str = "lead", lead_as: str = "Lead") -> DataFrame:
    """``orig, anon`` of the known map plus numbered names for unseen ids.

    New numbers go on after the largest one, in the order of first appearance (``order`` of
    ``seen``).  Ids holding the lead's name get it replaced instead.  NULL ids are skipped.
    """
    first = seen.where(F.col("orig").isNotNull()).groupBy("orig").agg(F.min(order).alias("first"))
    new = first.join(known.select("orig"), "orig", "left_anti")
    is_lead = F.contains(F.lower("orig"), F.lit(lead))
    top = known.agg(F.coalesce(F.max(F.regexp_extract("anon", rf"^{PREFIX}(\d+)$", 1).try_cast("long")),
                               F.lit(0).cast("long")).alias("top")).withColumn("k", F.lit(1))
    numbered = row_numbers(new.where(~is_lead), [], ["first", "orig"], "nth").withColumn("k", F.lit(1))
    plain = numbered.join(F.broadcast(top), "k").select(
        "orig", F.concat(F.lit(PREFIX), (F.col("top") + F.col("nth")).cast("string")).alias("anon"))
    leads = new.where(is_lead).select("orig", F.replace(F.lower("orig"), F.lit(lead), F.lit(lead_as)).alias("anon"))
    return known.select("orig", "anon").unionByName(plain).unionByName(leads)


def apply_map(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Replace the ids of a column; unknown ids stay."""
    m = names.select(F.col("orig").alias("__o"), F.col("anon").alias("__a"))
    joined = rows.join(m, F.col(column) == F.col("__o"), "left")
    return joined.withColumn(column, F.coalesce("__a", column)).drop("__o", "__a")


def apply_map_to_lists(rows: DataFrame, names: DataFrame, keys: list[str], columns: list[str],
                       keep_unknown: tuple[str, ...] = ("admitted",)) -> tuple[DataFrame, DataFrame]:
    """Replace ids inside list columns; TRAIN rows stay as they are.

    Returns the rows and the quarantine: rows with an unknown id in a column that does not allow it.
    """
    train = F.col("version") == "TRAIN"
    entries = rows.where(~train).select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).alias("ids")) for c in columns])).alias("e")).select(
        *keys, "e.c", F.posexplode("e.ids").alias("pos", "orig"))
    mapped = entries.join(names.select("orig", "anon"), "orig", "left")
    unknown = F.col("anon").isNull() & ~F.col("c").isin(*keep_unknown)

    def mapped_list(column: str) -> Column:
        ids = F.collect_list(F.when(F.col("c") == column, F.struct("pos", F.coalesce("anon", "orig").alias("id"))))
        return F.transform(F.array_sort(ids), lambda x: x["id"]).alias(f"__{column}")

    lists = mapped.groupBy(*keys).agg(F.max(unknown).alias("__bad"), *[mapped_list(c) for c in columns])
    joined = rows.join(lists, keys, "left").withColumn("__bad", F.coalesce("__bad", F.lit(False)))
    done = joined.where(~F.col("__bad")).withColumns({
        c: F.when(train, F.col(c)).otherwise(F.coalesce(f"__{c}", c)) for c in columns}).select(*rows.columns)
    return done, joined.where("__bad").select(*rows.columns)

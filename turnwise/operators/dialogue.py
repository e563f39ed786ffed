"""Utterances, canonical speakers, same-speaker runs.

Utterance tables have the columns ``conv, pos, speaker, text``; ``pos`` counts from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import n_tokens
from turnwise.plans.ordered import Ordered, row_numbers
from turnwise.session import cut_lineage

IN_ROW_NAMES = 32


def explode_interviews(interviews: DataFrame) -> DataFrame:
    """One row per utterance from the parallel arrays ``speaker`` and ``utt``."""
    return interviews.select(
        F.col("id").alias("conv"),
        F.posexplode(F.arrays_zip("speaker", "utt")).alias("pos", "u"),
    ).select("conv", "pos", F.col("u.speaker").alias("speaker"), F.col("u.utt").alias("text"))


def speaker_names(utterances: DataFrame) -> DataFrame:
    """Distinct names per conversation with their first and last position and their utterances.

    An utterance without a speaker has no name and counts for none.
    """
    return utterances.where("speaker IS NOT NULL").groupBy("conv", "speaker").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))


def _name_sizes(names: DataFrame) -> tuple[int, int, int]:
    """Most names of a conversation, all utterances, most utterances of a conversation."""
    per = names.groupBy("conv").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    return tuple(x or 0 for x in per.agg(F.max("k"), F.sum("n"), F.max("n")).first())


def _in_row_cast(names: DataFrame) -> DataFrame:
    """``conv, cast`` with the canonical name of each member, for conversations with few names."""
    members = names.groupBy("conv").agg(F.collect_list(F.struct("speaker", "first_pos", "last_pos")).alias("m"))

    def owner(a):
        longer = F.filter("m", lambda b: F.contains(b["speaker"], a["speaker"]))
        return F.array_max(F.transform(
            longer, lambda b: F.struct(F.length(b["speaker"]), b["last_pos"], b["speaker"].alias("canon"))))["canon"]

    return members.select("conv", F.transform("m", lambda a: F.struct(
        a["first_pos"].alias("first_pos"), owner(a).alias("canon"), a["speaker"].alias("speaker"),
        a["last_pos"].alias("last_pos"))).alias("cast"))


def _spread_canon(names: DataFrame) -> DataFrame:
    """Canonical names for conversations with any number of names.

    Every substring that is as long as some name of the conversation keeps its best owner by a partially
    aggregated ``max_by``, and each name looks itself up: no pairs of names.
    """
    size = F.length("speaker")
    lengths = names.groupBy("conv").agg(F.collect_set(size).alias("lengths"))
    parts = F.flatten(F.transform(
        F.filter("lengths", lambda n: n <= size),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda s: F.substring(F.col("speaker"), s, n))))
    owners = names.join(lengths, "conv").select(
        "conv", "speaker", "last_pos", F.explode(F.array_distinct(parts)).alias("part"),
    ).groupBy("conv", "part").agg(
        F.max_by("speaker", F.struct(F.length("speaker"), F.col("last_pos"))).alias("canon"))
    return names.join(owners.withColumnRenamed("part", "speaker"), ["conv", "speaker"]).select(
        "conv", "speaker", "canon", "first_pos", "last_pos")


def _by_cast_size(names: DataFrame, in_row: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Names of conversations with up to ``in_row`` names, and those of the others, if there are any."""
    if most <= in_row:
        return names, None
    large = names.groupBy("conv").count().where(F.col("count") > in_row).select("conv")
    return names.join(large, "conv", "left_anti"), names.join(large, "conv", "left_semi")


def canonical_speakers(utterances: DataFrame, in_row: int = IN_ROW_NAMES) -> DataFrame:
    """``conv, speaker, canon, first_pos, last_pos``.

    A name contained in longer names of the conversation maps to the longest of them, ties to the
    one seen last.  Conversations with more than ``in_row`` names take another way to the same result.
    """
    names = speaker_names(utterances)
    small, large = _by_cast_size(names, in_row, _name_sizes(names)[0])
    found = _in_row_cast(small).select("conv", F.explode("cast").alias("m")).select(
        "conv", "m.speaker", "m.canon", "m.first_pos", "m.last_pos")
    return found if large is None else found.unionByName(_spread_canon(large))


def _casts(names: DataFrame, in_row: int, most: int) -> DataFrame:
    """``conv, n_speakers, host, guest, host_names``; guest only where there are two speakers."""
    small, large = _by_cast_size(names, in_row, most)
    people = F.array_sort(F.col("cast"))
    order = F.array_distinct(F.transform(people, lambda m: m["canon"]))
    casts = _in_row_cast(small).select(
        "conv", F.size(order).cast("long").alias("n_speakers"), F.get(order, F.lit(0)).alias("host"),
        F.when(F.size(order) == 2, F.get(order, F.lit(1))).alias("guest"),
        F.transform(F.filter(people, lambda m: m["canon"] == F.get(order, F.lit(0))),
                    lambda m: m["speaker"]).alias("host_names"))
    return casts if large is None else casts.unionByName(_spread_casts(large))


def _spread_casts(names: DataFrame) -> DataFrame:
    """The same for conversations with any number of names."""
    canon = cut_lineage(_spread_canon(names))
    people = canon.groupBy("conv", "canon").agg(F.min("first_pos").alias("first_pos"))
    roles = people.groupBy("conv").agg(
        F.count(F.lit(1)).alias("n_speakers"), F.min_by("canon", "first_pos").alias("host"),
        F.max_by("canon", "first_pos").alias("latest"))
    # Every name of a two-speaker conversation is a substring of one of two names, so the set is small.
    host_names = canon.join(roles.where("n_speakers = 2"), "conv").where(F.col("canon") == F.col("host")) \
        .groupBy("conv").agg(F.collect_set("speaker").alias("host_names"))
    return roles.join(host_names, "conv", "left").select(
        "conv", "n_speakers", "host", F.when(F.col("n_speakers") == 2, F.col("latest")).alias("guest"), "host_names")


def conversation_roles(utterances: DataFrame, in_row: int = IN_ROW_NAMES) -> DataFrame:
    """Host (first speaker), guest (the other one) and the two-speaker test per conversation.

    ``two_speakers`` holds when there are exactly two canonical speakers and the second one does not
    call itself host or anchor.
    """
    names = speaker_names(utterances)
    return _with_test(_casts(names, in_row, _name_sizes(names)[0])).drop("host_names")


def _with_test(casts: DataFrame) -> DataFrame:
    return casts.withColumn("two_speakers", F.coalesce(~F.col("guest").rlike("(?i)host|anchor"), F.lit(False)))


def two_person_conversations(utterances: DataFrame) -> DataFrame:
    """Utterances of conversations with exactly two distinct speakers."""
    wanted = utterances.groupBy("conv").agg(F.count_distinct("speaker").alias("k")).where("k = 2").select("conv")
    return utterances.join(wanted, "conv", "left_semi")


@dataclass
class Runs:
    """Same-speaker runs of two-speaker conversations; run 0 belongs to the host."""

    utterances: DataFrame  # conv, pos, text, run, host, guest
    table: DataFrame       # conv, run, first_pos, last_pos, n_utt, first_tokens, n_tokens, texts, host, guest
    split: bool            # some conversation is spread over several tasks


def speaker_runs(utterances: DataFrame, in_row: int = IN_ROW_NAMES) -> Runs:
    """Number the runs of each two-speaker conversation; utterances without a speaker are in none.

    The host's names of a conversation are a short list, and joining it on the conversation leaves
    one shuffle of the texts for the join, the windows and the run aggregate.
    """
    names = speaker_names(utterances)
    most_names, total, longest = _name_sizes(names)
    casts = _with_test(_casts(names, in_row, most_names))
    cast = casts.where("two_speakers").select("conv", "host", "guest", "host_names")
    spoken = utterances.where("speaker IS NOT NULL").join(cast, "conv").withColumn(
        "is_host", F.array_contains("host_names", F.col("speaker")))
    marked = Ordered(spoken.drop("host_names", "speaker"), ["conv"], ["pos"],
                     probe=utterances, sizes=(total, longest))
    marked = marked.previous(before="is_host").derive(
        brk=F.when(F.col("before").eqNullSafe(F.col("is_host")), 0).otherwise(1)).running(run=F.col("brk"))
    placed = marked.result().withColumn("run", F.col("run") - 1).drop("brk", "before")
    table = placed.groupBy("conv", "run").agg(
        F.any_value("host").alias("host"), F.any_value("guest").alias("guest"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.count(F.lit(1)).alias("n_utt"),
        F.min_by(n_tokens("text"), "pos").alias("first_tokens"),
        F.sum(n_tokens("text")).alias("n_tokens"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda u: u["text"]).alias("texts"),
    )
    return Runs(placed, table, marked.split)


def merged_turns(runs: Runs) -> DataFrame:
    """One text per run, utterances joined by a blank."""
    return runs.table.select("conv", "run", "first_pos", F.array_join("texts", " ").alias("text"))


def alternate_turns(turns: DataFrame, skip: int = 3, tail: int = 2) -> DataFrame:
    """Pair every turn after the first ``skip`` with its successor, leaving out the last ``tail``.

    ``turns`` has ``conv, run, text`` with dense ``run``; the partner is found by its run number.
    """
    sizes = turns.groupBy("conv").agg((F.max("run") + 1).alias("n_runs"))
    kept = turns.join(sizes, "conv").where(
        (F.col("run") >= skip) & (F.col("run") < F.col("n_runs") - tail)
    ).withColumn("slot", F.col("run") - skip)
    kept = kept.withColumn("pair", (F.col("slot") / 2).cast("long")).withColumn("odd", F.col("slot") % 2)
    # Two rows per pair at most, so the groups cannot grow.
    return kept.groupBy("conv", "pair").agg(
        F.max(F.when(F.col("odd") == 0, F.col("text"))).alias("guest_text"),
        F.max(F.when(F.col("odd") == 1, F.col("text"))).alias("host_text"),
    )


def length_features(pairs: DataFrame) -> DataFrame:
    """Mean guest length, total lengths and their ratio per conversation."""
    g, h = n_tokens("guest_text", "run"), n_tokens("host_text", "run")
    sums = pairs.groupBy("conv").agg(
        F.avg(g).alias("mean_guest_len"),
        F.sum(g).alias("total_guest"), F.coalesce(F.sum(h), F.lit(0)).alias("total_host"))
    return sums.withColumn("ratio", F.when(
        F.col("total_host") > 0, F.col("total_guest") / F.col("total_host")))


def reply_edges(utterances: DataFrame) -> DataFrame:
    """Rows (utterance, reply), both with a speaker and a text.

    ``utterances`` has ``utt_id, conv, speaker, text, reply_to``.
    """
    good = utterances.where(F.col("speaker").isNotNull() & (F.length("text") > 0))
    replies = good.where(F.col("reply_to").isNotNull()).select(
        F.col("reply_to").alias("utt_id"), F.col("utt_id").alias("reply_id"),
        F.col("speaker").alias("reply_speaker"), F.col("text").alias("reply_text"))
    return good.join(replies, "utt_id").select(
        "conv", "utt_id", "reply_id", "speaker", "reply_speaker", "text", "reply_text")


def shuffled_conversations(rows: DataFrame, seed: int, order: str = "guest_pos") -> DataFrame:
    """Conversations in a seeded random order, the rows of one together and in order."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("conv").cast("string"))), "conv", order)


def run_starts(positions: DataFrame, key: str = "conv", pos: str = "pos") -> DataFrame:
    """First member of every block of consecutive positions."""
    seen = Ordered(positions, [key], [pos]).previous(before=pos).result()
    return seen.where(F.col("before").isNull() | (F.col(pos) != F.col("before") + 1)).drop("before")


def positions_in(rows: DataFrame, key: str, order: list[str], name: str = "pos") -> DataFrame:
    """Dense positions from 0 for logs that carry none."""
    return row_numbers(rows, [key], order, name).withColumn(name, (F.col(name) - 1).cast("int"))

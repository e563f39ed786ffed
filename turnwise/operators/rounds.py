"""Annotation rounds: who took part, which items are open, what the next studies look like.

Round tables have ``study, version`` (STRING; merged studies hold ``a|b`` in both), ``status, qids,
admitted, participated, valid`` (arrays) and ``votes`` (array of structs yes, n beside ``qids``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.measures import votes_needed
from turnwise.plans.ordered import Ordered, row_numbers
from turnwise.plans.quantiles import beside, exact_quantiles

ACTIVE = ("COMPLETE", "PENDING")


def single_studies(rounds: DataFrame) -> DataFrame:
    """One row per member of merged studies, with its own ``name`` and ``ver``."""
    parts = F.arrays_zip(F.split("study", r"\|").alias("name"), F.split("version", r"\|").alias("ver"))
    return rounds.withColumn("__m", F.explode(parts)).select(
        "*", F.col("__m.name").alias("name"), F.col("__m.ver").alias("ver")).drop("__m")


def round_items(rounds: DataFrame) -> DataFrame:
    """One row per (study row, item) with its votes."""
    return rounds.select("study", "version", "status", F.explode(F.arrays_zip("qids", "votes")).alias("x")).select(
        "study", "version", "status", F.col("x.qids").alias("qid"),
        F.col("x.votes.yes").alias("yes"), F.col("x.votes.n").alias("n"))


def qualified_annotators(rounds: DataFrame, manual: DataFrame | None = None, column: str = "valid") -> DataFrame:
    """Annotators who passed a finished or running training, and those admitted by hand."""
    passed = rounds.where((F.col("version") == "TRAIN") & F.col("status").isin(*ACTIVE)).select(
        F.explode(column).alias("annotator"))
    return (passed if manual is None else passed.unionByName(manual.select("annotator"))).distinct()


def _took_part() -> Column:
    return F.when(F.col("status").isin(*ACTIVE), F.col("participated")).otherwise(F.col("admitted"))


def participant_history(rounds: DataFrame) -> DataFrame:
    """(study, annotator) over all rounds; a merged study counts for each of its members."""
    return single_studies(rounds).select(
        F.col("name").alias("study"), F.explode(_took_part()).alias("annotator")).distinct()


def annotators_of_items(rounds: DataFrame) -> DataFrame:
    """Valid annotators per item over the finished rounds, with the number of rounds (1 in sound data)."""
    done = rounds.where((F.col("status") == "COMPLETE") & (F.col("version") != "TRAIN"))
    return done.select("valid", F.explode("qids").alias("qid")).select("qid", F.explode("valid").alias("annotator")) \
        .groupBy("qid", "annotator").agg(F.count(F.lit(1)).alias("n_rounds"))


def failed_rounds(rounds: DataFrame, more_than: int = 3) -> DataFrame:
    """Annotators who took part without being valid in more than ``more_than`` finished rounds."""
    done = rounds.where((F.col("status") == "COMPLETE") & (F.col("version") != "TRAIN"))
    return done.select(F.explode(F.array_except("participated", "valid")).alias("annotator")).groupBy("annotator").agg(
        F.count(F.lit(1)).alias("n_failed")).where(F.col("n_failed") > more_than)


def workloads(rounds: DataFrame, qualified: DataFrame) -> DataFrame:
    """Items per annotator over all rounds; qualified annotators without work have 0."""
    work = rounds.where(F.col("version") != "TRAIN").select(
        F.explode(_took_part()).alias("annotator"), F.size("qids").alias("n")).unionByName(
        qualified.select("annotator", F.lit(0).alias("n")))
    return work.groupBy("annotator").agg(F.sum("n").alias("n_items"))


def finished_studies(rounds: DataFrame) -> DataFrame:
    return single_studies(rounds).where("ver = 'LAST'").select("name").distinct()


def latest_rounds(rounds: DataFrame) -> DataFrame:
    """Rows holding the newest version of some unfinished study that is neither TRAIN nor PENDING."""
    counted = (F.col("ver") != "TRAIN") & (F.col("status") != "PENDING")
    number = F.when(counted, F.col("ver").try_cast("int"))
    newest = single_studies(rounds.select("study", "version", "status")).groupBy("name").agg(
        F.max(F.col("ver") == "LAST").alias("finished"), F.max(number).alias("top"),
        F.max_by(F.struct("study", "version"), number).alias("at")).where("NOT finished AND top IS NOT NULL")
    return rounds.join(newest.select("at.study", "at.version").distinct(), ["study", "version"], "left_semi")


def highest_versions(rounds: DataFrame) -> DataFrame:
    last = finished_studies(rounds).select(F.col("name").alias("study"), F.lit("LAST").alias("version"))
    return last.unionByName(latest_rounds(rounds).select("study", "version"))


def valid_surveys(rounds: DataFrame) -> DataFrame:
    return rounds.where("status = 'COMPLETE' AND version <> 'TRAIN'").where(F.size("valid") > 0)


def _open_items(threshold: float, max_votes: int) -> Column:
    """Items of a round that want votes, with their need; in the row, as the lists are beside each other."""
    zipped = F.zip_with("qids", "votes", lambda q, v: F.struct(
        q.alias("qid"), votes_needed(v["yes"], v["n"], threshold, max_votes).alias("need")))
    return F.filter(zipped, lambda x: x["need"] > 0)


def round_statistics(rounds: DataFrame, threshold: float = 0.8, max_votes: int = 15) -> DataFrame:
    """Means over the latest rounds: failed, valid, silent annotators and the smallest open need."""
    return latest_rounds(rounds).withColumn("open", _open_items(threshold, max_votes)).agg(
        F.count(F.lit(1)).alias("n_studies"),
        F.avg(F.size(F.array_except("participated", "valid"))).alias("mean_failed"),
        F.avg(F.size("valid")).alias("mean_valid"),
        F.avg(F.size(F.array_except("admitted", "participated"))).alias("mean_silent"),
        F.avg(F.array_min(F.transform("open", lambda x: x["need"]))).alias("mean_need"))


def cumulate_votes(items: DataFrame) -> DataFrame:
    """Votes of an item over the versions of its study: ``study, qid, version`` (INT) ``, yes, n``."""
    run = Ordered(items, ["study", "qid"], ["version"]).running(cum_yes=F.col("yes"), cum_n=F.col("n"))
    return run.result()


def carry_votes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Adds the votes the previous version of the same study had gathered for the item."""
    before = previous.select("study", "qid", (F.col("version") + 1).alias("version"),
                             F.col("yes").alias("yes0"), F.col("n").alias("n0"))
    return current.join(before, ["study", "qid", "version"], "left").select(
        "study", "qid", "version", (F.col("yes") + F.coalesce("yes0", F.lit(0))).alias("yes"),
        (F.col("n") + F.coalesce("n0", F.lit(0))).alias("n"))


def rerun_plan(rounds: DataFrame, threshold: float = 0.8, max_votes: int = 15) -> DataFrame:
    """Latest rounds with their open items, smallest need and remaining annotators.

    ``next_study`` / ``next_version`` leave out merged members without an open item and are empty
    for rounds that are done; ``closed_version`` marks finished members with LAST.
    """
    latest = latest_rounds(rounds).withColumn("open", _open_items(threshold, max_votes)).select(
        "study", "version", F.array_sort(F.transform("open", lambda x: x["qid"])).alias("open_qids"),
        F.array_min(F.transform("open", lambda x: x["need"])).alias("places"),
        F.array_except("admitted", "participated").alias("remaining"))
    original = rounds.where("version = '0'").select(F.col("study").alias("name"), "qids")
    parts = F.arrays_zip(F.split("study", r"\|").alias("name"), F.split("version", r"\|").alias("ver"))
    members = latest.select("*", F.posexplode(parts).alias("seat", "m")).select("*", "m.name", "m.ver").drop("m")
    alive = F.coalesce(F.arrays_overlap("qids", "open_qids"), F.lit(False))
    # One row per member of a merged study, so the groups are as small as the merge.
    rows = members.join(original, "name", "left").groupBy("study", "version").agg(
        F.any_value("open_qids").alias("open_qids"), F.any_value("places").alias("places"),
        F.any_value("remaining").alias("remaining"),
        F.array_sort(F.collect_list(F.struct("seat", "name", "ver", alive.alias("alive")))).alias("m"))
    live = F.filter("m", lambda x: x["alive"])
    closed = F.array_join(F.transform("m", lambda x: F.when(x["alive"], x["ver"]).otherwise(F.lit("LAST"))), "|")
    return rows.select(
        "study", "version", "open_qids", "places", "remaining", closed.alias("closed_version"),
        F.array_join(F.transform(live, lambda x: x["name"]), "|").alias("next_study"),
        F.array_join(F.transform(live, lambda x: x["ver"]), "|").alias("next_version"))


def study_candidates(studies: DataFrame, capacity: DataFrame, history: DataFrame) -> DataFrame:
    """For each study the ``places`` annotators with most room that have not met its items.

    ``studies`` has ``study, places, n_items``, ``capacity`` has ``annotator, room``.  Among the first
    places + |history| annotators by room at least ``places`` are outside the history, so only those
    ranks are looked up; no study meets all annotators.
    """
    ranked = row_numbers(capacity.where("room > 0").withColumn("__r", -F.col("room")), [], ["__r", "annotator"], "rank")
    seen = history.groupBy("study").agg(F.count_distinct("annotator").alias("h"))
    slots = studies.join(seen, "study", "left").select(
        "study", "places", "n_items",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("places") + F.coalesce("h", F.lit(0)))).alias("rank"))
    free = slots.join(ranked, "rank").where(F.col("room") > F.col("n_items")).join(
        history, ["study", "annotator"], "left_anti")
    win = Window.partitionBy("study").orderBy("rank")
    return free.withColumn("nth", F.row_number().over(win)).where(F.col("nth") <= F.col("places")).select(
        "study", "nth", "annotator", "room")


def round_robin(annotators: DataFrame, studies: DataFrame, groups: int) -> DataFrame:
    """Group number of every annotator (i mod g) and study (j mod g): ``kind, id, grp``.

    The annotators of a group get the studies of the same group.  The group number is the whole
    assignment, so the pairs are not written out.
    """
    a = row_numbers(annotators.select("annotator"), [], ["annotator"], "i").select(
        F.lit("annotator").alias("kind"), F.col("annotator").cast("string").alias("id"),
        ((F.col("i") - 1) % groups).alias("grp"))
    s = row_numbers(studies.select("study"), [], ["study"], "i").select(
        F.lit("study").alias("kind"), F.col("study").cast("string").alias("id"), ((F.col("i") - 1) % groups).alias("grp"))
    return a.unionByName(s)


def _packing_segments(histogram: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """First-fit decreasing over size classes: (size, from rank, to rank, first bin, items per bin).

    Equal sizes fill the bins in order, so a stretch of bins with the same room is one entry; the
    entries grow with the number of sizes, not with the number of groups.
    """
    bins: list[list[int]] = []  # first bin, number of bins, room
    total, out = 0, []
    for size in sorted(histogram, reverse=True):
        left, done, after = histogram[size], 0, []

        def put(first: int, per: int, count: int) -> None:
            nonlocal left, done
            out.append((size, done, done + count, first, per))
            done, left = done + count, left - count

        for first, many, room in bins:
            fits = (left if room >= 0 else 0) if size == 0 else max(0, room) // size
            if not fits or not left:
                after.append([first, many, room])
                continue
            full = min(many, left // fits)
            if full:
                put(first, fits, full * fits)
                after.append([first, full, room - fits * size])
            if full < many:
                if left:
                    part = left
                    put(first + full, part, part)
                    after.append([first + full, 1, room - part * size])
                    full += 1
                if full < many:
                    after.append([first + full, many - full, room])
        if left:
            fits = left if size == 0 else max(1, length // size)
            full, part = divmod(left, fits)
            put(total, fits, left)
            if full:
                after.append([total, full, length - fits * size])
            if part:
                after.append([total + full, 1, length - part * size])
            total += full + (1 if part else 0)
        bins = after
    return out


def pack_studies(groups: DataFrame, length: int = 10, order: str = "study") -> DataFrame:
    """Bin number per group (``study, size``) so that bins hold at most ``length`` items.

    First-fit decreasing needs only the number of groups per size (at most length + 2 numbers, as all
    sizes above ``length`` behave alike) and the rank of a group among those of its size.
    """
    sized = groups.withColumn("cls", F.least(F.col("size"), F.lit(length + 1)).cast("int"))
    histogram = {r["cls"]: r["n"] for r in sized.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not histogram or set(histogram) == {0} or min(histogram) >= length:
        return row_numbers(groups, [], [order], "bin").withColumn("bin", F.col("bin") - 1)
    segments = _packing_segments(histogram, length)
    ranked = row_numbers(sized.withColumn("__d", -F.col("size")), ["cls"], ["__d", order], "rank")
    table = groups.sparkSession.createDataFrame(segments, "s int, lo long, hi long, first long, per long")
    return ranked.join(F.broadcast(table), (F.col("cls") == F.col("s")) & (F.col("rank") - 1 >= F.col("lo")) & (
        F.col("rank") - 1 < F.col("hi"))).withColumn(
        "bin", F.col("first") + F.floor((F.col("rank") - 1 - F.col("lo")) / F.col("per"))).select(*groups.columns, "bin")


def merged_studies(packed: DataFrame) -> DataFrame:
    """One row per bin: names and next versions joined, items concatenated, fewest places.

    A bin holds at most ``length`` items, so the lists stay short.
    """
    win = F.struct(F.col("size") * -1, "study")
    rows = packed.groupBy("bin").agg(
        F.array_sort(F.collect_list(F.struct(win.alias("o"), "study", "version", "qids"))).alias("m"),
        F.min("places").alias("places"))
    return rows.select(
        "bin", F.array_join(F.transform("m", lambda x: x["study"]), "|").alias("study"),
        F.array_join(F.transform("m", lambda x: (x["version"].cast("int") + 1).cast("string")), "|").alias("version"),
        F.flatten(F.transform("m", lambda x: x["qids"])).alias("qids"), "places")


def append_rounds(rounds: DataFrame, new: DataFrame) -> DataFrame:
    """New rows at version 0 with empty lists unless given."""
    empty = F.array().cast("array<string>")
    defaults = {"version": F.lit("0"), "status": F.lit("INIT"), "admitted": empty, "participated": empty,
                "valid": empty}
    return rounds.unionByName(
        new.withColumns({c: v for c, v in defaults.items() if c not in new.columns}), allowMissingColumns=True)


def duration_stats(sessions: DataFrame, column: str = "seconds") -> DataFrame:
    secs = F.col(column).try_cast("double")
    row = sessions.agg(F.avg(secs).alias("mean"), F.stddev_samp(secs).alias("std"))
    return beside(row, exact_quantiles(sessions, secs, {"median": 0.5})).select("median", "mean", "std")


def pay_per_hour(submissions: DataFrame) -> DataFrame:
    """Mean and median hourly pay of approved submissions, and the studies that have any.

    ``reward`` and ``bonus`` are in the payout's smallest unit, scaled twice by 100.
    """
    approved = submissions.where("status = 'APPROVED'").withColumn("pph", (
        F.col("reward") + F.aggregate("bonus", F.lit(0.0), lambda a, x: a + x)) / 10000 / (F.col("secs") / 3600))
    row = approved.agg(F.count(F.lit(1)).alias("n"), F.avg("pph").alias("mean_pph"), F.count_distinct("study").alias("n_studies"))
    return beside(row, exact_quantiles(approved, F.col("pph"), {"median_pph": 0.5})).select(
        "n", "mean_pph", "median_pph", "n_studies")


def demographics(people: DataFrame, column: str,
                 sentinels: tuple[str, ...] = ("CONSENT_REVOKED", "DATA_EXPIRED")) -> DataFrame:
    """Value counts of a column without the sentinels."""
    return people.where(~F.col(column).isin(*sentinels)).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def describe_ages(people: DataFrame, column: str = "age") -> DataFrame:
    """Count, mean, deviation and quartiles of the numeric values; sentinels and other text drop out."""
    age = F.col(column).try_cast("double")
    row = people.agg(
        F.count(age).alias("n"), F.avg(age).alias("mean"), F.stddev_samp(age).alias("std"), F.min(age).alias("min"),
        F.max(age).alias("max"))
    quartiles = exact_quantiles(people, age, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return beside(row, quartiles).select("n", "mean", "std", "min", "q1", "median", "q3", "max")

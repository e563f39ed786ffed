"""(guest turn, host reply, next guest turn) pairs over runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.text import conversation_of, index_range, n_tokens, pair_id, position_of
from turnwise.operators.dialogue import Runs
from turnwise.session import cut_lineage

CHUNK = 4096
GRAM = 3  # letters by which phrases of one or two words are looked up
_AHEAD = ("first_pos", "last_pos", "n_utt", "first_tokens", "n_tokens", "texts")


def run_triples(runs: Runs) -> DataFrame:
    """Each guest run with the next host run and the next guest run.

    In ordinary conversations the windows reuse the shuffle by conversation.  When one is spread
    over tasks, they go by blocks of CHUNK runs, each block with the two runs that follow it.
    """
    table = runs.table
    if runs.split:
        totals = table.groupBy("conv").agg((F.max("run") + 1).alias("n_runs"))
        block = F.floor(F.col("run") / CHUNK)
        own = F.struct(block.alias("block"), F.lit(True).alias("own"))
        halo = F.struct((block - 1).alias("block"), F.lit(False).alias("own"))
        table = table.withColumn("b", F.explode(
            F.when((F.col("run") % CHUNK < 2) & (block > 0), F.array(own, halo)).otherwise(F.array(own))))
        table = table.select("*", "b.block", "b.own").drop("b").join(totals, "conv")
        win = Window.partitionBy("conv", "block").orderBy("run")
    else:
        win = Window.partitionBy("conv").orderBy("run")
        table = table.withColumn("own", F.lit(True)).withColumn(
            "n_runs", F.max("run").over(Window.partitionBy("conv")) + 1)
    ahead = {}
    for name in _AHEAD:
        ahead[f"host_{name}"] = F.lead(name, 1).over(win)
        ahead[f"reply_{name}"] = F.lead(name, 2).over(win)
    return table.withColumns(ahead).where((F.col("run") % 2 == 1) & F.col("own")).drop("own", "block")


def _judgement(min_host_runs: int, min_tokens: int, strict: bool) -> Column:
    guest_ok = (F.col("n_utt") > 1) | (F.col("first_tokens") > min_tokens)
    host_ok = (F.col("host_n_utt") > 1) | (F.col("host_first_tokens") > min_tokens)
    kept = (guest_ok & host_ok) if strict else ((F.col("n_utt") > 1) | (guest_ok & host_ok))
    return F.when(F.col("n_host_runs") < min_host_runs, "short_dialogue") \
        .when(kept, "kept").when(~guest_ok, "short_guest").otherwise("short_host")


def judged_pairs(runs: Runs, min_host_runs: int = 5, drop_first: int = 1, drop_last: int = 2,
                 min_tokens: int = 2, strict: bool = False) -> DataFrame:
    """Every candidate pair with the reason it is kept or dropped for.

    By default a guest turn of several utterances skips the length test of the host; ``strict``
    tests both sides always.
    """
    rows = run_triples(runs).withColumns({
        "rank": ((F.col("run") - 1) / 2).cast("long"),
        "n_guest_runs": F.floor(F.col("n_runs") / 2),
        "n_host_runs": F.floor((F.col("n_runs") + 1) / 2),
    })
    rows = rows.where(
        (F.col("rank") >= drop_first) & (F.col("rank") < F.col("n_guest_runs") - drop_last)
        & F.col("reply_first_pos").isNotNull())
    return rows.withColumn("verdict", _judgement(min_host_runs, min_tokens, strict))


def extract_pairs(runs: Runs, **thresholds) -> DataFrame:
    """Kept pairs with positions (stop exclusive) and utterance arrays."""
    rows = judged_pairs(runs, **thresholds).where("verdict = 'kept'")
    return rows.select(
        pair_id("conv", F.col("first_pos")).alias("qid"), "conv", F.col("first_pos").alias("guest_pos"),
        "host", "guest",
        (F.col("last_pos") + 1).alias("guest_stop"), (F.col("host_last_pos") + 1).alias("host_stop"),
        (F.col("reply_last_pos") + 1).alias("reply_stop"),
        F.col("n_tokens").alias("guest_tokens"), F.col("host_n_tokens").alias("host_tokens"),
        F.col("texts").alias("guest_utts"), F.col("host_texts").alias("host_utts"),
        F.col("reply_texts").alias("reply_utts"))


def pair_positions(pairs: DataFrame) -> DataFrame:
    """The id table: position arrays instead of texts."""
    return pairs.select(
        "qid", "conv", "guest_pos",
        index_range("guest_pos", "guest_stop").alias("guest_idx"),
        index_range("guest_stop", "host_stop").alias("host_idx"),
        index_range("host_stop", "reply_stop").alias("reply_idx"))


def pair_texts(pairs: DataFrame, sep: str = "\n") -> DataFrame:
    return pairs.select(
        "qid", "conv", "guest_pos",
        F.array_join("guest_utts", sep).alias("guest_text"),
        F.array_join("host_utts", sep).alias("host_text"),
        F.array_join("reply_utts", sep).alias("reply_text"))


def rejects_by_source(runs: Runs, roles: DataFrame, marker: str = "NPR", **thresholds) -> DataFrame:
    """What each filter removed, split by the source in the conversation id."""
    source = F.when(F.contains(F.col("conv").cast("string"), F.lit(marker)), marker).otherwise("other")
    by_conv = roles.where("NOT two_speakers").groupBy(source.alias("source")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("not_two_speakers"))
    short = runs.table.groupBy("conv").agg(F.floor((F.max("run") + 2) / 2).alias("hosts")).where(
        F.col("hosts") < thresholds.get("min_host_runs", 5)).groupBy(source.alias("source")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("short_dialogue"))
    by_pair = judged_pairs(runs, **thresholds).where("verdict <> 'short_dialogue'").groupBy(
        source.alias("source"), F.col("verdict").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    cols = ["source", "reason", "n"]
    return by_conv.select(cols).union(short.select(cols)).union(by_pair.select(cols))


def rebuild_texts(positions: DataFrame, utterances: DataFrame, sep: str = " \n") -> DataFrame:
    """Texts of stored pairs, looked up by position.

    One equi-join on (conv, pos) for all pairs and sides together.
    """
    sides = positions.select("qid", "conv", F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"{s}_idx").alias("idx")) for s in ("guest", "host", "reply")
    ])).alias("x")).select("qid", "conv", "x.side", F.explode("x.idx").alias("pos"))
    found = sides.join(utterances.select("conv", "pos", "text"), ["conv", "pos"], "left")

    def side(name: str) -> Column:
        picked = F.collect_list(F.when(F.col("side") == name, F.struct("pos", F.coalesce("text", F.lit("")).alias("t"))))
        return F.array_join(F.transform(F.array_sort(picked), lambda u: u["t"]), sep).alias(f"{name}_text")

    return found.groupBy("qid").agg(side("guest"), side("host"), side("reply"))


def with_context(texts: DataFrame, conversations: DataFrame, columns: tuple[str, ...] = ("summary", "date")) -> DataFrame:
    """Pair texts with facts of their conversation (``id`` and ``columns``), joined once for all pairs."""
    facts = conversations.select(F.col("id").alias("conv"), *columns)
    return texts.withColumn("conv", conversation_of("qid")).join(facts, "conv").drop("conv")


def resolve_pair_ids(qids: DataFrame, runs: Runs) -> DataFrame:
    """Positions of pair ids (``qid``); an id without a closing turn gets ``resolved = false``."""
    wanted = qids.select("qid", conversation_of("qid").alias("conv"), position_of("qid").alias("pos"))
    placed = wanted.join(
        runs.utterances.select(F.col("conv").cast("string").alias("conv"), "pos", "run"), ["conv", "pos"], "left")
    ends = runs.table.select(F.col("conv").cast("string").alias("conv"), "run", (F.col("last_pos") + 1).alias("stop"))
    host = ends.select("conv", (F.col("run") - 1).alias("run"), F.col("stop").alias("host_stop"))
    back = ends.select("conv", (F.col("run") - 2).alias("run"), F.lit(True).alias("closed"))
    return placed.join(ends, ["conv", "run"], "left").join(host, ["conv", "run"], "left").join(
        back, ["conv", "run"], "left").select(
        "qid", "conv", F.col("pos").alias("guest_pos"), F.col("stop").alias("guest_stop"), "host_stop",
        (F.coalesce("closed", F.lit(False)) & (F.col("run") % 2 == 1)).alias("resolved"))


def capped_pairs(texts: DataFrame, max_tokens: int = 200, per_conv: int = 5, blanks: str = "single") -> DataFrame:
    """First usable pairs of each conversation; pairs with a side above the token cap do not count."""
    usable = texts.where((n_tokens("guest_text", blanks) <= max_tokens) & (n_tokens("host_text", blanks) <= max_tokens))
    win = Window.partitionBy("conv").orderBy("guest_pos")
    return usable.withColumn("nth", F.row_number().over(win)).where(F.col("nth") <= per_conv)


def source_counts(qids: DataFrame) -> DataFrame:
    """Interviews and pairs, in total and by source."""
    source = F.when(F.contains("qid", F.lit("NPR")), "NPR").when(F.contains("qid", F.lit("CNN")), "CNN") \
        .otherwise("other")
    rows = qids.select("qid", conversation_of("qid").alias("conv"), source.alias("source"))
    return rows.rollup("source").agg(
        F.count_distinct("conv").alias("n_conversations"), F.count_distinct("qid").alias("n_pairs")
    ).withColumn("source", F.coalesce("source", F.lit("all")))


def phrase_candidates(texts: DataFrame, phrases: DataFrame, key: str, column: str) -> DataFrame:
    """``key`` and ``phrase`` of the texts that hold the rarest inner word of a phrase, or one of its parts if it has none.

    Words are what stands between white space.  All words of a phrase but the first and the last are whole words of any
    text that holds it.  A phrase of one or two words is looked up by its rarest run of up to ``GRAM`` letters.
    """
    def inner(name):
        words = F.split(name, r"\s+")
        return F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))

    def grams(name):
        size = F.least(F.length(name), F.lit(GRAM))
        return F.when(F.length(name) == 0, F.array(F.lit(""))).otherwise(F.transform(
            F.sequence(F.lit(1), F.length(name) - size + 1), lambda i: F.substring(F.col(name), i, size)))

    def of_texts(size: int):
        """All runs of ``size`` letters; the empty one is in every text."""
        if not size:
            return F.array(F.lit(""))
        return F.when(F.length(column) >= size, F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.length(column) - size + 1), lambda i: F.substring(F.col(column), i, F.lit(size)))))

    wanted = phrases.select("phrase").where("phrase IS NOT NULL").distinct()
    long = wanted.withColumn("parts", inner("phrase")).where(F.size("parts") > 0).withColumn("kind", F.lit(-1))
    short = wanted.where(F.size(inner("phrase")) == 0).withColumn("parts", grams("phrase")).withColumn(
        "kind", F.least(F.length("phrase"), F.lit(GRAM)))
    keys = cut_lineage(long.unionByName(short).select("phrase", "kind", F.explode(F.array_distinct("parts")).alias("part")))
    kinds = sorted(r["kind"] for r in keys.select("kind").distinct().collect())  # at most GRAM + 2
    rows = [texts.select(key, F.lit(kind).alias("kind"), F.explode(
        F.array_distinct(F.split(column, r"\s+")) if kind < 0 else of_texts(kind)).alias("part")) for kind in kinds]
    if not rows:
        return texts.select(key, F.lit("").alias("phrase")).limit(0)
    # Only parts of phrases are kept of the texts; a phrase with a part that is in no text is in none.
    found = cut_lineage(reduce(DataFrame.unionByName, rows).join(keys.select("kind", "part").distinct(), ["kind", "part"], "left_semi"))
    often = found.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("texts"))
    rarest = keys.join(often, ["kind", "part"], "left").groupBy("phrase", "kind").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "part")).alias("r")).where("r.texts > 0").select(
            "phrase", "kind", "r.part")
    return found.join(rarest, ["kind", "part"]).select(key, "phrase").distinct()


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str = "qid", column: str = "guest_text") -> DataFrame:
    """``key`` and ``phrase`` for all phrases (a table with ``phrase``) that are in a text, letter by letter."""
    candidates = phrase_candidates(texts, phrases, key, column)
    named = texts.select(F.col(key).alias("__key"), F.col(column).alias("__text"))
    held = candidates.join(named, F.col(key).eqNullSafe(F.col("__key"))).where(F.contains("__text", "phrase"))
    return held.select(key, "phrase").distinct()


def search_texts(texts: DataFrame, phrases: DataFrame | list[str], column: str = "guest_text", key: str = "qid") -> DataFrame:
    """Rows whose text holds any of the phrases, a list or a table with ``phrase``.

    Phrases are looked up by a word or a part in common, so the plan does not grow with them.
    """
    if isinstance(phrases, list):
        phrases = texts.sparkSession.createDataFrame([(p,) for p in phrases], "phrase string")
    found = phrase_candidates(texts, phrases, key, column).select(F.col(key).alias("__key"), F.col("phrase").alias("__phrase"))
    return texts.join(found, F.col(key).eqNullSafe(F.col("__key")) & F.contains(column, "__phrase"), "left_semi")

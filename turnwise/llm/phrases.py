"""Phrase collocations by best-first branch-and-bound growth.

A phrase grows word by word from its first word.  Its score is that of its weakest cut, so it is at most that
of the cut behind its first word, 1000 * a * n / (f(first) * r), and since the rest of a phrase occurs at
least as often as the phrase (r >= a) every phrase that grows from a first word scores 1000 * n / f(first) at
most.  That bound is known before anything grows.  First words are expanded in the order of their bounds, the
rarest first, a part of the frontier at a time; what a language's scores show (the ``top``th score of the
phrases that survive) closes all first words whose bound is below it.  A bound equal to it stays open, for ties.

The texts are encoded once: a 64-bit hash for each word (of its language and spelling; that no two words
share one is checked), 0 for a break.  Growth by a word is one pass over the codes: a phrase is counted
where it starts with a phrase that was frequent, and its last word is frequent.  Which ones were frequent is told by bit
tables of fixed size that are made by Spark's bitmap aggregates; a bit that is set for nothing only costs a count,
since counts are exact and are compared with the limit afterwards.  Counts are combined in the task, then by
Spark.  Each phrase carries the least and largest code next to it on both sides: if they are equal and no
break, a longer phrase occurs as often.  The rests of phrases, which may start with words that were never
expanded, are counted by one more pass.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import count as counting

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.base import query, table
from turnwise.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONGEST = 5
LEAST = 100
TOP = 2_000
BITS = 24  # of the places in a bit table: 2 MB each, whatever the data
BUCKET = 15  # bits of a place within a bucket of Spark's bitmap aggregate
SHARES = (1 / 8, 1.0)  # of a language's words that are expanded while no score closes any
HELD = 1 << 18  # codes that a task counts at a time
TALLY = 1 << 19  # words whose counts a task adds up before it passes them on
ROW = 1 << 7  # codes in a stored row: Arrow batches have 10,000 rows, so about 10 MB
KEPT_WORDS = 100_000  # spellings that a task holds
ENCODED = "lang string, codes binary, n long"
SPELLED = "key long, phrase binary, lang string, word string"
COUNTED = "phrase binary, key long, n long, before_min long, before_max long, after_min long, after_max long"

BREAKS, BLANKS, BREAK = b".,;:!?\n\x0b\x0c\r", b" \t", b"\xff"  # no byte of UTF-8 is 0xff
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + BREAKS, b"abcdefghijklmnopqrstuvwxyz" + BREAK * len(BREAKS))


# -- encoding -------------------------------------------------------------------------------------


def word_code(word: bytes, seed: int) -> int:
    """Never 0, which is the code of a break."""
    return xxhash.xxh64_intdigest(word, seed) or 1


class Codes(dict):
    """Codes of the words of a language that were met; words whose code is in ``wanted`` are listed."""

    def __init__(self, lang: str, seed: int, wanted: "BitTable | None" = None):
        super().__init__({BREAK: 0})
        self.lang, self.seed, self.wanted, self.listed = f"{lang}\0".encode("utf-8", "surrogatepass"), seed, wanted, []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = word_code(self.lang + word, self.seed)
        if self.wanted is not None and self.wanted.has_one(code):
            self.listed.append((code, word))
        return code


def words_at_a_time(text: str | None, at_once: int) -> Iterator[list[bytes]]:
    """The words of a text and its breaks, in parts; long texts are cut where a word ends."""
    data, start = (text or "").encode("utf-8", "surrogatepass").translate(PLAIN), 0
    while start < len(data):
        stop = min((p for p in (data.find(c, start + at_once) for c in (b" ", b"\t", BREAK)) if p >= 0), default=len(data))
        yield data[start:stop].replace(BREAK, b" \xff ").split()
        start = stop


def encode(text: str | None, codes: Codes, at_once: int = 1 << 22) -> np.ndarray:
    """The code of each word, 0 at breaks (one or more) and at the end."""
    parts = [np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)) for words in words_at_a_time(text, at_once)]
    return np.concatenate([*parts, np.zeros(1, np.uint64)])


def at_breaks(codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Parts of about ``size`` codes that end with a break."""
    breaks, start = np.flatnonzero(codes == 0), 0
    while start < len(codes):
        at = np.searchsorted(breaks, start + size)
        stop = int(breaks[at]) + 1 if at < len(breaks) else len(codes)
        yield codes[start:stop]
        start = stop


def fixed_binary(values: np.ndarray, width: int) -> pa.Array:
    """Rows of ``width`` bytes as binary values."""
    return pa.Array.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def cache_of(caches: dict, lang: str, *how) -> Codes:
    """The codes of a language in a task; all start anew when they hold too many words."""
    if sum(map(len, caches.values())) > KEPT_WORDS:
        for own in caches.values():
            own.clear()
            own[BREAK] = 0
    return caches[lang] if lang in caches else caches.setdefault(lang, Codes(lang, *how))


def encode_task(seed: int):
    """Task function: (lang, text) to rows of codes, many texts of a language in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches, parts, held = {}, {}, 0

        def rows() -> pa.RecordBatch:
            found = [(lang, part) for lang, own in parts.items() for part in at_breaks(np.concatenate(own), ROW)]
            return pa.RecordBatch.from_arrays([
                pa.array([lang for lang, _ in found]), pa.array([part.tobytes() for _, part in found], pa.binary()),
                pa.array([int(np.count_nonzero(part)) for _, part in found], pa.int64())], names=["lang", "codes", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                part = encode(text.as_py(), cache_of(caches, lang, seed))
                parts.setdefault(lang, []).append(part)
                held += len(part)
                if held > HELD:
                    yield rows()
                    parts, held = {}, 0
        if parts:
            yield rows()
    return run


def word_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: rows of codes to codes with their counts, added up over as many rows as a task can hold."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counted() -> pa.RecordBatch:
        some = keys != 0
        return pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(counts[some])], names=["key", "n"])

    for codes in held_codes(batches):
        new, number = np.unique(codes, return_counts=True)
        every, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, number]), len(every)).astype(np.int64)
        keys = every
        if len(keys) > TALLY:
            yield counted()
            keys, counts = keys[:0], counts[:0]
    yield counted()


def spell_task(seed: int, wanted):
    """Task function: (lang, text) to the spellings of words whose code is in a bit table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches, bits, told = {}, BitTable(wanted.value), set()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                own = cache_of(caches, lang, seed, bits)
                for words in words_at_a_time(text.as_py(), 1 << 22):
                    for word in set(words):
                        own[word]
            new = [(code, lang, word) for lang, own in caches.items() for code, word in own.listed if (lang, word) not in told]
            for own in caches.values():
                own.listed = []
            told |= {(lang, word) for _, lang, word in new}
            if new:
                keys = np.array([code for code, _, _ in new], np.uint64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.view(np.int64)), fixed_binary(keys, 8), pa.array([lang for _, lang, _ in new]),
                    pa.array([word.decode("utf-8", "replace") for _, _, word in new])], names=["key", "phrase", "lang", "word"])
    return run


# -- counting -------------------------------------------------------------------------------------


class BitTable:
    """A set of hashes, with some more: the first bits of a hash are its place."""

    def __init__(self, data: bytes):
        self.bits = np.frombuffer(data, np.uint8)
        self.shift = np.uint64(64 - (8 * len(data)).bit_length() + 1)

    def has_one(self, key: int) -> bool:
        place = key >> int(self.shift)
        return bool(self.bits[place >> 3] >> (place & 7) & 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> self.shift
        return (self.bits[(place >> np.uint64(3)).astype(np.intp)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def longer(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ words
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def tally(codes: np.ndarray, at: np.ndarray, keys: np.ndarray, size: int) -> pa.RecordBatch:
    """Phrases of ``size`` words that start ``at`` (a break must precede and follow all codes): counts and neighbours."""
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    before, after = codes[at - 1].view(np.int64), codes[at + size].view(np.int64)
    columns = {
        "phrase": fixed_binary(codes[at[first][:, None] + np.arange(size)], 8 * size), "key": keys[first].view(np.int64),
        "n": np.diff(np.append(first, len(keys))), "before_min": np.minimum.reduceat(before, first),
        "before_max": np.maximum.reduceat(before, first), "after_min": np.minimum.reduceat(after, first),
        "after_max": np.maximum.reduceat(after, first)}
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def grown(codes: np.ndarray, size: int, tables: dict[int, BitTable], frequent: BitTable) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of phrases of ``size`` words whose first 1, 2, ... words are in ``tables``, the last in ``frequent``."""
    at = np.flatnonzero(tables[1].has(codes) & (codes != 0))
    keys = codes[at]
    for k in range(1, size):
        words = codes[at + k]
        fits = (words != 0) & frequent.has(words)
        at, keys = at[fits], longer(keys[fits], words[fits])
        if k + 1 < size:
            fits = tables[k + 1].has(keys)
            at, keys = at[fits], keys[fits]
    return at, keys


def listed(codes: np.ndarray, tables: dict[int, BitTable]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and hashes of phrases that are in the table of their length; ``tables[1]`` has their first words."""
    at = np.flatnonzero(tables[1].has(codes) & (codes != 0))
    keys = codes[at]
    for size in range(2, max(tables) + 1):
        words = codes[at + size - 1]
        at, keys = at[words != 0], longer(keys[words != 0], words[words != 0])
        if size in tables:
            fits = tables[size].has(keys)
            yield size, at[fits], keys[fits]


def count_task(tables, frequent=None, size: int | None = None):
    """Task function: codes to the phrases that grow to ``size`` words, or (no ``size``) to those that are listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: BitTable(t.value) for k, t in tables.items()}
        last = BitTable(frequent.value) if frequent is not None else None
        for held in held_codes(batches):
            codes = np.concatenate([np.zeros(1, np.uint64), held, np.zeros(LONGEST, np.uint64)])
            found = [(size, *grown(codes, size, bits, last))] if size else listed(codes, bits)
            for length, at, keys in found:
                if len(at):
                    yield tally(codes, at, keys, length)

    return run


def held_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The codes of a batch, some rows at a time: a row ends with a break, so its codes may be cut at any."""
    for batch in batches:
        rows = batch.column("codes")
        if len(rows):
            at = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset:rows.offset + len(rows) + 1]
            codes = np.frombuffer(rows.buffers()[2], np.uint8)[at[0]:at[-1]].view(np.uint64)
            yield from at_breaks(codes, HELD)


def combined(counts: DataFrame, least: int) -> DataFrame:
    """The phrases with ``least`` or more occurrences, stored."""
    return cut_lineage(counts.groupBy("phrase").agg(
        F.sum("n").alias("n"), F.max("key").alias("key"), F.min("before_min").alias("before_min"), F.max("before_max").alias("before_max"),
        F.min("after_min").alias("after_min"), F.max("after_max").alias("after_max")).where(F.col("n") >= least))


def bit_table(keys: DataFrame, bits: int):
    """A broadcast bit table of the ``key`` column: 2 ** bits / 8 bytes, put together from aggregated buckets."""
    place = F.call_function("shiftrightunsigned", F.col("key"), F.lit(64 - bits))
    buckets = keys.select(F.shiftright(place, BUCKET).alias("bucket"), place.bitwiseAND((1 << BUCKET) - 1).alias("bit")).groupBy(
        "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    size = 1 << (BUCKET - 3)
    data = bytearray(1 << (bits - 3))
    for row in buckets.collect():  # 4 KB each, no more than the table has room for
        data[row.bucket * size:(row.bucket + 1) * size] = row.bitmap
    return keys.sparkSession.sparkContext.broadcast(bytes(data))


# -- scores ---------------------------------------------------------------------------------------


def words_in(phrase: Column) -> Column:
    return (F.octet_length(phrase) / 8).cast("int")


def scored(found: DataFrame, rests: DataFrame, words: DataFrame, langs: DataFrame) -> DataFrame:
    """``phrase``, ``lang``, ``a``, ``l``, ``r``, ``n`` and ``score`` (of the weakest cut) of each phrase found."""
    wide = "decimal(38,0)"
    counts = words.select("phrase", "n").unionByName(found.select("phrase", "n")).unionByName(rests.select("phrase", "n"))
    cuts = found.select("phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), words_in(F.col("phrase")) - 1)).alias("k")).select(
        "phrase", "a", "k", F.expr("substring(phrase, 1, 8)").alias("first"), F.expr("substring(phrase, 1, 8 * k)").alias("left"),
        F.expr("substring(phrase, 8 * k + 1)").alias("right"))
    cuts = cuts.join(counts.select(F.col("phrase").alias("left"), F.col("n").alias("l")), "left").join(
        counts.select(F.col("phrase").alias("right"), F.col("n").alias("r")), "right")
    cuts = cuts.join(words.select(F.col("phrase").alias("first"), "lang"), "first").join(langs.select("lang", F.col("n").alias("n")), "lang")
    score = F.expr(f"(CAST(1000 AS {wide}) * CAST(a AS {wide}) * CAST(n AS {wide})) div (CAST(l AS {wide}) * CAST(r AS {wide}))")
    return cuts.withColumn("score", score).groupBy("phrase").agg(
        F.min(F.struct("score", "k", "lang", "a", "l", "r", "n")).alias("cut")).select("phrase", "cut.*").drop("k")


def surviving() -> Column:
    """Not inside a longer phrase that occurs as often: the words next to it differ, or there is none."""
    def always_same(side: str) -> Column:
        return (F.col(f"{side}_min") == F.col(f"{side}_max")) & (F.col(f"{side}_min") != 0)
    return (words_in(F.col("phrase")) == LONGEST) | ~(always_same("before") | always_same("after"))


def bound(langs_n: str, frequency: str) -> Column:
    wide = "decimal(38,0)"
    return F.expr(f"(CAST(1000 AS {wide}) * CAST({langs_n} AS {wide})) div CAST({frequency} AS {wide})")


def first_limits(words: DataFrame, langs: DataFrame, share: float) -> DataFrame:
    """``lang``, ``upto``: words up to this frequency make up about ``share`` of a language; at least the rarest class does."""
    classes = words.withColumn("upto", F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1).groupBy("lang", "upto").agg(F.sum("n").alias("words"))
    running = Window.partitionBy("lang").orderBy("upto")
    classes = classes.withColumn("words", F.sum("words").over(running)).withColumn("place", F.row_number().over(running))
    return classes.join(langs, "lang").where((F.col("words") <= F.col("n") * share) | (F.col("place") == 1) | F.lit(share >= 1)).groupBy(
        "lang").agg(F.max("upto").cast("long").alias("upto"))


def encoded(docs: DataFrame, lang: str, text: str, least: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codes, frequent words (``phrase`` of one word, ``key``, ``lang``, ``word``, ``n``) and the words of each language (``n``), stored."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    for seed in counting():
        made = cut_lineage(rows.mapInArrow(encode_task(seed), ENCODED))
        codes = made.select("codes")
        counts = cut_lineage(codes.mapInArrow(word_task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(
            F.col("n") >= least))
        # Spellings are looked up for frequent words only, and each of them must have a code of its own.
        spelled = cut_lineage(rows.mapInArrow(spell_task(seed, bit_table(counts, bits)), SPELLED).distinct().join(counts, "key"))
        if spelled.groupBy("key").count().where("count > 1").isEmpty():
            return codes, spelled, cut_lineage(made.groupBy("lang").agg(F.sum("n").alias("n")))


def mine_phrases(
    docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, bits: int = BITS,
    shares: tuple[float, ...] = SHARES,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of 2 to 5 words of each language.

    Phrases with ``least`` or more occurrences ``a`` inside pieces count; ``score`` is floor(1000 a n / (l r)) of the
    weakest cut into a first part (``l``) and a rest (``r``), ``n`` the words of the language.  Phrases inside a longer
    one that occurs as often are left out.  Higher scores come first, then larger ``a``, then the phrase by its bytes.

    Null texts have no words, null languages are ``und``; repeated rows count as often as they are there; an empty
    table gives an empty result; other columns are ignored.  Texts of any length are encoded some megabytes at
    a time; the words between two breaks are one value.  Counts and products are exact.
    """
    codes, words, langs = encoded(docs, lang, text, least, bits)
    frequent = bit_table(words, bits)
    found, rests, results = None, None, None
    done = cut_lineage(langs.select("lang", F.lit(0).cast("long").alias("upto"), F.lit(False).alias("closed")))
    for turn in counting():
        share = shares[min(turn, len(shares) - 1)]
        limits = first_limits(words, langs, share).withColumnRenamed("upto", "by_share")
        if results is not None:
            kth = results.where(F.col("place") == top).select("lang", F.col("score").alias("kth"))
            open_ = words.join(kth, "lang").join(langs.select("lang", F.col("n").alias("all")), "lang").where(
                bound("all", "n") >= F.col("kth")).groupBy("lang").agg(F.max("n").alias("by_score"))
            limits = limits.join(kth, "lang", "left").join(open_, "lang", "left").withColumn(
                "by_share", F.when(F.col("kth").isNull(), F.col("by_share")).otherwise(F.coalesce("by_score", F.lit(0)))).select("lang", "by_share")
        state = done.select("lang", F.col("upto").alias("from")).join(limits, "lang", "left").select(
            "lang", "from", F.greatest("from", F.coalesce("by_share", F.lit(0))).alias("upto"))
        state = cut_lineage(state)
        frontier = cut_lineage(words.join(state, "lang").where((F.col("n") > F.col("from")) & (F.col("n") <= F.col("upto"))).select("key", "phrase"))
        done = state
        if frontier.isEmpty():
            if turn >= len(shares) - 1 or results is None:
                break
            continue
        tables = {1: bit_table(frontier, bits)}
        levels = []
        for size in range(2, LONGEST + 1):
            level = combined(codes.mapInArrow(count_task(dict(tables), frequent, size), COUNTED), least)
            levels.append(level)
            if level.isEmpty():
                break
            if size < LONGEST:
                tables[size] = bit_table(level, bits)
        for level in levels:
            # A bit that stands for another phrase lets phrases through whose first word is not in this frontier.
            own = level.join(frontier.select(F.col("phrase").alias("first")), F.expr("substring(phrase, 1, 8) = first"), "left_semi")
            found = own if found is None else found.unionByName(own)
        found = cut_lineage(found)
        rests = cut_lineage(rest_counts(codes, found, bits))
        ranked = scored(found, rests, words, langs).join(found.where(surviving()).select("phrase"), "phrase", "left_semi")
        best = Window.partitionBy("lang").orderBy(F.col("score").desc())
        # Ties of the last place stay until their spelling is known.
        results = cut_lineage(ranked.withColumn("tied", F.rank().over(best.orderBy(F.col("score").desc(), F.col("a").desc()))).where(
            F.col("tied") <= top).withColumn("place", F.row_number().over(best)))
    if results is None:
        return docs.sparkSession.createDataFrame(
            [], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    return spelled(results, words, top)


def rest_counts(codes: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """Counts of the rests of two or more words of the phrases in ``found`` that are not in it themselves."""
    rests = found.where(words_in(F.col("phrase")) > 2).select(F.explode(F.transform(
        F.sequence(F.lit(1), words_in(F.col("phrase")) - 2), lambda k: F.substring("phrase", 8 * k + 1, 8 * LONGEST))).alias("phrase"))
    rests = cut_lineage(rests.distinct().join(found.select("phrase"), "phrase", "left_anti").mapInPandas(
        key_task, "phrase binary, key long, first long"))
    sizes = [r[0] for r in rests.select(words_in(F.col("phrase"))).distinct().collect()]
    if not sizes:
        return found.select("phrase", "n").limit(0)
    tables = {1: bit_table(rests.select(F.col("first").alias("key")), bits)}
    for size in sizes:
        tables[size] = bit_table(rests.where(words_in(F.col("phrase")) == size), bits)
    counts = codes.mapInArrow(count_task(tables), COUNTED)
    return counts.groupBy("phrase").agg(F.sum("n").alias("n")).join(rests.select("phrase"), "phrase", "left_semi")


def key_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task function: phrases to their hashes and those of their first words."""
    for batch in batches:
        keys, first = [], []
        for phrase in batch["phrase"]:
            words = np.frombuffer(phrase, np.uint64)
            key = words[:1]
            for k in range(1, len(words)):
                key = longer(key, words[k:k + 1])
            keys.append(key.view(np.int64)[0])
            first.append(words[:1].view(np.int64)[0])
        yield pd.DataFrame({"phrase": batch["phrase"], "key": np.array(keys, np.int64), "first": np.array(first, np.int64)})


def spelled(results: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language, with their words."""
    letters = results.select("phrase", F.explode(F.sequence(F.lit(0), words_in(F.col("phrase")) - 1)).alias("k")).select(
        "phrase", "k", F.expr("substring(phrase, 8 * k + 1, 8)").alias("one"))
    texts = letters.join(words.select(F.col("phrase").alias("one"), "word"), "one").groupBy("phrase").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "text")
    return results.join(texts, "phrase").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, piece FROM (
    SELECT lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
lists AS (SELECT id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
places AS (SELECT id, lang, words, unnest(range(1, len(words) + 1)) AS pos FROM lists),
grams AS (
  SELECT lang, array_to_string(list_slice(words, pos, pos + k - 1), ' ') AS phrase, k, count(*) AS f
  FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE pos + k - 1 <= len(words) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM grams WHERE f >= 100),
parts AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS w FROM frequent WHERE k > 1),
dropped AS (
  SELECT DISTINCT p.lang, p.phrase FROM parts p JOIN (
    SELECT lang, f, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
    FROM parts, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS m) WHERE m < k AND i + m - 1 <= k) inner_
  ON p.lang = inner_.lang AND p.phrase = inner_.phrase AND 100 * inner_.f >= 100 * p.f),
cuts AS (
  SELECT p.lang, p.phrase, p.f AS a, c, x.f AS l, y.f AS r, t.n,
    (1000::HUGEINT * p.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN (SELECT unnest(range(1, 5)) AS c) ON c < p.k
  JOIN frequent x ON x.lang = p.lang AND x.phrase = array_to_string(list_slice(p.w, 1, c), ' ') AND x.k = c
  JOIN frequent y ON y.lang = p.lang AND y.phrase = array_to_string(list_slice(p.w, c + 1, p.k), ' ') AND y.k = p.k - c
  JOIN totals t ON t.lang = p.lang),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM weakest ANTI JOIN dropped USING (lang, phrase)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))
QUALIFY row_number() OVER w <= 2000"""


@query("op13_collocations", SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))

"""When to stop collecting votes for an item.

All rules look at a bounded prefix of the votes of an item, so the first ``k`` votes are kept per
item (the limit runs before the shuffle too) and the running yes counts become one short array.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from hashlib import md5
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.measures import binary_entropy, col, kappa, majority, scaled_entropy, votes_needed
from turnwise.operators.agreement import CELLS, agreement_report
from turnwise.operators.votes import ORDER, first_votes, vote_tuples
from turnwise.session import cut_lineage

# Executors get task functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


DRAWS_PER_TASK = 5_000_000


def vote_prefixes(votes: DataFrame, k: int, order: list[str] = ORDER) -> DataFrame:
    """``item, n, vs, cum``: the first k votes and their running yes counts (n <= k)."""
    head = first_votes(votes.where(F.col("vote").isNotNull()), k, order)
    arrays = head.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("n"), F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "vote"))), lambda x: x["vote"].cast("int")).alias("vs"))
    return arrays.withColumn("cum", F.transform("vs", lambda v, i: F.aggregate(
        F.slice("vs", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x)))


def _first_rank(cum: Column, test, start: int = 1) -> Column:
    """Smallest 1-based rank >= start for which ``test(yes, rank)`` holds."""
    hits = F.filter(
        F.transform(cum, lambda c, i: F.when((i + 1 >= start) & test(c, i + 1), i + 1)), lambda r: r.isNotNull())
    return F.array_min(hits)


def need_stop(cum="cum", n="n", threshold: float = 0.8, max_votes: int = 15, min_votes: int = 3) -> Column:
    """First rank from ``min_votes`` on at which no further vote is needed, else all votes."""
    rank = _first_rank(col(cum), lambda c, r: votes_needed(c, r, threshold, max_votes, min_votes) <= 0, min_votes)
    return F.coalesce(rank, col(n))


def agreeing_stop(k: int, cum="cum", n="n") -> Column:
    """First rank at which one side has ``k`` votes, else all votes."""
    return F.coalesce(_first_rank(col(cum), lambda c, r: (c == k) | (r - c == k)), col(n))


def entropy_stop(threshold: float, max_votes: int = 10, min_votes: int = 3, scaled: bool = False,
                 cum="cum", n="n") -> Column:
    """First rank from ``min_votes`` to ``max_votes`` with entropy at or below the threshold."""
    def settled(c, r):
        h = scaled_entropy(c / r, r) if scaled else binary_entropy(c / r)
        return h <= threshold
    return F.coalesce(_first_rank(F.slice(col(cum), 1, max_votes), settled, min_votes),
                      F.least(col(n), F.lit(max_votes)))


def label_at(stop, cum="cum") -> Column:
    return majority(F.get(col(cum), col(stop) - 1) / col(stop))


def stop_points(votes: DataFrame, order: list[str] = ORDER, threshold: float = 0.8, max_votes: int = 15) -> DataFrame:
    """Votes ``n`` and dynamic stop per item; after ``max_votes`` votes nothing is needed, so that prefix decides."""
    stops = vote_prefixes(votes, max_votes, order).select(
        "item", need_stop(threshold=threshold, max_votes=max_votes).alias("stop"))
    counts = votes.groupBy("item").agg(F.count("vote").cast("int").alias("n"))
    return stops.join(counts, "item").select("item", "n", "stop")


def votes_until_stop(votes: DataFrame, order: list[str] = ORDER, threshold: float = 0.8,
                     max_votes: int = 15) -> DataFrame:
    """The votes (``item, annotator, vote, rank``) a dynamic recruitment would have collected.

    At most ``max_votes`` votes of an item are in its list, which is cut at the stop and spread again.
    """
    head = first_votes(votes.where(F.col("vote").isNotNull()), max_votes, order)
    lists = head.groupBy("item").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.array_sort(F.collect_list(F.struct("rank", F.col("vote").cast("int").alias("vote"), "annotator"))).alias("vs"))
    cum = F.transform("vs", lambda v, i: F.aggregate(
        F.slice("vs", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x["vote"]))
    stopped = lists.withColumn("cum", cum).withColumn("stop", need_stop(threshold=threshold, max_votes=max_votes))
    return stopped.select("item", F.inline(F.slice("vs", F.lit(1), F.col("stop")))).select(
        "item", "annotator", "vote", "rank")


def agreement_by_cut(votes: DataFrame, order: list[str] = ORDER, first: int = 3, threshold: float = 0.8,
                     max_votes: int = 15, min_shared: float = 1) -> DataFrame:
    """The agreement report on the first votes, on a simulated dynamic recruitment and on all votes."""
    votes = cut_lineage(votes)  # read by each cut and each pass
    cuts = {"first": (first_votes(votes, first, order), first),
            "dynamic": (votes_until_stop(votes, order, threshold, max_votes), max_votes), "all": (votes, None)}
    reports = [agreement_report(rows, name, min_shared, votes, most) for name, (rows, most) in cuts.items()]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


def _matrix(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as the rows of a matrix, padded with zeros, and their lengths."""
    length = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, length


def _cases(spark: SparkSession, k: int, tests: list) -> np.ndarray:
    """For each test a table over (rank, yes votes): whether it holds.  As many cases as prefixes of ``k`` votes have counts."""
    pairs = spark.createDataFrame([(r, c) for r in range(1, k + 1) for c in range(r + 1)], "r int, c int")
    rows = pairs.select("r", "c", F.array(*[test(F.col("c"), F.col("r")) for test in tests]).alias("holds")).collect()
    out = np.zeros((len(tests), k + 1, k + 1), bool)
    for row in rows:
        out[:, row["r"], row["c"]] = row["holds"]
    return out


def stop_task(cases: np.ndarray, starts: list[int], limits: list[int], names: list[str]):
    """Task function: ``cum`` and ``final`` of items to one row per rule: votes used, right labels, items.

    All items of a batch are looked up in the tables of the rules at once.
    """
    k = cases.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(names)), np.int64)
        rank = np.arange(1, k + 1)
        for batch in batches:
            cum, length = _matrix(batch.column("cum"), k)
            final = batch.column("final").to_numpy()
            for i, (start, limit) in enumerate(zip(starts, limits)):
                upto = np.minimum(length, limit)
                holds = cases[i][rank, cum] & (rank >= start) & (rank <= upto[:, None])
                stop = np.where(holds.any(axis=1), holds.argmax(axis=1) + 1, upto)
                yes = np.take_along_axis(cum, stop[:, None] - 1, axis=1)[:, 0]
                sums[:, i] += stop.sum(), ((2 * yes >= stop) == (final == 1)).sum(), len(stop)
        yield pa.RecordBatch.from_arrays([pa.array(names), *map(pa.array, sums)], names=["rule", "used", "right", "items"])
    return run


def stop_report(votes: DataFrame, order: list[str] = ORDER, agreeing: list[int] = (1, 2, 3, 4, 5),
                thresholds: list[float] = (0.5, 0.7, 0.8, 0.9), max_votes: int = 10, min_votes: int = 3,
                scaled_thresholds: list[float] = (0.2, 0.3, 0.4)) -> DataFrame:
    """Mean votes used and accuracy against the label of all votes, per rule and setting.

    Whether a rule stops depends on the rank and the yes votes only, so a rule is a small table; a task looks all
    its items up in all tables and reports one row per rule.
    """
    k = max([max_votes] + [2 * a - 1 for a in agreeing])
    rules = [(f"agree_{a}", lambda c, r, a=a: (c == a) | (r - c == a), 1, k) for a in agreeing]
    rules += [(f"entropy_{t}", lambda c, r, t=t: binary_entropy(c / r) <= t, min_votes, max_votes) for t in thresholds]
    rules += [(f"scaled_{t}", lambda c, r, t=t: scaled_entropy(c / r, r) <= t, min_votes, max_votes) for t in scaled_thresholds]
    names, tests, starts, limits = map(list, zip(*rules))
    final = vote_tuples(votes).select("item", majority("share").alias("final"))
    rows = vote_prefixes(votes, k, order).join(final, "item").select(F.col("cum").cast("array<bigint>").alias("cum"), "final")
    sums = rows.mapInArrow(
        stop_task(_cases(votes.sparkSession, k, tests), starts, limits, names), "rule string, used long, right long, items long")
    return sums.groupBy("rule").agg(F.sum("used").alias("used"), F.sum("right").alias("right"), F.sum("items").alias("items")).where(
        "items > 0").select("rule", (F.col("used") / F.col("items")).alias("mean_votes"), (F.col("right") / F.col("items")).alias("accuracy"))


def open_items(tallies: DataFrame, threshold: float = 0.8, max_votes: int = 15) -> DataFrame:
    """Items that want another round; ``tallies`` has ``study, item, yes, n``."""
    need = tallies.withColumn("need", votes_needed("yes", "n", threshold, max_votes))
    return need.where(F.col("need") > 0)


def smallest_need(tallies: DataFrame, threshold: float = 0.8, max_votes: int = 15) -> DataFrame:
    return open_items(tallies, threshold, max_votes).groupBy("study").agg(
        F.count(F.lit(1)).alias("n_open"), F.min("need").alias("places"))


_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
SHORT = 55  # bytes of a text that md5 digests in one block


def _md5_starts(words: dict[int, np.ndarray], shape: tuple) -> np.ndarray:
    """First 32 bits (big-endian) of the md5 of many padded blocks; ``words`` has those words that are not zero throughout."""
    a, b, c, d = first = [np.full(shape, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(_SINES[i])
        if g in words:
            f += words[g]
        turn = _TURNS[i // 16][i % 4]
        high = f >> np.uint32(32 - turn)
        f <<= np.uint32(turn)
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return (a + first[0]).byteswap()


def _words(texts: list[bytes], at: int = 0) -> np.ndarray:
    """Texts as rows of 16 words of a block, from byte ``at`` on."""
    return np.frombuffer(b"".join((bytes(at) + t).ljust(64, b"\0") for t in texts), "<u4").reshape(-1, 16).astype(np.uint32)


def draws(seed: int, items: list[bytes], replicates: int, n: int) -> np.ndarray:
    """First 32 bits of md5(seed|replicate|item|slot) for items of one length, as an array (item, replicate, slot)."""
    heads, tails = ([f"{seed}|{r}|".encode() for r in range(1, replicates + 1)], [f"|{j}".encode() for j in range(1, n + 1)])
    size = len(items[0])
    if len(heads[-1]) + size + len(tails[-1]) > SHORT:
        drawn = b"".join([md5(h + i + t).digest()[:4] for i in items for h in heads for t in tails])
        return np.frombuffer(drawn, ">u4").reshape(len(items), replicates, n).astype(np.uint32)
    lengths = np.array([len(h) for h in heads])
    head, item, tail = _words(heads), np.zeros((len(items), replicates, 16), np.uint32), np.zeros((replicates, n, 16), np.uint32)
    for at in np.unique(lengths).tolist():
        item[:, lengths == at] = _words(items, at)[:, None]
        ends = _words([t + b"\x80" for t in tails], at + size)
        ends[:, 14] = [8 * (at + size + len(t)) for t in tails]
        tail[lengths == at] = ends
    used = np.flatnonzero(head.any(axis=0) | item.any(axis=(0, 1)) | tail.any(axis=(0, 1)))
    words = {int(w): head[:, w][:, None] | item[:, :, w][:, :, None] | tail[:, :, w] for w in used}
    return _md5_starts(words, (len(items), replicates, n))


def bootstrap_task(n: int, replicates: int, seed: int, together: int = 8):
    """Task function: items with their votes to one row per (replicate, k): the cells of the labels of k resampled
    and of the first k votes, and how often the latter is that of all n.

    Items whose names have the same length are drawn for ``together``; running sums give the labels for all k.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n11, yes = np.zeros((replicates, n), np.int64), np.zeros((replicates, n), np.int64)
        first, items, right = (np.zeros(n, np.int64) for _ in range(3))
        rank = np.arange(1, n + 1)
        for batch in batches:
            votes, length = _matrix(batch.column("vs"), n)
            votes = votes.astype(np.int16)
            names = [f"{x}".encode() for x in batch.column("item").to_pylist()]
            order = sorted(range(len(names)), key=lambda i: len(names[i]))
            for start in range(0, len(order), together):
                for _, same in groupby(order[start:start + together], key=lambda i: len(names[i])):
                    at = list(same)
                    own, k = votes[at], length[at]
                    draw = draws(seed, [names[i] for i in at], replicates, n) % k[:, None, None].astype(np.uint32)
                    drawn = own[np.arange(len(at))[:, None, None], draw]
                    there = rank <= k[:, None]
                    a = (2 * drawn.cumsum(axis=2, dtype=np.int16) >= rank.astype(np.int16)) & there[:, None]
                    b = (2 * own.cumsum(axis=1) >= rank) & there
                    final = b[np.arange(len(at)), k - 1]
                    n11 += (a & b[:, None]).sum(axis=0)
                    yes += a.sum(axis=0)
                    first += b.sum(axis=0)
                    items += there.sum(axis=0)
                    right += ((b == final[:, None]) & there).sum(axis=0)
        cells = [n11, yes - n11, first - n11, items - first - yes + n11, np.broadcast_to(right, n11.shape)]
        rep, at = np.indices((replicates, n)).reshape(2, -1) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (rep, at, *[x.ravel() for x in cells])], names=["rep", "k", *CELLS, "right"])
    return run


def bootstrap_reliability(votes: DataFrame, n: int = 20, replicates: int = 100, seed: int = 1,
                          order: list[str] = ORDER) -> DataFrame:
    """Mean kappa and accuracy by k between labels of k resampled and of the first k original votes.

    Slot j of replicate r of an item draws the vote number md5(seed|r|item|j) mod n, so the draw is
    the same on every attempt and in every engine.  Nothing is exploded: a task adds up cells per (replicate, k).
    The lists of votes are short and their work is long, so they are dealt by number, not by size.
    """
    rows = cut_lineage(vote_prefixes(votes, n, order).select(
        F.col("item").cast("string").alias("item"), F.col("vs").cast("array<bigint>").alias("vs")))
    rows = rows.repartition(max(1, -(-rows.count() * replicates * n // DRAWS_PER_TASK)), "item")
    kinds = ", ".join(f"{c} long" for c in ("rep", "k", *CELLS, "right"))
    sums = rows.mapInArrow(bootstrap_task(n, replicates, seed), kinds).groupBy("rep", "k").agg(
        *[F.sum(c).alias(c) for c in (*CELLS, "right")])
    total = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    return sums.where(total > 0).groupBy("k").agg(F.avg(kappa(*CELLS)).alias("kappa"), F.avg(F.col("right") / total).alias("accuracy"))

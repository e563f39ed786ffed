"""The round loop as streams.

Votes have ``item, annotator, vote, ts``.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from turnwise.functions.measures import votes_needed

# Executors get the state function by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_VOTES = 15
MIN_VOTES = 3
THRESHOLD = 0.8
ROWS_PER_STATE = 250_000
BUNDLES = 1024
ROWS_PER_BUNDLE = 100_000
ROWS_PER_BUNDLES = 5_000_000  # of a partition of state in bundles
ROWS_AT_ONCE = 100_000  # of a bundle
NO_TIME = (1 << 63) - 1
LAST_TIME = "2262-01-01"  # for the watermark: pandas has no times much later

Columns = dict[str, np.ndarray]


def running_tallies(votes: DataFrame, threshold: float = THRESHOLD, max_votes: int = MAX_VOTES) -> DataFrame:
    """Votes and remaining need per item (update mode); partial sums before the shuffle, no Python."""
    tally = votes.groupBy("item").agg(F.sum("vote").alias("yes"), F.count("vote").alias("n"))
    return tally.withColumn("need", F.greatest(F.lit(0), votes_needed("yes", "n", threshold, max_votes)))


def first_submissions(votes: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops repeated (item, annotator) votes within the watermark; the one that arrives first stays.

    Of votes that arrive in one batch any may stay; ``last_submissions`` keeps a defined one.
    """
    return votes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["item", "annotator"])


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers, and state of many keys, needs this store; a store that the session names itself stays.

    The other one keeps all keys in the heap.  All stores of an executor share one bounded memory.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    bounded = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
    if spark.conf.get(bounded, None) is None:
        spark.conf.set(bounded, "true")


@contextmanager
def state_partitions(spark: SparkSession, rows: int, each: int = ROWS_PER_STATE) -> Iterator[None]:
    """Streams that begin in here have a partition of state for ``each`` of the expected ``rows``, and no fewer than usual.

    A stream keeps the number it began with, so its longest task grows with the rows a partition gets.
    """
    key = "spark.sql.shuffle.partitions"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(max(int(usual), -(-rows // each))))
    try:
        yield
    finally:
        spark.conf.set(key, usual)


class _Forgetting(StatefulProcessor):
    """One value per key, dropped by an event-time timer some time after its last row."""

    fields: str  # of the value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.fields)

    def keep(self, old: tuple | None, new: tuple, watermark: int) -> None:
        """Store ``new``, whose last field is the time (ms) of the last row; a key has one timer, which is not moved."""
        if old is None:
            self.handle.registerTimer(max(new[-1], watermark + 1))
        self.value.update(new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        seen = self.value.get()[-1]
        if seen > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(seen)
        else:
            self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Last(_Forgetting):
    """The last row by some columns, given as text; a row that is later than the stored one is passed on."""

    fields = "row string, place string, seen long"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.value.get()
        row, place, seen = None, json.loads(old[1]) if old else None, old[-1] if old else 0
        for r in rows:
            seen = max(seen, r["seen"])
            if place is None or list(r["place"]) > place:
                row, place = r["row"], list(r["place"])
        self.keep(old, (row or old[0], json.dumps(place), seen), timerValues.getCurrentWatermarkInMs())
        if row is not None:
            yield Row(row=row)


def last_submissions(
    votes: DataFrame, order: tuple[str, ...] = ("ts", "session", "line"), forget_after: str | None = None,
) -> DataFrame:
    """The last vote of each (item, annotator) by ``order`` (update mode): a later double submission replaces it.

    Only the vote that counts is kept as state, and votes of one batch are combined before the shuffle.  With
    ``forget_after`` a pair loses its state when its last vote is that much older than the newest of all, so the
    state is bounded by the pairs of that time; the columns of ``order`` are numbers or times then.
    """
    rest = [c for c in votes.columns if c not in ("item", "annotator")]
    use_rocksdb(votes.sparkSession)
    if forget_after is None:
        last = votes.groupBy("item", "annotator").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v"))
        return last.select("item", "annotator", *[F.col("v")[c].alias(c) for c in rest])
    place = [F.unix_micros(c) if votes.schema[c].dataType.simpleString() == "timestamp" else F.col(c).cast("long") for c in order]
    rows = votes.withWatermark("ts", forget_after).select(
        "item", "annotator", "ts", F.to_json(F.struct("item", "annotator", *rest)).alias("row"), F.array(*place).alias("place"),
        F.unix_millis("ts").alias("seen"))
    last = rows.groupBy("item", "annotator").transformWithState(_Last(), "row string", "Update", "EventTime")
    kinds = ", ".join(f"`{c}` {votes.schema[c].dataType.simpleString()}" for c in ("item", "annotator", *rest))
    return last.select(F.from_json("row", kinds).alias("v")).select("v.*")


def _entropy(p: float) -> float:
    return 0.0 if p <= 0 or p >= 1 else -p * math.log2(p) - (1 - p) * math.log2(1 - p)


def _settled(yes: int, n: int, threshold: float, max_votes: int) -> bool:
    return n >= max_votes or (n >= MIN_VOTES and _entropy(yes / n) < threshold)


def bundles_for(spark: SparkSession, rows: int) -> int:
    """For a stream that is to see ``rows`` votes; enough for its partitions of state to be about equal."""
    return max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_BUNDLE))


def stopping_rounds(votes: DataFrame, threshold: float = THRESHOLD, max_votes: int = MAX_VOTES,
                    forget_after: str = "90 days", bundles: int = BUNDLES) -> DataFrame:
    """Emits an item once, when it needs no more votes; later votes on it are ignored, NULL votes always.

    An item loses its state when its last vote is ``forget_after`` older than the newest vote of all; a vote
    after that begins anew.
    The state of an item is (yes, n, closed).  Votes of one batch count in time order (those without a time last), so
    the decision equals the batch rule when votes arrive in order.  At most ``max_votes`` votes of an item change
    its state, the rest only pass by.

    Items are dealt to ``bundles`` by hash.  A bundle is one row of state and one call of Python per batch, so there
    are no more calls with more items; a batch writes the bundles that it meets.  A stream keeps the number it began with.
    """
    use_rocksdb(votes.sparkSession)
    kind = votes.schema["item"].dataType.simpleString()
    plain = kind in ("tinyint", "smallint", "int", "bigint", "string")
    # Votes without an item are a bundle of their own, so numbers stay whole numbers in pandas.
    bundle = F.when(F.col("item").isNotNull(), F.pmod(F.xxhash64("item"), F.lit(bundles))).otherwise(-1).cast("int")
    last = F.lit(LAST_TIME).cast("timestamp")
    ready = votes.where("vote IS NOT NULL").select(
        bundle.alias("bundle"), (F.col("item") if plain else F.to_json(F.struct("item"))).alias("item"),
        F.col("annotator").cast("string").alias("annotator"), F.col("vote").cast("long").alias("vote"),
        F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("ts_us"),
        F.when(F.col("ts") > last, last).otherwise(F.col("ts")).alias("ts")).withWatermark("ts", forget_after)
    stops = ready.groupBy("bundle").applyInPandasWithState(
        _stopping_task(threshold, max_votes), f"item {kind if plain else 'string'}, yes bigint, n bigint", "items binary",
        "append", "EventTimeTimeout")
    return stops if plain else stops.withColumn("item", F.from_json("item", f"item {kind}")["item"])


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _earliest(rows: Columns, most: int) -> Columns:
    """The earliest votes of each item, in order; ``seen`` becomes the latest time of all its rows."""
    items, times = pd.factorize(rows["item"])[0], rows["ts_us"]
    order = np.lexsort((times, items))
    items, times = items[order], times[order]
    begins = _begins(items)
    sizes = np.diff(begins, append=len(items))
    rank = np.arange(len(items)) - np.repeat(begins, sizes)
    # Names are compared for equal times only.
    ties = _begins(items, times)
    tie_sizes = np.diff(ties, append=len(items))
    tied = np.flatnonzero(np.repeat((tie_sizes > 1) & (rank[ties] < most), tie_sizes))
    if len(tied):
        at = order[tied]
        tie = np.repeat(np.arange(len(ties)), tie_sizes)[tied]
        places = zip(tie.tolist(), rows["annotator"][at], rows["vote"][at].tolist(), at.tolist())
        order[tied] = [k for *_, k in sorted((t, a is None, a or "", v, k) for t, a, v, k in places)]
    seen = np.repeat(np.maximum.reduceat(rows["seen"][order], begins), sizes)
    kept = rank < most
    return {c: v[order[kept]] for c, v in rows.items()} | {"seen": seen[kept]}


def _gathered(chunks: Iterator[pd.DataFrame], most: int, none: bool) -> Columns:
    """The earliest votes of each item in all chunks; however many rows there are, few more than these are held."""
    held, size, limit = [], 0, ROWS_AT_ONCE
    joined = lambda: {c: np.concatenate([h[c] for h in held]) for c in held[0]}
    for chunk in chunks:
        rows = {c: chunk[c].to_numpy() for c in ("item", "annotator", "vote", "ts_us")}
        if none:
            rows["item"] = np.zeros(len(chunk), int)
        held.append(rows | {"seen": np.where(rows["ts_us"] == NO_TIME, 0, rows["ts_us"] // 1_000)})
        size += len(chunk)
        if size > limit:
            held = [_earliest(joined(), most)]
            size, limit = len(held[0]["item"]), max(ROWS_AT_ONCE, 2 * len(held[0]["item"]))
    return _earliest(joined(), most)


def _stopping_task(threshold: float, max_votes: int):
    """Tallies of the items of a bundle until they need no more votes."""

    def settled(yes: np.ndarray, n: np.ndarray) -> np.ndarray:
        which, pairs = pd.factorize(np.clip(yes, 0, n) * (max_votes + 1) + np.minimum(n, max_votes))
        return np.array([_settled(p // (max_votes + 1), p % (max_votes + 1), threshold, max_votes) for p in pairs.tolist()], bool)[which]

    def tally(rows: Columns, old: Columns | None, watermark: int) -> tuple[Columns, Columns]:
        """The items that stop, and all items with their new state."""
        begins = _begins(pd.factorize(rows["item"])[0])
        sizes = np.diff(begins, append=len(rows["item"]))
        which = np.repeat(np.arange(len(begins)), sizes)
        items = rows["item"][begins]
        place = pd.Index(old["item"]).get_indexer(items) if old else np.full(len(items), -1)
        was = lambda c, first: np.where(place < 0, first, old[c][place]) if old else np.full(len(items), first)
        yes_before, n_before, closed = was("yes", 0), was("n", 0), was("closed", False)
        running = np.cumsum(rows["vote"])
        yes = running - np.repeat(running[begins] - rows["vote"][begins] - yes_before, sizes)
        n = np.arange(1, len(which) + 1) - np.repeat(begins - n_before, sizes)
        stops = np.flatnonzero(~closed[which] & settled(yes, n))
        stops = stops[_begins(which[stops])]
        # A closed item keeps what it had, another one has what came up to its stop or to its last vote.
        at = begins + sizes - 1
        at[which[stops]] = stops
        new = {"item": items, "yes": np.where(closed, yes_before, yes[at]), "n": np.where(closed, n_before, n[at]),
               "closed": closed, "due": np.maximum(was("due", watermark + 1), rows["seen"][begins])}
        closed[which[stops]] = True
        out = {"item": items[which[stops]], "yes": yes[stops], "n": n[stops]}
        rest = np.ones(len(old["item"]) if old else 0, bool)
        rest[place[place >= 0]] = False
        return out, {c: np.concatenate([old[c][rest], v]) for c, v in new.items()} if rest.any() else new

    def task(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark, none = state.getCurrentWatermarkMs(), key[0] < 0
        items = _unpacked(state.get[0]) if state.exists else None
        if not state.hasTimedOut:
            out, items = tally(_gathered(chunks, max_votes, none), items, watermark)
            yield pd.DataFrame(out | {"item": None} if none else out)
        # As a timer of each item would: what is old goes after the votes of the batch.
        stays = items["due"] >= watermark
        if stays.any():
            state.update((_packed({c: v[stays] for c, v in items.items()}),))
            state.setTimeoutTimestamp(max(int(items["due"][stays].min()), watermark + 1))
        elif state.exists:
            state.remove()

    return task


def _packed(columns: Columns) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))
    with pa.ipc.new_stream(sink := pa.BufferOutputStream(), batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> Columns:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    return {c: v.to_numpy(zero_copy_only=False) for c, v in zip(batch.schema.names, batch.columns)}


def anonymised(votes: DataFrame, names: DataFrame, column: str = "annotator") -> DataFrame:
    """Stream-static join with the pseudonym map; unknown ids come out as NULL ``anon``."""
    m = names.select(F.col("orig").alias(column), "anon")
    return votes.join(m, column, "left")


def split_unknown(batch: DataFrame, known_sink, unknown_sink, column: str = "annotator") -> None:
    """For ``foreachBatch``: known ids go on under their pseudonym, unknown ids to a side table."""
    known_sink(batch.where("anon IS NOT NULL").withColumn(column, F.col("anon")).drop("anon"))
    unknown_sink(batch.where("anon IS NULL").select(column).distinct())

"""Statistics over pairs of members of a group, without a row for each pair of members of an item.

Rows of an item with few members meet once and become one row with a list.  A task numbers the pairs of its lists, a
bounded number at a time, counts equal ones, and sends the sorted numbers as a few packed arrays to where the pairs are
added up.

Members of large items are hashed into blocks.  A (block, block, item shard) tile holds two blocks of members for a
bounded set of items, whatever the size of any one item, and is reduced inside the task by counting the bits that
rows of 64 items a word have in common.  Only one row per distinct pair and tile leaves it, or one number per tile.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.measures import let
from turnwise.plans.ordered import row_numbers
from turnwise.session import cut_lineage

# Executors get the tile functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 256
ITEMS_PER_TILE = 16384
SETS_PER_BLOCK = 64
LISTED = 1024  # votes of an item up to which its pairs are listed
PAIRS_PER_TASK = 1 << 22
VOTES_PER_TASK = 1 << 18
SLICES = 8  # places over which the pairs of one member are dealt, at most
COUNTS = ("n11", "n10", "n01", "n00")


def _tiling(votes: DataFrame, by: list[str], block: int, items_per_tile: int) -> tuple[int, Column, Column, bool]:
    """Number of blocks, cell and bundle of a row, and whether a group has several cells.

    A cell is a set of at most about ``items_per_tile`` items of one group, a bundle holds the cells
    of about as many items, so small groups share a task and a huge group is spread over many.  One
    pass with sketches measures members and items.
    """
    per = votes.groupBy(*by).agg(
        F.approx_count_distinct("item").alias("n"), F.hll_sketch_agg("annotator").alias("members"))
    total, top, members = per.agg(
        F.sum("n"), F.max("n"), F.hll_sketch_estimate(F.hll_union_agg("members"))).first()
    n_blocks = max(1, -(-(members or 0) // block))
    most = max(1, -(-(top or 0) // items_per_tile))
    cell = F.pmod(F.xxhash64("item"), F.lit(most)).cast("int") if most > 1 else F.lit(0)
    if not by:
        return n_blocks, cell, cell, most > 1
    bundles = max(1, -(-(total or 0) * most // items_per_tile))
    return n_blocks, cell, F.pmod(F.xxhash64(*by, cell), F.lit(bundles)).cast("int"), most > 1


def pair_tables(votes: DataFrame, extra: str | None = None, min_shared: float = 1, block: int = BLOCK,
                items_per_tile: int = ITEMS_PER_TILE, sized_by: DataFrame | None = None, most: int | None = None,
                listed: int = LISTED, pairs_per_task: int = PAIRS_PER_TASK, tally: bool = False,
                prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """2x2 counts ``a, b, n11, n10, n01, n00`` of every pair of annotators sharing ``min_shared`` items.

    With ``tally`` the pairs are not named: ``n11, n10, n01, n00, c`` says how many have these counts, and pairs with
    equal counts are put together before they leave their task.

    ``votes`` has one row per (item, annotator) with ``vote`` 0/1.  ``extra`` names a column that
    further splits the pairs (for instance a study number).  ``sized_by`` is a frame with at least the
    same items and annotators that is cheaper to measure (with a column ``n``: of that many rows each, and annotators may
    be absent if there is an ``extra``); ``most`` says that no item has more votes.  ``prepare`` makes the votes out of
    the rows in ``votes``, item by item; then these are measured, and the rows of an item meet before they are prepared.

    Pairs of items with up to ``listed`` votes are listed inside tasks, ``pairs_per_task`` at a time; larger items (with
    ``extra``: groups that hold one, or more pairs than a task) go through tiles.
    """
    by = [extra] if extra else []
    cast_votes = lambda rows: rows.where(F.col("vote").isNotNull()).select(*by, "item", "annotator", "vote")
    if prepare is None:
        votes = cast_votes(votes)
        if sized_by is None:
            votes = cut_lineage(votes)  # measured, then read
    sizes = votes if sized_by is None else sized_by
    rows = F.sum("n") if "n" in sizes.columns else F.count(F.lit(1))
    n = rows if most is None else F.least(rows, F.lit(most))
    items = sizes.groupBy(*by, "item").agg(n.alias("n"), rows.alias("rows"))
    work = F.col("n") * (F.col("n") + 1) / 2  # votes and pairs
    units = items.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum("n").alias("votes"), F.sum(work).alias("pairs"), F.max("rows").alias("rows")) if by \
        else items.withColumns({"votes": F.col("n"), "pairs": work})
    large = F.col("n") > listed
    if by:
        large |= F.col("pairs") > pairs_per_task
    units = units.withColumn("large", large)
    n_large, total, cast, top = units.agg(
        F.count_if("large"), *[F.sum(F.when(~F.col("large"), F.col(c))) for c in ("pairs", "votes")],
        F.max(F.when(~F.col("large"), F.col("rows")))).first()
    bundles = max(1, -(-int(total or 0) // pairs_per_task), -(-int(cast or 0) // VOTES_PER_TASK))
    unit = by or ["item"]
    people, small, enough = sizes, votes, min_shared
    if n_large:
        names = cut_lineage(units.where("large").select(*[F.col(c).alias(f"__{c}") for c in unit]))
        own = F.col(unit[0]).eqNullSafe(F.col(f"__{unit[0]}"))
        small, votes = votes.join(names, own, "left_anti"), votes.join(names, own, "left_semi")
        sizes = sizes.join(names, own, "left_semi")
        enough = min_shared if by else 1  # pairs of small and large items are added up below
    if prepare is not None:
        if (top or 0) <= VOTES_PER_TASK:
            small = small.repartition(bundles, "item")
        small = cast_votes(prepare(small))
        if n_large:
            votes = cast_votes(prepare(votes))
    if n_large and "annotator" not in sizes.columns:
        sizes = votes = cut_lineage(votes)
    whole = tally and (by or not n_large)  # no pair has counts elsewhere
    if by:
        parts = _grouped_pairs(small, extra, bundles, enough, whole)
    else:
        parts = _listed_pairs(small, people, bundles, enough, whole, pairs_per_task)
    if whole:
        if n_large:
            tiles = _tiled_pairs(votes, by, block, items_per_tile, sizes, enough)
            parts = parts.unionByName(tiles.select(*COUNTS, F.lit(1).cast("long").alias("c")))
        return parts.groupBy(*COUNTS).agg(F.sum("c").alias("c"))
    if not n_large:
        return parts
    tiles = _tiled_pairs(votes, by, block, items_per_tile, sizes, enough)
    if by:
        return parts.unionByName(tiles)
    summed = parts.unionByName(tiles).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in COUNTS])
    summed = summed.where(F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00") >= min_shared)
    return summed.groupBy(*COUNTS).agg(F.count(F.lit(1)).alias("c")) if tally else summed


def _listed(item: np.ndarray, member: np.ndarray, vote: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs a < b of members (numbers below ``n``) of each item as sorted numbers (a * n + b) * 4 + cell, and how
    often each occurs; cells 0 to 3 stand for n11, n10, n01, n00."""
    order = np.lexsort([vote, member, item])
    item, member, vote = item[order], member[order], vote[order]
    last = np.append((np.diff(item) != 0) | (np.diff(member) != 0), True)  # of one member's votes on an item a yes counts
    item, member, vote = item[last], member[last], vote[last]
    ends = np.append(np.flatnonzero(np.diff(item)) + 1, len(item))
    later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(item)) - 1
    left = np.repeat(np.arange(len(item)), later)
    right = np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later) + left + 1
    number = (member[left] * n + member[right]) * 4 + 3 - 2 * vote[left] - vote[right]
    number.sort()
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    return number[starts], np.diff(starts, append=len(number))


def _tables(number: np.ndarray, count: np.ndarray, min_shared: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with ``min_shared`` common items, and a row of four counts each, from sorted numbers of pairs and cells."""
    pair, cell = number >> 2, number & 3
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    row = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(pair)))
    cells = np.zeros(4 * len(starts), np.int64)
    np.add.at(cells, 4 * row + cell, count)
    cells = cells.reshape(-1, 4)
    keep = cells.sum(axis=1) >= min_shared
    return pair[starts][keep], cells[keep]


def _tallied(cells: np.ndarray) -> pd.DataFrame:
    """Distinct rows of four counts and how often each occurs."""
    short = cells.max(initial=0) < 1 << 15  # four counts make one number
    cells = cells[np.argsort(cells @ (1 << np.arange(0, 60, 15)))] if short else cells[np.lexsort(cells.T)]
    starts = np.flatnonzero(np.append(True, (np.diff(cells, axis=0) != 0).any(axis=1))[:len(cells)])
    return pd.DataFrame({**dict(zip(COUNTS, cells[starts].T)), "c": np.diff(starts, append=len(cells))})


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, with codes of few bits for the bytes that are frequent in a plane."""
    planes = values.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    packer = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return packer.compress(planes) + packer.flush()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).ravel()


def _listed_pairs(votes: DataFrame, people: DataFrame, bundles: int, min_shared: float, tally: bool,
                  pairs_per_task: int) -> DataFrame:
    """Pair tables of items that are one row each.

    Members are numbered in their order.  About ``pairs_per_task`` pairs at a time, a task sends one row to each place
    where pairs are added up: the steps between their sorted numbers, and how often they occur.  Pairs of one member with
    neighbours in that order go to one place, so the steps are small.
    """
    member = votes.schema["annotator"].dataType.simpleString()
    people = people.select("annotator", F.col("annotator").isNull().alias("__none")).distinct()
    codes = cut_lineage(row_numbers(people, [], ["__none", "annotator"], "code").select(
        F.col("annotator").alias("__name"), (F.col("code") - 1).alias("code")))
    n = codes.count()
    rows = votes.join(codes, F.col("annotator").eqNullSafe(F.col("__name")))
    # Nothing is sent here if the rows of an item are together already.
    lists = rows.groupBy("item").agg(F.collect_list(F.col("code") * 2 + F.col("vote").cast("long")).alias("cast")).select("cast")
    mix = np.uint64(0x9E3779B97F4A7C15)
    width = max(1, -(-n // SLICES))
    kind = np.uint16 if bundles <= 1 << 16 else np.int64  # short numbers are sorted by their digits

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, load = [], 0
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            work = np.cumsum(lengths.astype(np.int64) * (lengths + 1) // 2)
            ends = np.append(np.flatnonzero(np.diff(work // -(-pairs_per_task // 4))) + 1, len(lengths))
            for start, end in zip(np.append(0, ends[:-1]), ends):
                held.append((lengths[start:end], batch.column(0).slice(start, end - start).flatten().to_numpy()))
                load += int(work[end - 1] - (work[start - 1] if start else 0)) if end > start else 0
                if load > 1.25 * pairs_per_task:
                    yield packed(*map(np.concatenate, zip(*held)))
                    held, load = [], 0
        if held:
            yield packed(*map(np.concatenate, zip(*held)))

    def packed(lengths: np.ndarray, cast: np.ndarray) -> pa.RecordBatch:
        number, count = _listed(np.repeat(np.arange(len(lengths)), lengths), cast >> 1, cast & 1, n)
        a, b = np.divmod(number >> 2, n)
        slice_ = (a * SLICES + b // width).astype(np.uint64)
        place = ((slice_ * mix >> np.uint64(32)) % np.uint64(bundles)).astype(kind)
        order = np.argsort(place, kind="stable")
        number, count = number[order], count[order]
        places, starts = np.unique(place[order], return_index=True)
        cuts = starts[1:]
        return pa.RecordBatch.from_arrays([
            pa.array(places.astype(np.int64)),
            pa.array([_pack(np.diff(x, prepend=0)) for x in np.split(number, cuts)][:len(places)], pa.binary()),
            pa.array([_pack(x) for x in np.split(count, cuts)][:len(places)], pa.binary())], names=["place", "steps", "counts"])

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        number = np.concatenate([_unpack(x).cumsum() for x in pdf["steps"]])
        count = np.concatenate([_unpack(x) for x in pdf["counts"]])
        order = np.argsort(number, kind="stable")
        pair, cells = _tables(number[order], count[order], min_shared)
        if tally:
            return _tallied(cells)
        return pd.DataFrame({"__a": pair // n, "__b": pair % n, **dict(zip(COUNTS, cells.T))})

    sent = lists.mapInArrow(numbers, "place long, steps binary, counts binary")
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    summed = sent.repartition(bundles, "place").groupBy("place").applyInPandas(
        add_up, f"{kinds}, c long" if tally else f"__a long, __b long, {kinds}")
    if tally:
        return summed
    for side in ("a", "b"):
        summed = summed.join(codes.select(F.col("code").alias(f"__{side}"), F.col("__name").cast(member).alias(side)), f"__{side}")
    return summed.select("a", "b", *COUNTS)


def _grouped_pairs(votes: DataFrame, extra: str, bundles: int, min_shared: float, tally: bool) -> DataFrame:
    """Pair tables of whole groups, each with the pairs of one task at most; nothing leaves a task but the result.

    An item is sent as one row with the lists of its members and of their votes.
    """
    member, kind = (votes.schema[c].dataType.simpleString() for c in ("annotator", extra))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        names, cast = np.concatenate(pdf["names"].to_list()), np.concatenate(pdf["cast"].to_list())
        pdf = pdf.take(np.repeat(np.arange(len(pdf)), pdf["names"].map(len))).assign(annotator=names, vote=cast)
        # Numbers of members within groups: a pair of them names its group.
        names, group = pdf["annotator"].to_numpy(), pd.factorize(pdf[extra])[0]
        ranked, rank = np.unique(names, return_inverse=True)
        codes, first, member = np.unique(group * len(ranked) + rank, return_index=True, return_inverse=True)
        item, items = pd.factorize(pdf["item"])
        number, often = _listed(
            group * (len(items) + 1) + item, member, pdf["vote"].to_numpy().astype(np.int64), len(codes))
        pair, cells = _tables(number, often, min_shared)
        if tally:
            return _tallied(cells)
        a, b = first[pair // len(codes)], first[pair % len(codes)]
        return pd.DataFrame({extra: pdf[extra].to_numpy()[a], "a": names[a], "b": names[b], **dict(zip(COUNTS, cells.T))})

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    lists = votes.groupBy(extra, "item").agg(
        F.collect_list(F.struct("annotator", F.col("vote").cast("tinyint").alias("vote"))).alias("votes")).select(
            extra, "item", F.col("votes.annotator").alias("names"), F.col("votes.vote").alias("cast"),
            F.pmod(F.xxhash64(extra), F.lit(bundles)).cast("int").alias("bundle"))
    return lists.repartition(bundles, "bundle").groupBy("bundle").applyInPandas(
        count, f"{kinds}, c long" if tally else f"{extra} {kind}, a {member}, b {member}, {kinds}")


def _tiled_pairs(votes: DataFrame, by: list[str], block: int, items_per_tile: int, sizes: DataFrame,
                 min_shared: float) -> DataFrame:
    extra = by[0] if by else None
    n_blocks, cell, bundle, several = _tiling(sizes, by, block, items_per_tile)
    rows = votes.withColumns({
        "own": F.pmod(F.xxhash64("annotator"), F.lit(n_blocks)).cast("int"), "cell": cell, "bundle": bundle})
    if n_blocks == 1:
        rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    else:
        # The blocks present in an item: at most n_blocks small numbers.
        present = rows.groupBy(*by, "item").agg(F.collect_set("own").alias("present"))
        keys = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*by, "item")]
        present = present.select(*[F.col(k).alias(f"__{k}") for k in (*by, "item")], "present")
        rows = rows.join(present, reduce(lambda x, y: x & y, keys)).withColumn("other", F.explode("present")).withColumns({
            "lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop(
                "present", "other", *[f"__{k}" for k in (*by, "item")])
    member = votes.schema["annotator"].dataType.simpleString()
    first = f"{extra} {votes.schema[extra].dataType.simpleString()}, " if extra else ""
    schema = f"{first}a {member}, b {member}, n11 bigint, n10 bigint, n01 bigint, n00 bigint"
    enough = 1 if several else min_shared

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        return _tile_counts(pdf, [*by, "cell"], extra, enough)

    tiles = rows.groupBy("lo", "hi", "bundle").applyInPandas(tile, schema)
    if not several:
        return tiles
    summed = tiles.groupBy(*by, "a", "b").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return summed.where(F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00") >= min_shared)


def _tile_counts(pdf: pd.DataFrame, keys: list[str], extra: str | None, min_shared: float) -> pd.DataFrame:
    """Counts of the pairs of members of all cells of a tile; the cells share one set of columns."""
    lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
    cell = pdf.groupby(keys, sort=False).ngroup().to_numpy()
    items, names = pd.factorize(pdf["item"])[0], pdf["annotator"].to_numpy()
    ranked, member = np.unique(names, return_inverse=True)
    own, vote = pdf["own"].to_numpy(), pdf["vote"].to_numpy().astype(bool)
    order = np.lexsort([member, cell])
    ends = np.append(np.flatnonzero(np.diff(cell[order])) + 1, len(order))
    parts, start = [], 0
    for end in ends:
        at = order[start:end]
        start = end
        row = np.unique(items[at], return_inverse=True)[1]
        left = _Bits(row, member[at], vote[at], own[at] == lo)
        right = left if lo == hi else _Bits(row, member[at], vote[at], own[at] == hi)
        i, j, counts = left.against(right, min_shared)
        parts.append((np.full(len(i), at[0]), left.names[i], right.names[j], *counts))
    at, a, b, n11, n10, n01, n00 = map(np.concatenate, zip(*parts))
    swap = a > b  # members are numbered in their order
    out = {
        "a": ranked[np.where(swap, b, a)], "b": ranked[np.where(swap, a, b)], "n11": n11,
        "n10": np.where(swap, n01, n10), "n01": np.where(swap, n10, n01), "n00": n00}
    if extra:
        out = {extra: pdf[extra].to_numpy()[at], **out}
    return pd.DataFrame(out)


class _Bits:
    """Who of a block voted and who voted yes, as rows of 64 items a word."""

    def __init__(self, row: np.ndarray, member: np.ndarray, vote: np.ndarray, mask: np.ndarray):
        self.names, line = np.unique(member[mask], return_inverse=True)
        row, vote = row[mask], vote[mask]
        words = int(row.max(initial=0)) // 64 + 1
        self.present = np.zeros((words, len(self.names)), np.uint64)
        self.yes = np.zeros_like(self.present)
        bit = np.uint64(1) << (row % 64).astype(np.uint64)
        np.bitwise_or.at(self.present, (row // 64, line), bit)
        np.bitwise_or.at(self.yes, (row // 64, line), np.where(vote, bit, np.uint64(0)))

    def against(self, other: "_Bits", min_shared: float) -> tuple:
        """Index pairs with ``min_shared`` common items, each once, and their four counts."""
        both, n11, n10, n01 = (np.zeros((len(self.names), len(other.names)), np.int32) for _ in range(4))
        for p, y, q, z in zip(self.present, self.yes, other.present, other.yes):
            both += np.bitwise_count(p[:, None] & q)
            n11 += np.bitwise_count(y[:, None] & z)
            n10 += np.bitwise_count(y[:, None] & (q & ~z))
            n01 += np.bitwise_count((p & ~y)[:, None] & z)
        keep = both >= min_shared
        if self is other:
            keep &= np.triu(np.ones_like(keep), 1)
        i, j = np.nonzero(keep)
        counts = [c[i, j].astype(np.int64) for c in (n11, n10, n01)]
        return i, j, [*counts, both[i, j] - sum(counts)]


def pairwise_jaccard(marks: DataFrame, per_block: int = SETS_PER_BLOCK) -> DataFrame:
    """Sum and number of Jaccard overlaps over all pairs of non-empty highlights of an item.

    ``marks`` has ``item, hl``.  Equal highlights are counted once with their multiplicity m (the
    m(m-1)/2 pairs among them overlap fully).  The distinct ones sit in blocks of ``per_block`` in the order of their
    tokens.  An index of the tokens of blocks tells which blocks have one in common; only those meet, one row for a pair
    of blocks, so a huge item becomes many rows on many tasks.  The number of pairs needs no pairs.
    """
    sets = marks.where(F.size("hl") > 0).select("item", F.array_sort(F.array_distinct("hl")).alias("hl")) \
        .groupBy("item", "hl").agg(F.count(F.lit(1)).alias("m"))
    sizes = sets.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("nb"), F.sum("m").alias("people"))
    top = sizes.agg(F.max("nb")).first()[0]
    if (top or 1) == 1:
        blocks = sets.groupBy("item").agg(F.collect_list(F.struct("hl", "m")).alias("left"))
        tiles = blocks.select("item", "left", F.lit(True).alias("same"), F.col("left").alias("right"))
    else:
        # In the order of their tokens, so that a block has few tokens and few blocks have one in common.
        sets = sets.withColumn("length", F.size("hl"))
        placed = row_numbers(sets, ["item"], ["hl"], "__rn", probe=sets.select("item", "hl"))
        placed = placed.withColumn("block", F.floor((F.col("__rn") - 1) / per_block).cast("int"))
        blocks = cut_lineage(placed.groupBy("item", "block").agg(F.collect_list(F.struct("hl", "m")).alias("sets")))
        tokens = blocks.select("item", "block", F.explode(F.array_distinct(F.flatten(F.transform("sets", lambda x: x["hl"])))).alias("tok"))
        tokens = cut_lineage(tokens)
        met = tokens.withColumnRenamed("block", "lo").join(tokens.withColumnRenamed("block", "hi"), ["item", "tok"]).where(
            "lo <= hi").select("item", "lo", "hi").distinct()
        tiles = met.join(blocks.select("item", F.col("block").alias("lo"), F.col("sets").alias("left")), ["item", "lo"]).join(
            blocks.select("item", F.col("block").alias("hi"), F.col("sets").alias("right")), ["item", "hi"]).select(
                "item", "left", "right", (F.col("lo") == F.col("hi")).alias("same"))

    # Among equal highlights the overlap is 1; within one block each unordered pair counts once.
    def overlap(x: Column, i: Column) -> Column:
        others = F.when(F.col("same"), F.slice("right", i + 2, F.greatest(F.size("right") - i - 1, F.lit(0)))) \
            .otherwise(F.col("right"))
        own = F.when(F.col("same"), x["m"] * (x["m"] - 1) / 2).otherwise(F.lit(0.0))
        return F.aggregate(others, own, lambda acc, y: acc + _overlap(x["hl"], y["hl"]) * x["m"] * y["m"])

    per_tile = tiles.select(
        "item", F.aggregate(F.transform("left", overlap), F.lit(0.0), lambda acc, v: acc + v).alias("overlap"))
    pairs = F.col("people") * (F.col("people") - 1) / 2
    return per_tile.groupBy("item").agg(F.sum("overlap").alias("overlap")).join(
        sizes.select("item", pairs.alias("pairs")), "item").select("item", "overlap", "pairs")


def _overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two non-empty arrays without repetitions."""
    return let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))

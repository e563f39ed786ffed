"""Benchmark decontamination: SimHash windows of the size of the benchmark items.

Documents and items are sequences of shingles of five words (runs of letters, digits and underscores in
lower case).  For every size that items have, a window is a run of as many shingles, or at either end of a
text a shorter run that can still be similar, so passages that are cut off there are found.  A window's
fingerprint comes from running sums of the shingles' hash bits.  A multi-index finds items within the
Hamming radius: if two fingerprints differ in at most ``radius`` of 64 bits, they differ in at most
``radius // 4`` bits of one of their four blocks of 16; a table per block knows all values that near to an
item's, and lookups of the values near to a window's return the items.  Candidates are verified by the exact
similarity of the weighted shingles (weights are numbers of occurrences: common weight by weight of the union).

Most windows need no fingerprint: a window that is similar enough to an item has so many shingles of items
that a running count of those tells.  That skip loses nothing; ``skip=False`` goes without it.

Documents never meet, so nothing is shuffled.  The items are a query set: they are sent to the tasks
in blocks of bounded size, one pass over the documents for each block.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.base import kept, query, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5  # of a shingle
SIMILARITY = 0.8
RADIUS = 19  # two windows at 0.8 differ in about 10 bits, with a deviation of 3
ITEMS = 20_000  # items that are sent to the tasks at a time
ITEM_BYTES = 16 << 20  # and their texts
AT_ONCE = 1 << 8  # windows that a task looks up at a time
KNOWN_BITS = 24  # of the places of the table of all items' shingles: 16 MB
LETTERS = 1 << 20  # of a text that are hashed at a time
GAP = re.compile(r"\W")


def word_letters() -> np.ndarray:
    """For each code point whether it is a letter, a digit or an underscore."""
    found = np.fromiter(map(str.isalnum, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)
    found[ord("_")] = True
    return found


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: its letters, mixed, times powers by their places, added up and mixed again."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = kept("word letters", word_letters)[codes]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    letters = codes[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    letters ^= letters >> np.uint64(31)
    letters *= np.uint64(0xD6E8FEB86659FD93)
    powers = np.cumprod(np.full(int(lengths.max()), 0xA24BAED4963EE407, np.uint64))
    letters *= powers[np.arange(len(letters)) - np.repeat(first, lengths)]
    sums = np.add.reduceat(letters, first)
    sums ^= sums >> np.uint64(32)
    return sums * np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """A hash of each run of ``words`` words of the text; none if it is shorter."""
    low, parts, start = (text or "").lower(), [], 0
    while start < len(low):
        # Long texts are cut between words.
        gap = GAP.search(low, start + LETTERS)
        end = gap.start() if gap else len(low)
        parts.append(word_hashes(low[start:end]))
        start = end
    word = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    n = len(word) - words + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = (out ^ word[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def running_bits(hashes: np.ndarray) -> np.ndarray:
    """Sums of the hash bits before each shingle."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return sums


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of each window: a bit is 1 if more than half of its shingles have it."""
    sums = running_bits(hashes)
    ones = sums[ends] - sums[starts]
    return np.packbits((2 * ones > (ends - starts)[:, None]).ravel()).view(np.uint64)


def least_common(window, item, similarity: float):
    """The common weight that a window needs with an item, given the weights of both."""
    return np.ceil(similarity * (window + item) / (1 + similarity) - 1e-9).astype(np.int64)


class ItemIndex:
    """The items of one size: fingerprints, a multi-index over them, and weighted shingles."""

    def __init__(self, size: int, items: list[tuple[int, np.ndarray]], radius: int):
        self.size, self.radius = size, radius
        self.number = [i for i, _ in items]
        self.weights = [Counter(h.tolist()) for _, h in items]
        whole = np.zeros(1, np.int64)
        self.prints = np.concatenate([window_fingerprints(h, whole, whole + size) for _, h in items])
        near = radius // 4
        self.masks = np.array(
            [sum(1 << b for b in bits) for k in range(near + 1) for bits in combinations(range(16), k)], np.uint16)
        self.blocks = []  # for each block of bits the values near to an item's, and the items by their own values
        for values in self.prints.view(np.uint16).reshape(-1, 4).T:
            table = np.zeros(1 << 16, bool)
            own = np.unique(values)
            for at in range(0, len(own), 1_000):
                table[(own[at:at + 1_000, None] ^ self.masks).ravel()] = True
            order = np.argsort(values, kind="stable")
            self.blocks.append((table, values[order], order))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (window, item) within the radius, each once."""
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(prints), AT_ONCE):
            some = prints[at:at + AT_ONCE]
            for (table, values, order), own in zip(self.blocks, some.view(np.uint16).reshape(-1, 4).T):
                windows = np.flatnonzero(table[own])
                if len(order) <= len(self.masks):
                    # Fewer items than values near to a window's: it meets all items.
                    window, items = np.divmod(np.arange(len(windows) * len(order)), len(order))
                else:
                    probes = own[windows, None] ^ self.masks
                    first, last = np.searchsorted(values, probes), np.searchsorted(values, probes, "right")
                    window, _ = hit = np.nonzero(last > first)
                    number = (last - first)[hit]
                    items = order[np.repeat(first[hit] - np.cumsum(number) + number, number) + np.arange(number.sum())]
                    window = np.repeat(window, number)
                windows = windows[window]
                near = np.bitwise_count(some[windows] ^ self.prints[items]) <= self.radius
                found.append((windows[near] + at) * len(self.prints) + items[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Common weight of the shingles by the weight of their union."""
        weights = self.weights[item]
        common = sum(min(n, weights[h]) for h, n in Counter(window.tolist()).items() if h in weights)
        return common / (len(window) + self.size - common)


class Index(dict):
    """``ItemIndex`` by size, and the shingles of all items."""

    def __init__(self, items: list[str], radius: int):
        by_size = defaultdict(list)
        for number, text in enumerate(items):
            found = shingles(text)
            if len(found):
                by_size[len(found)].append((number, found))
        super().__init__({size: ItemIndex(size, some, radius) for size, some in sorted(by_size.items())})
        every = [h for some in by_size.values() for _, h in some]
        self.known = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << KNOWN_BITS, bool)
        self.table[(self.known >> np.uint64(64 - KNOWN_BITS)).astype(np.intp)] = True

    def knows(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each shingle is one of an item."""
        found = self.table[(hashes >> np.uint64(64 - KNOWN_BITS)).astype(np.intp)]
        maybe = np.flatnonzero(found)
        if len(maybe):
            place = np.searchsorted(self.known, hashes[maybe])
            found[maybe] = self.known[np.minimum(place, len(self.known) - 1)] == hashes[maybe]
        return found


def build_index(items: list[str], radius: int) -> Index:
    return Index(items, radius)


def windows_of(size: int, length: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all windows for items of ``size`` in a text of ``length`` shingles."""
    starts = np.arange(max(0, length - size + 1))
    shorter = np.arange(int(np.ceil(similarity * size - 1e-9)), min(size - 1, length) + 1)
    heads, tails = shorter, shorter[shorter < length]  # of a whole text there is one
    return (np.concatenate([starts, np.zeros(len(heads), np.int64), length - tails]),
            np.concatenate([starts + size, heads, np.full(len(tails), length)]))


def spans(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of windows that touch each other, some at a time: where they begin and end, and which they are."""
    order = np.argsort(starts, kind="stable")
    at = 0
    while at < len(order):
        upto, end = at + 1, ends[order[at]]
        while upto < len(order) and upto - at < AT_ONCE and starts[order[upto]] <= end:
            end = max(end, ends[order[upto]])
            upto += 1
        yield int(starts[order[at]]), int(end), order[at:upto]
        at = upto


def matches(
    texts: list[str | None], index: Index, similarity: float, skip: bool = True,
) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(text, item) to the most similar window: similarity, first word, words; of equal ones the first, then the longest."""
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    if not index:
        return found
    fewest = {size: least_common(np.ceil(similarity * size - 1e-9), size, similarity) for size in index}
    for text, own in enumerate(map(shingles, texts)):
        if not len(own):
            continue
        known = np.concatenate([[0], np.cumsum(index.knows(own))])
        for size, group in index.items():
            if skip and known[-1] < fewest[size]:
                break  # larger items need more
            starts, ends = windows_of(size, len(own), similarity)
            if skip:
                enough = known[ends] - known[starts] >= least_common(ends - starts, size, similarity)
                starts, ends = starts[enough], ends[enough]
            for low, high, which in spans(starts, ends):
                prints = window_fingerprints(own[low:high], starts[which] - low, ends[which] - low)
                for window, item in zip(*(x.tolist() for x in group.candidates(prints))):
                    start, end = int(starts[which[window]]), int(ends[which[window]])
                    value = group.similarity(item, own[start:end])
                    if value >= similarity:
                        key, new = (text, group.number[item]), (value, start, end - start + WORDS - 1)
                        if key not in found or (new[0], -new[1], new[2]) > (found[key][0], -found[key][1], found[key][2]):
                            found[key] = new
    return found


def match_task(items: list[tuple], radius: int, similarity: float):
    """Task function: (id, text) to the items found in each text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = build_index([text for _, text in items], radius)
        for batch in batches:
            ids, texts, start, size = batch["id"].tolist(), batch["text"].tolist(), 0, 0
            for end, text in enumerate(texts, 1):
                size += len(text or "")
                if size > 1 << 20 or end == len(texts):
                    rows = [
                        (ids[start + t], items[i][0], value, first, words)
                        for (t, i), (value, first, words) in matches(texts[start:end], index, similarity).items()]
                    if rows:
                        yield pd.DataFrame(rows, columns=["id", "item", "similarity", "start", "words"])
                    start, size = end, 0
    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, items_at_once: int = ITEMS,
) -> DataFrame:
    """``id``, ``item``, ``similarity``, ``start`` and ``words`` (most similar window) per document and item found in it.

    An item is found where the weighted shingles of a window of its size (or less, at the ends of a
    text) have ``similarity`` or more with its own, and the fingerprints of the window and the item differ
    in at most ``radius`` bits.  Texts count whole, however long.  Null and empty texts and those
    under five words hold no shingle: such documents hold no item, such items are in no document.
    Repeated rows are searched one by one, null ids stay null, equal items are all found; without
    documents or items the result is empty.  Other columns are ignored.
    """
    schema = f"id {docs.schema[id].dataType.simpleString()}, item {benchmark.schema[item].dataType.simpleString()}, " \
        "similarity double, start long, words long"
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    wanted = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    count, size = wanted.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-count // items_at_once), -(-(size or 0) // ITEM_BYTES)) if count else 0
    # Without items no row is read.  An empty table from Python would start further workers on every executor.
    found = rows.where(F.lit(False)).mapInPandas(match_task([], radius, similarity), schema) if not blocks else None
    for block in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        part = rows.mapInPandas(match_task([tuple(r) for r in some], radius, similarity), schema)
        found = part if found is None else found.unionByName(part)
    return found.select(
        F.col("id").alias(id), F.col("item").alias(item), "similarity", "start", "words")


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Near duplicates by SimHash fingerprints and a self-join of binary tries.

The distinct fingerprints are joined with themselves.  Two fingerprints with at most ``radius``
differing bits agree on ``equal`` of ``radius + equal`` blocks of bits, so for each choice of
``equal`` blocks there is one trie that has the bits of these blocks at its top, and linked
fingerprints share a node below the top of at least one trie.  From there each trie is joined with
itself: pairs of nodes are traversed together, bit by bit, the differing bits are accumulated, and a
pair is pruned when they exceed the radius.  The number of tries follows from the number of
fingerprints and never changes the result.

Nodes below the top are spread over the cluster.  Where one holds more fingerprints than a task
should (a large group of near copies), the traversal goes on in Spark, in rounds: a table of live node pairs is split by
some bits, pairs beyond the radius are pruned, and pairs that a task can join become tasks of their own.

A task reports its links as a spanning forest, as links to the smallest of each set, so links of n
fingerprints are less than n rows however dense they are.  The components of all links are found by alternating star
contractions (Kiveris et al., 2014), on fingerprints and not on documents.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.base import query, table
from turnwise.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
NODE_ROWS = 4_096  # fingerprints of a node that one task joins
NODE_BITS = 6  # by which larger nodes are split
PAIRS_AT_ONCE = 1 << 20  # node pairs that a task holds at a time
LEAF_PAIRS = 64  # pairs of fingerprints that are compared without further traversal


# -- fingerprints ---------------------------------------------------------------------------------


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``size`` words, repeats included; of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts = np.concatenate([[0], ends[:n - 1] + 1]).tolist()
    stops = ends[min(size, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """The number whose bits are 1 where more than half of the hashes have a 1."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # so memory stays small for long texts
        part = hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint_task(size: int):
    """Task function: (id, text) to (id, fingerprint as a signed long)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([majority_bits(shingle_hashes(t, size)) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fingerprint": prints.view(np.int64)})
    return run


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """``id`` and ``fingerprint`` of each row.  Words are split at ASCII white space, A-Z in lower case; no word: 0."""
    key = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(
        fingerprint_task(words), f"id {key}, fingerprint long")


# -- trie self-join -------------------------------------------------------------------------------


def trie_orders(radius: int, equal: int) -> list[tuple[np.ndarray, int]]:
    """For each trie the order of bits from its top (0 is the highest bit) and the depth below which pairs meet."""
    blocks = np.array_split(np.arange(BITS), radius + equal)
    out = []
    for chosen in combinations(range(radius + equal), equal):
        top = np.concatenate([blocks[i] for i in chosen])
        out.append((np.concatenate([top, np.setdiff1d(np.arange(BITS), top)]), len(top)))
    return out


def equal_blocks(count: int, radius: int) -> int:
    """As many blocks as keep the nodes below the top near 64 fingerprints, if those are spread evenly."""
    return next((e for e in range(1, 5) if 2 ** (BITS * e // (radius + e)) * 64 >= count), 4)


def permuted(prints: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Fingerprints with their bits in trie order."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits[:, order]), axis=1).view(">u8").ravel().astype(np.uint64)


def place_task(radius: int, equal: int):
    """Task function: fingerprints to their places (trie, top, path) in all tries."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders = trie_orders(radius, equal)
        for batch in batches:
            prints = batch["fingerprint"].to_numpy().view(np.uint64)
            for trie, (order, depth) in enumerate(orders):
                path = permuted(prints, order)
                yield pd.DataFrame({
                    "trie": np.full(len(path), trie, np.int32), "top": (path >> np.uint64(BITS - depth)).astype(np.int64),
                    "path": path.view(np.int64), "fingerprint": prints.view(np.int64)})
    return run


def near_pairs(
    left: np.ndarray, right: np.ndarray, roots: tuple[np.ndarray, ...], depth: int, radius: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of paths within ``radius`` bits, by joint traversal of their tries.

    ``roots``: start and end of nodes of ``depth`` in ``left`` and in ``right``, the bits in which their
    paths differ, and whether they are one and the same node (of one array; then each pair comes once).
    """
    todo = [(depth, *roots)]
    while todo:
        depth, a, b, c, d, err, same = todo.pop()
        if len(a) > PAIRS_AT_ONCE:
            half = len(a) // 2
            todo += [(depth, *(x[part] for x in (a, b, c, d, err, same))) for part in (slice(half), slice(half, None))]
            continue
        small = ((b - a) * (d - c) <= LEAF_PAIRS) | (depth >= BITS)
        if small.any():
            s, width = np.flatnonzero(small), (d - c)[small]
            number = (b - a)[small] * width
            which = np.repeat(np.arange(len(s)), number)
            at = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            i, j = a[s][which] + at // width[which], c[s][which] + at % width[which]
            near = np.bitwise_count(left[i] ^ right[j]) <= radius
            near &= ~same[s][which] | (i < j)
            if near.any():
                yield i[near], j[near]
        a, b, c, d, err, same = (x[~small] for x in (a, b, c, d, err, same))
        if not len(a):
            continue
        # Paths below a node are sorted, so the place where a bit turns to 1 splits the node in two.
        bit = np.uint64(BITS - 1 - depth)
        ones_left = np.concatenate([[0], np.cumsum((left >> bit) & np.uint64(1), dtype=np.int64)])
        ones_right = np.concatenate([[0], np.cumsum((right >> bit) & np.uint64(1), dtype=np.int64)])
        m, n = b - (ones_left[b] - ones_left[a]), d - (ones_right[d] - ones_right[c])
        cross = ~same
        parts = [
            (a, m, c, n, err, same), (m, b, n, d, err, same), (a, m, n, d, err + 1, np.zeros_like(same)),
            tuple(x[cross] for x in (m, b, c, n, err + 1, same))]
        new = [np.concatenate(x) for x in zip(*parts)]
        live = (new[1] > new[0]) & (new[3] > new[2]) & (new[4] <= radius)
        todo.append((depth + 1, *(x[live] for x in new)))


class Forest:
    """Disjoint sets of 0..n-1 whose roots are their smallest members."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            root = self.roots()
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each member that is no root, and its root."""
        root = self.roots()
        member = np.flatnonzero(root != np.arange(len(root)))
        return member, root[member]


def join_task(depths: list[int], radius: int):
    """Task function: the pairs of node parts of a partition to links of fingerprints.

    Rows are (pair, trie, side, path, fingerprint); the rows of a pair are in one partition, side 1
    is absent in a pair of a node with itself.  Partitions are worked whole: bounded by the rows of a task.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        rows["u"] = rows["path"].to_numpy().view(np.uint64)
        distinct, index = np.unique(rows["fingerprint"].to_numpy(), return_inverse=True)
        rows["index"], rows["at"] = index, rows["pair"].to_numpy()
        rows = rows.sort_values(["trie", "at", "u"], kind="stable")
        forest = Forest(len(distinct))
        for trie, part in rows.groupby("trie", sort=False):
            left, right = part[part["side"] == 0], part[part["side"] == 1]
            pairs = left["at"].to_numpy()
            a = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
            b, keys = np.append(a[1:], len(pairs)), pairs[a]
            c = np.searchsorted(right["at"].to_numpy(), keys)
            d = np.searchsorted(right["at"].to_numpy(), keys, "right")
            same = d == c
            shift = len(left)
            # One array for both sides: the right one follows the left one.
            paths = np.concatenate([left["u"].to_numpy(), right["u"].to_numpy()])
            ids = np.concatenate([left["index"].to_numpy(), right["index"].to_numpy()])
            c, d = np.where(same, a, c + shift), np.where(same, b, d + shift)
            # Nodes agree down to the top; the parts of a split node are traversed from there as well.
            err = np.zeros(len(a), np.int64)
            if len(a):
                for i, j in near_pairs(paths, paths, (a, b, c, d, err, same), depths[trie], radius):
                    forest.join(ids[i], ids[j])
        i, j = forest.links()
        if len(i):
            yield pd.DataFrame({"u": distinct[i], "v": distinct[j]})
    return run


def node_pairs(places: DataFrame, depths: list[int], radius: int, node_rows: int, node_bits: int) -> DataFrame:
    """The rows of all node pairs that a task can join: (pair, trie, side, path, fingerprint).

    Nodes below the top with up to ``node_rows`` rows are joined with themselves.  Larger ones go down in rounds of
    ``node_bits`` bits, each pair of parts only as far as it has to.
    """
    depth_of = F.element_at(F.array(*[F.lit(d) for d in depths]), F.col("trie") + 1)

    def node(bits) -> F.Column:
        depth = F.least(depth_of + bits, F.lit(BITS))
        return F.when(depth >= BITS, F.col("path")).otherwise(F.call_function(
            "shiftrightunsigned", F.col("path"), (F.lit(BITS) - depth).cast("int")))

    keyed = places.withColumn("node", F.col("top"))
    sizes = keyed.groupBy("trie", "node").count().where("count > 1")
    heavy = cut_lineage(sizes.where(F.col("count") > node_rows))
    pair = F.xxhash64("trie", "node")
    columns = ["pair", "trie", "side", "path", "fingerprint"]
    light = keyed.join(sizes.where(F.col("count") <= node_rows).select("trie", "node"), ["trie", "node"], "left_semi")
    found = light.select(pair.alias("pair"), "trie", F.lit(0).alias("side"), "path", "fingerprint")
    if heavy.isEmpty():
        return found
    rows = cut_lineage(keyed.join(heavy.select("trie", "node"), ["trie", "node"], "left_semi").drop("node"))
    # Pairs of nodes go down together, some bits at a time: parts that differ in more bits than the radius are pruned, pairs
    # of parts that a task can join are done, and only the others go on.  Nodes are counted, never collected.
    live = heavy.select("trie", F.col("node").alias("top"), F.col("node").alias("left"), F.col("node").alias("right"))
    for bits in range(node_bits, BITS + node_bits, node_bits):
        sizes = cut_lineage(rows.withColumn("node", node(bits)).withColumn("parent", node(bits - node_bits)).groupBy(
            "trie", "top", "parent", "node").agg(F.count(F.lit(1)).alias("count"), F.bit_and("path").alias("ones"), F.bit_or("path").alias("some")))

        def below(side: str) -> DataFrame:
            return sizes.select("trie", "top", F.col("parent").alias(side), F.col("node").alias(f"{side}_part"),
                                F.col("count").alias(f"{side}_rows"), F.col("ones").alias(f"{side}_ones"), F.col("some").alias(f"{side}_some"))

        pairs = cut_lineage(live.join(below("left"), ["trie", "top", "left"]).join(below("right"), ["trie", "top", "right"]).where(
            "(left <> right OR left_part <= right_part) AND (left_part <> right_part OR left_rows > 1)").where(
            F.bit_count(F.col("left_part").bitwiseXOR(F.col("right_part"))) <= radius).where(
            # Bits that all rows of a part have, or none has, differ for each pair of rows.
            F.expr("bit_count((left_ones & ~right_some) | (right_ones & ~left_some))") <= radius).drop(
            "left_ones", "left_some", "right_ones", "right_some"))
        # At the last bit a part is one fingerprint.
        small = F.lit(True) if bits >= BITS else (F.col("left_rows") <= node_rows) & (F.col("right_rows") <= node_rows)
        done = pairs.where(small).withColumn("pair", F.xxhash64("trie", "top", F.lit(bits), "left_part", "right_part"))
        sides = done.select("pair", "trie", "top", F.lit(0).alias("side"), F.col("left_part").alias("node")).unionByName(
            done.where("left_part <> right_part").select("pair", "trie", "top", F.lit(1).alias("side"), F.col("right_part").alias("node")))
        found = found.unionByName(rows.withColumn("node", node(bits)).join(sides, ["trie", "top", "node"]).select(*columns))
        live = pairs.where(~small).select("trie", "top", F.col("left_part").alias("left"), F.col("right_part").alias("right"))
        if live.isEmpty():
            break
    return found


def links(prints: DataFrame, *, radius: int = 4, node_rows: int = NODE_ROWS, node_bits: int = NODE_BITS) -> DataFrame:
    """``u``, ``v``: links that connect distinct ``fingerprint`` rows exactly as all pairs within ``radius`` bits do."""
    count = prints.count()
    equal = equal_blocks(count, radius)
    depths = [depth for _, depth in trie_orders(radius, equal)]
    places = prints.select("fingerprint").mapInPandas(
        place_task(radius, equal), "trie int, top long, path long, fingerprint long")
    pairs = node_pairs(cut_lineage(places), depths, radius, node_rows, node_bits)
    return pairs.repartition("pair").mapInPandas(join_task(depths, radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``u``, ``v``) but the roots themselves: the smallest node reachable.

    Alternates two contractions until nothing changes: all larger neighbours of a node, then the node
    and its smaller neighbours, are linked to the smallest of them.  Neighbours are never gathered: the
    smallest is an aggregate that is combined before the shuffle, and the join with it can be split.
    """
    def to_least(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        return pairs.join(least, "u")

    now, before = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        stars = to_least(large)
        small = stars.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            stars.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
        now = cut_lineage(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4,
    node_rows: int = NODE_ROWS, node_bits: int = NODE_BITS,
) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Rows are linked when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest id that can be reached, the row's own included.  A null or empty text, or one of white
    space only, has fingerprint zero and is linked like any other.  Repeated rows stay; null ids never
    are the smallest unless a component has no other; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = cut_lineage(fingerprints(docs, id=id, text=text, words=words))
    prints = cut_lineage(rows.groupBy("fingerprint").agg(F.min("id").alias("least")))
    roots = components(links(prints, radius=radius, node_rows=node_rows, node_bits=node_bits))
    classes = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    found = classes.select("fingerprint", "root").join(smallest, "root").select("fingerprint", "component_id")
    return rows.join(found, "fingerprint").select(
        F.col("id").alias(id), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

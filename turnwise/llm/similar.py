"""Similar documents: Jaccard similarity of the sets of shingles of five words, 0.8 or more.

Documents with the same set are one row from the start.  SimHash comes first: sets whose fingerprints are linked
by the trie self-join of ``simhash`` are compared with one set of their class, which joins copies with few
changes.  A radius that holds all pairs at 0.8 (16 bits and more) is beyond what a trie join can carry, so the
other candidates come from MinHash: ``BANDS`` bands of ``BAND`` minima each; documents that agree in a band
are in one bucket.  At similarity s a pair shares no bucket with probability (1 - s ** BAND) ** BANDS, two
in a million at 0.8.

Pairs of a bucket are never listed.  In the first rounds all its members are compared with one of them, which
joins groups of near copies.  Buckets that still hold several components are compared in tiles inside
tasks: first by their minima (a byte each; a pair at 0.8 agrees in fewer than ``AGREE`` of the hundred about once in
a million), each pair in the first band in which it agrees.  Only members with a partner that is near by
this measure go on to tiles with whole sets, where a product of incidence matrices gives the exact similarity
of all pairs; a tile reports a spanning forest.  So every link is exact, tables grow with the members and
not with the pairs, and a bucket of any size is spread over as many tasks as it needs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.base import partitions
from turnwise.llm.simhash import Forest, components, links, majority_bits, shingle_hashes
from turnwise.session import cut_lineage, cut_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
SIMILARITY = (4, 5)  # as a fraction, so 0.8 itself is no matter of rounding
BAND, BANDS = 4, 25
STARS = 1  # rounds in which a bucket is compared with one of its members
AT_ONCE = 1 << 12  # shingles whose minima are taken at a time
AGREE = 60  # of the BAND * BANDS minima
TILE = 512  # members of a bucket on one side of a tile
TILE_SHINGLES = 1 << 22  # and their shingles
PAIRS_AT_ONCE = 1 << 17
ROWS = 50_000  # of a task that compares minima
SETS = 4_000  # of a task that compares sets


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingle_hashes(text, words))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of ``BAND * BANDS`` mixtures."""
    draw = np.random.default_rng(5)
    mask, factor = draw.integers(0, 1 << 63, (2, BAND * BANDS), dtype=np.uint64)
    least = np.full(BAND * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), AT_ONCE):
        mixed = (hashes[at:at + AT_ONCE] ^ mask[:, None]) * (factor[:, None] | np.uint64(1))
        least = np.minimum(least, mixed.min(axis=1))
    return least


def buckets(least: np.ndarray) -> np.ndarray:
    """The numbers of the buckets of a set with these minima, one per band."""
    bands = least.reshape(BANDS, BAND)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64)


def set_task(words: int):
    """Task function: (id, text) to number, size, fingerprint, buckets and minima (a byte of each) of its set."""
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                hashes = shingle_hashes(text, words)
                own = np.unique(hashes)
                least = minima(own) if len(own) else none
                rows.append((
                    xxhash.xxh64_intdigest(own.tobytes()), len(own), majority_bits(hashes),
                    buckets(least) if len(own) else none, (least >> np.uint64(16)).astype(np.uint8).tobytes() if len(own) else b""))
            number, size, prints, places, sketch = map(list, zip(*rows)) if rows else ([], [], [], [], [])
            yield pd.DataFrame({
                "id": batch["id"], "set": np.array(number, np.uint64).view(np.int64), "size": np.array(size, np.int64),
                "fingerprint": np.array(prints, np.uint64).view(np.int64), "buckets": places, "sketch": sketch})
    return run


def body_task(words: int):
    """Task function: (set, text) to the shingles of the set as bytes, where the text is of this set (ids may repeat)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = [shingle_set(t, words).tobytes() for t in batch["text"]]
            numbers = np.array([xxhash.xxh64_intdigest(b) for b in bodies], np.uint64).view(np.int64)
            found = pd.DataFrame({"set": batch["set"], "body": bodies})
            yield found[numbers == batch["set"].to_numpy()]
    return run


def similar_sets(left: np.ndarray, right: np.ndarray, similarity: tuple[int, int]) -> bool:
    common = len(np.intersect1d(left, right, assume_unique=True))
    return common * similarity[1] >= (len(left) + len(right) - common) * similarity[0]


def verify_task(similarity: tuple[int, int]):
    """Task function: pairs with the bytes of both sets to the pairs that are similar."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [
                similar_sets(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity)
                for a, b in zip(batch["left"], batch["right"])]
            yield batch.loc[np.array(near, bool), ["u", "v"]]
    return run


def verified(pairs: DataFrame, bodies: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The rows of ``pairs`` (``u``, ``v``) whose sets are similar, stored."""
    return cut_texts(pairs.join(bodies.select(F.col("set").alias("u"), F.col("body").alias("left")), "u").join(
        bodies.select(F.col("set").alias("v"), F.col("body").alias("right")), "v").select(
            "u", "v", "left", "right").mapInPandas(verify_task(similarity), "u long, v long"))


# -- tiles of a bucket ----------------------------------------------------------------------------


def tiled(members: DataFrame, rows: int) -> DataFrame:
    """``members`` (``bucket``, ``set``, ``size``, ...) once for each tile they are in (``i``, ``j``, ``side``), dealt by tile.

    A bucket with more than ``TILE`` members is cut into parts; a tile is a pair of parts, or a part with itself.
    """
    parts = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_SHINGLES))
    large = members.groupBy("bucket").agg(parts.alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("set"), F.col("parts"))
    spread = members.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn(
        "part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tiles = cut_lineage(spread.select(
        *members.columns, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).cast("int").alias("side")))
    count = max(partitions(members.sparkSession), -(-tiles.count() // rows))
    return tiles.repartition(count, "bucket", "i", "j")


def in_tiles(batches: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray] | None:
    """The rows of a partition by tile; the first row of the tile of each row, and how many rows from there are its partners."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return None
    rows = pd.concat(frames, ignore_index=True).sort_values(["bucket", "i", "j", "side"], kind="stable", ignore_index=True)
    keys = rows[["bucket", "i", "j"]].to_numpy()
    first = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    tile = np.cumsum(first) - 1
    start = np.flatnonzero(first)[tile]
    lefts = np.bincount(tile, rows["side"].to_numpy() == 0).astype(np.int64)[tile]
    own = keys[:, 1] == keys[:, 2]
    partners = np.where(own, np.arange(len(rows)) - start, np.where(rows["side"] == 1, lefts, 0))
    return rows, start, partners


def pair_chunks(start: np.ndarray, partners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of all rows with their partners, some at a time."""
    upto = np.cumsum(partners)
    at = 0
    while at < len(start):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        number = partners[at:end]
        which = np.repeat(np.arange(at, end), number)
        place = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
        yield which, start[which] + place
        at = end


def sketch_task(similarity: tuple[int, int]):
    """Task function: tiles with minima to the members (bucket, set) that have a near partner in another component.

    A pair counts in the first band in which it agrees, so that it is near in one bucket only.
    """
    few, many = similarity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = in_tiles(batches)
        if found is None:
            return
        rows, start, partners = found
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
        places = np.stack(rows["buckets"].to_list())
        bucket, size, component = (rows[c].to_numpy() for c in ("bucket", "size", "component"))
        near = np.zeros(len(rows), bool)
        for a, b in pair_chunks(start, partners):
            fits = (component[a] != component[b]) & (size[a] * many >= size[b] * few) & (size[b] * many >= size[a] * few)
            a, b = a[fits], b[fits]
            fits = (sketch[a] == sketch[b]).sum(axis=1) >= AGREE
            a, b = a[fits], b[fits]
            same = places[a] == places[b]
            fits = places[a, same.argmax(axis=1)] == bucket[a]
            near[a[fits]] = near[b[fits]] = True
        yield pd.DataFrame({"bucket": bucket[near], "set": rows["set"].to_numpy()[near]})
    return run


def common_counts(sets: list[np.ndarray], cut: int = 0, columns: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of the sets before ``cut`` with those behind it, without a cut of all with all.

    Products of incidence matrices, some columns at a time; shingles of a single set have none.  Without
    a cut the diagonal holds no sizes.
    """
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    owner, column = owner[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    counts = np.zeros((cut or len(sets), len(sets) - cut), np.float32)
    for at in range(0, int(shared.sum()), columns):
        part = slice(*np.searchsorted(column, [at, at + columns]))
        matrix = np.zeros((len(sets), columns), np.float32)
        matrix[owner[part], column[part] - at] = 1
        counts += matrix[:cut or None] @ matrix[cut:].T
    return counts


def tile_task(similarity: tuple[int, int]):
    """Task function: tiles with whole sets to links (u, v) of similar sets, a spanning forest."""
    few, many = similarity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = in_tiles(batches)
        if found is None:
            return
        rows, start, _ = found
        side = rows["side"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in rows["body"]]
        size = np.array([len(s) for s in sets])
        distinct, index = np.unique(rows["set"].to_numpy(), return_inverse=True)
        forest = Forest(len(distinct))
        heads = np.unique(start)
        for at, end in zip(heads, np.append(heads[1:], len(rows))):
            # Without rows of side 1 a tile is a part with itself; otherwise both sides follow each other.
            cut = int((side[at:end] == 0).sum()) % (end - at)
            common = common_counts(sets[at:end], cut)
            left, right = size[at:at + cut if cut else end], size[at + cut:end]
            near = common * many >= (left[:, None] + right[None, :] - common) * few
            i, j = np.nonzero(near if cut else np.triu(near, 1))
            forest.join(index[at + i], index[at + cut + j])
        i, j = forest.links()
        yield pd.DataFrame({"u": distinct[i], "v": distinct[j]})
    return run


# -- groups ---------------------------------------------------------------------------------------


def with_components(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` of buckets that hold several components, with their ``component``."""
    found = members.withColumn("component", F.col("set"))
    if roots is not None:
        found = members.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn(
            "component", F.coalesce("root", "set")).drop("root")
    open_ = found.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    return found.join(open_.select("bucket"), "bucket", "left_semi")


def fingerprint_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """``u``, ``v``: each set and the smallest set of its class of linked fingerprints."""
    prints = cut_lineage(sets.select("fingerprint").distinct())
    roots = components(links(prints, radius=radius))
    classes = sets.select("set", "fingerprint").distinct().join(
        roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("class", F.coalesce("root", "fingerprint"))
    first = classes.groupBy("class").agg(F.min("set").alias("u"), F.count("*").alias("members")).where("members > 1")
    return classes.join(first, "class").where("set <> u").select("u", F.col("set").alias("v")).distinct()


def similar_groups(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY,
    radius: int = 4,
) -> DataFrame:
    """``id`` and ``first`` of every row: the smallest id that can be reached over similar documents.

    Texts without a word are similar to each other, texts shorter than a shingle to those of the same
    words.  Texts count whole, however long.  Repeated rows stay; null ids come before the others; other columns are ignored;
    an empty table gives an empty result.
    """
    key = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    sets = cut_texts(rows.mapInPandas(
        set_task(words), f"id {key}, set long, size long, fingerprint long, buckets array<long>, sketch binary"))
    places = sets.select("set", "size", F.explode("buckets").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.min("set").alias("a"), F.max("set").alias("b")).where("a < b").select("bucket")
    members = cut_lineage(places.join(shared, "bucket", "left_semi").distinct())
    least = sets.groupBy("set").agg(F.min("id").alias("least"))
    copies = cut_lineage(fingerprint_pairs(sets.where("size > 0"), radius))
    named = members.select("set").union(copies.select("u")).union(copies.select("v")).distinct()
    chosen = least.join(named, "set", "left_semi")
    texts = rows.join(chosen, rows["id"].eqNullSafe(chosen["least"])).select("set", "text")
    bodies = cut_texts(texts.mapInPandas(body_task(words), "set long, body binary").dropDuplicates(["set"]))

    few, many = similarity
    fits = (F.col("size") * many >= F.col("other_size") * few) & (F.col("other_size") * many >= F.col("size") * few)
    found = [verified(copies, bodies, similarity)]
    for round_ in range(STARS):
        members = cut_lineage(with_components(members.select("bucket", "set", "size"), joined(found)))
        # The same set is the centre of as many buckets as possible, so that pairs coincide.
        centres = members.groupBy("bucket").agg(F.min_by(F.struct(
            F.col("set").alias("other"), F.col("size").alias("other_size"), F.col("component").alias("other_component")),
            F.struct(F.xxhash64("set", F.lit(round_)), "set")).alias("c")).select("bucket", "c.*")
        pairs = members.join(centres, "bucket").where((F.col("component") != F.col("other_component")) & fits).select(
            F.least("set", "other").alias("u"), F.greatest("set", "other").alias("v")).distinct()
        found.append(verified(pairs, bodies, similarity))
    members = cut_lineage(with_components(members.select("bucket", "set", "size"), joined(found)))
    sketches = sets.join(members.select("set").distinct(), "set", "left_semi").select("set", "buckets", "sketch").dropDuplicates(["set"])
    near = cut_texts(tiled(members.join(sketches, "set"), ROWS).mapInPandas(sketch_task(similarity), "bucket long, set long").distinct())
    whole = near.join(bodies, "set").withColumn("size", (F.octet_length("body") / 8).cast("long"))
    found.append(cut_texts(tiled(whole, SETS).mapInPandas(tile_task(similarity), "u long, v long")))

    classes = least.join(joined(found).withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    firsts = classes.groupBy("root").agg(F.min("least").alias("first"))
    return sets.join(classes.join(firsts, "root").select("set", "first"), "set").select(F.col("id").alias(id), "first")


def joined(found: list[DataFrame]) -> DataFrame:
    return cut_lineage(components(reduce(DataFrame.unionByName, found)))

"""Hard negatives by Fagin's threshold algorithm over blocks of rows.

Rows are dealt into blocks of at most ``BLOCK`` rows by ranges of (label, hash of the id), anchors into
chunks likewise, each block and chunk one row of a stored table.  A task takes pairs of a chunk and a
block.  In a block every dimension has its list of candidates sorted by component.  For an anchor the
lists are read from the end that its sign favours (sorted access), rows that come up are scored by their
integer inner product (random access), and the threshold is the score that a row not yet met could
reach at most.  The anchor is done with the block once the threshold falls strictly below the kth
score of each of its windows, or below what the window accepts; the best of each block are merged.

The positives come first, from blocks that hold the anchor's label.  They fix the windows of scores
for the negatives, which are sought in all blocks that hold another label.  Work is that of the
anchors (a stated query set) against all rows, in blocks; no pair of rows ever is a row of a table
unless it is among the best of its block.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.base import query, table
from turnwise.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 8_192  # rows of a block
CHUNK = 1_024  # anchors of a chunk
PAIRS = 16  # pairs of a chunk and a block in a task
FIRST_DEPTH = 16  # of the lists; then four times as deep each time
PACKED = "number long, ids binary, labels binary, vectors binary, kind string, windows binary"
BEST = "anchor long, low long, high long, row long, score long"


# -- blocks and chunks ----------------------------------------------------------------------------


def narrow(values: np.ndarray) -> np.ndarray:
    """The values in the smallest integer type that holds them."""
    top = max(int(values.max(initial=0)), -int(values.min(initial=0)))
    return values.astype(next(t for t in (np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def pack_task(size: int):
    """Task function: rows (id, label, vector, windows) to packed rows of at most ``size`` of them; ``kind`` tells their type."""
    def packed(rows: pd.DataFrame) -> dict:
        width = max(map(len, rows["vector"]))
        vectors = np.zeros((len(rows), width), np.int64)  # shorter vectors end in zeros
        for line, v in zip(vectors, rows["vector"]):
            line[:len(v)] = v
        vectors = narrow(vectors)
        most = max(map(len, rows["windows"]))
        windows = np.full((len(rows), most), -1, np.int64)
        for line, w in zip(windows, rows["windows"]):
            line[:len(w)] = w
        return {
            "number": 0, "ids": rows["id"].to_numpy(np.int64).tobytes(), "labels": rows["label"].to_numpy(np.int64).tobytes(),
            "vectors": vectors.tobytes(), "kind": vectors.dtype.char, "windows": windows.tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in batches:
            held, count = [*held, batch], count + len(batch)
            while count >= size:
                rows = pd.concat(held, ignore_index=True)
                yield pd.DataFrame([packed(rows.iloc[:size])])
                held, count = [rows.iloc[size:]], count - size
        if count:
            yield pd.DataFrame([packed(pd.concat(held, ignore_index=True))])
    return run


def packs(rows: DataFrame, size: int, count: int) -> DataFrame:
    """``rows`` (id, label, vector, windows), ``count`` of them, as a stored table of packs, with their numbers and distinct labels."""
    dealt = rows.repartitionByRange(max(1, -(-count // size)), "label", F.xxhash64("id"), "id")
    made = cut_lineage(dealt.mapInPandas(pack_task(size), PACKED))
    return cut_lineage(made.withColumn("number", F.monotonically_increasing_id()))


def label_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task function: packs to (number, label), each label once."""
    for batch in batches:
        for number, labels in zip(batch["number"], batch["labels"]):
            own = np.unique(np.frombuffer(labels, np.int64))
            yield pd.DataFrame({"number": np.full(len(own), number), "label": own})


def labels_of(packed: DataFrame, name: str) -> DataFrame:
    """``name`` (number of the pack) and ``label``, for each label of a pack."""
    return packed.select("number", "labels").mapInPandas(label_task, "number long, label long").withColumnRenamed("number", name)


# -- threshold algorithm --------------------------------------------------------------------------


class Block:
    """Rows with their per-dimension lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        order = np.argsort(vectors, axis=0, kind="stable").T  # a list for each dimension, ascending
        self.lists = np.stack([order, order[:, ::-1]])  # read from below, from above
        columns = np.arange(vectors.shape[1])[:, None]
        self.values = vectors[order, columns]

    def threshold(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """The score that rows not yet met at ``depth`` of the lists can reach at most, for each anchor."""
        return np.maximum(anchors, 0) @ self.values[:, -depth] + np.minimum(anchors, 0) @ self.values[:, depth - 1]

    def met(self, anchor: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Rows in places ``start`` to ``stop`` of the lists, read from the end that the anchor's sign favours."""
        used = np.flatnonzero(anchor)
        return np.unique(self.lists[(anchor[used] > 0).astype(np.intp), used, start:stop])


class Best:
    """The best ``k`` rows of one window of scores."""

    def __init__(self, low: int | None, high: int | None, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = np.ones(len(scores), bool)
        if self.low is not None:
            fits &= (scores >= self.low) & (scores <= self.high)
        if len(self.scores) == self.k:
            fits &= scores >= self.scores[-1]
        if fits.any():
            scores, ids = np.concatenate([self.scores, scores[fits]]), np.concatenate([self.ids, ids[fits]])
            order = np.lexsort([ids, -scores])[:self.k]
            self.scores, self.ids = scores[order], ids[order]

    def done(self, threshold: float) -> bool:
        """Whether no row that can reach at most ``threshold`` can come in."""
        if len(self.scores) == self.k:
            return threshold < self.scores[-1]
        return self.low is not None and threshold < self.low


def exact(left: np.ndarray, right: np.ndarray) -> np.dtype:
    """The type in which inner products of integer rows are exact."""
    top = max(1, left.shape[1]) * int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0))
    if top >= 1 << 62:
        raise ValueError("inner products of these vectors pass 64 bits")
    return np.dtype(np.float64 if top < 1 << 52 else np.int64)


def search(block: Block, anchors: np.ndarray, fits: list[np.ndarray], wanted: list[list[Best]]) -> None:
    """Fills ``wanted`` (the windows of each anchor) with the best rows of the block among those that ``fits`` marks."""
    rows = len(block.ids)
    live = [a for a in range(len(anchors)) if wanted[a] and fits[a].any()]
    seen = {a: np.zeros(rows, bool) for a in live}
    depth = 0
    while live:
        following = max(FIRST_DEPTH, depth * 4)
        # The lists of all dimensions together name every row long before they end.
        last = following * 4 >= rows or not anchors.shape[1]
        # A product for a bounded number of anchors at a time.
        for at in range(0, len(live), 64):
            some = live[at:at + 64]
            scores = block.vectors @ anchors[some].T if last else None
            for place, a in enumerate(some):
                new = ~seen[a]
                if not last:
                    met = np.zeros(rows, bool)
                    met[block.met(anchors[a], depth, following)] = True
                    new &= met
                    seen[a] |= met
                which = np.flatnonzero(new & fits[a])
                found = (scores[which, place] if last else block.vectors[which] @ anchors[a]).astype(np.int64)
                for best in wanted[a]:
                    best.add(found, block.ids[which])
        if last:
            return
        depth = following
        for a, threshold in zip(list(live), block.threshold(anchors[live], depth).tolist()):
            if all(best.done(threshold) for best in wanted[a]):
                live.remove(a)
                del seen[a]


def unpack(ids: bytes, labels: bytes, vectors: bytes, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(labels, np.int64), np.frombuffer(vectors, kind).reshape(len(ids), -1)


def search_task(same_label: bool, k: int, share: tuple[int, int]):
    """Task function: pairs of a chunk and a block to the best rows of the block for each anchor and window.

    Positives have the anchor's label, and one open window; negatives another label, and a window for each
    score p of a positive: ``share[0] * p <= share[1] * score <= share[1] * p``.
    """
    def windows(scores: np.ndarray) -> list[Best]:
        if same_label:
            return [Best(None, None, k)]
        return [Best(-(-share[0] * p // share[1]), p, k) for p in scores.tolist() if p >= 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, labels, vectors = unpack(r.ids, r.labels, r.vectors, r.kind)
                own, own_labels, anchors = unpack(r.a_ids, r.a_labels, r.a_vectors, r.a_kind)
                width = min(vectors.shape[1], anchors.shape[1])  # what lies beyond is multiplied by nothing
                kind = exact(anchors[:, :width], vectors[:, :width])
                block = Block(ids, labels, np.ascontiguousarray(vectors[:, :width], kind))
                wanted = [windows(w) for w in np.frombuffer(r.a_windows, np.int64).reshape(len(own), -1)]
                if same_label:
                    fits = [(labels == lab) & (ids != i) for lab, i in zip(own_labels, own)]
                else:
                    fits = [labels != lab for lab in own_labels]
                search(block, anchors[:, :width].astype(kind), fits, wanted)
                parts = [
                    (np.full(len(b.ids), i), np.full(len(b.ids), b.low or 0), np.full(len(b.ids), b.high or 0), b.ids, b.scores)
                    for i, some in zip(own, wanted) for b in some]
                if parts:
                    yield pd.DataFrame(dict(zip(["anchor", "low", "high", "row", "score"], map(np.concatenate, zip(*parts)))))
    return run


def best_of_pairs(pairs: DataFrame, chunks: DataFrame, blocks: DataFrame, count: int, **how) -> DataFrame:
    """The best rows of all ``pairs`` (chunk, block)."""
    left = chunks.select(F.col("number").alias("chunk"), *[
        F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "vectors", "kind", "windows")])
    right = blocks.select(F.col("number").alias("block"), "ids", "labels", "vectors", "kind")
    dealt = pairs.join(left, "chunk").join(right, "block").repartition(max(1, -(-count // PAIRS)), "chunk", "block")
    return dealt.mapInPandas(search_task(**how), BEST)


def ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(
    vectors: DataFrame, anchor: Column, *, id: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5,
    negatives: int = 5, share: tuple[int, int] = (80, 100), block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``vectors`` has integer ids, integer labels and arrays of integers; rows where ``anchor`` is true are
    anchors.  An anchor's positives are its ``positives`` best other rows of its label, by inner product, ties by
    smaller id.  For each of them the ``negatives`` best rows of other labels are returned whose score is at least
    ``share`` of the positive's and not above it; none for a positive below zero.

    Rows with a null id, label, vector or component take no part.  Of rows with one id the least by label and vector
    counts.  Shorter vectors end in zeros.  Other columns are ignored, an empty table gives an empty result, and
    inner products that may pass 62 bits end the job.
    """
    spark = vectors.sparkSession
    usable = vectors.select(
        F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    rows = cut_lineage(usable.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("r")).select("id", "r.*"))
    count, anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not anchors:
        return spark.createDataFrame([], schema)
    none = F.array(F.lit(-1).cast("long"))
    blocks = packs(rows.withColumn("windows", none).drop("anchor"), block, count)
    queries = rows.where("anchor").drop("anchor")
    chunks = packs(queries.withColumn("windows", none), chunk, anchors)

    in_block = cut_lineage(labels_of(blocks, "block"))
    in_chunk = labels_of(chunks, "chunk")
    pairs = cut_lineage(in_chunk.join(in_block, "label").select("chunk", "block").distinct())
    close = best_of_pairs(pairs, chunks, blocks, pairs.count(), same_label=True, k=positives, share=share)
    found = cut_lineage(ranked(close, ["anchor"], positives).select("anchor", "row", "score"))

    windows = found.where("score >= 0").groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("windows"))
    asking = cut_lineage(queries.join(windows, "id"))
    left = asking.count()
    if not left:
        return spark.createDataFrame([], schema)
    chunks = packs(asking, chunk, left)
    numbers = labels_of(chunks, "chunk").groupBy("chunk").agg(
        F.min("label").alias("least"), F.max("label").alias("most"))
    # Each chunk meets each block, as the stated queries must, but for those that only hold its own label.
    held = in_block.groupBy("block").agg(F.min("label").alias("first"), F.max("label").alias("last")).withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.lit(numbers.count() - 1))))
    pairs = cut_lineage(
        numbers.withColumn("k", F.row_number().over(Window.orderBy("chunk")) - 1).join(held, "k").where(
            "first <> last OR least <> most OR first <> least").select("chunk", "block"))
    hard = best_of_pairs(pairs, chunks, blocks, pairs.count(), same_label=False, k=negatives, share=share)
    per_score = ranked(hard, ["anchor", "high"], negatives).select("anchor", F.col("high").alias("positive_score"), "rank", "row", "score")
    return found.withColumnRenamed("row", "positive_id").withColumnRenamed("score", "positive_score").join(
        per_score, ["anchor", "positive_score"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
            F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5"""


@query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(
        "label IS NOT NULL AND embedding IS NOT NULL AND "
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('infinity'))")
    whole = rows.select(
        "vec_id", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("vector"))
    return mine_negatives(whole, F.col("vec_id") % 100 == 0)

"""Best-fit packing of documents into sequences, planned over the histogram of lengths.

The plan needs the number of pieces of each length and not the pieces, so it is made on the driver
from at most ``capacity`` numbers, and its size is bounded by the capacity alone.  A piece then takes
the slot that the plan has for its rank among the pieces of its length.  Ranks are counted where the
pieces are made, per task and length, and shifted by the counts of earlier tasks, so a length that
a third of all pieces have is never sorted or gathered.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.base import kept, query, table
from turnwise.session import cut_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 4_096
END = 1  # the id that ends a document
KEPT_WORDS = 500_000  # words whose ids a worker process keeps
KEPT_LENGTH = 64  # characters of the longest word that is kept
TOGETHER = 200  # documents whose new words are encoded in one call


# -- tokens ---------------------------------------------------------------------------------------


class WordEncoder:
    """Ids of texts for a tokenizer that drops white space, from the ids of their words.

    For such a tokenizer the ids of a text are those of its parts between blanks, one after the other.
    Words that were met before are looked up; the memory is filled once and bounded.  Texts of Latin-1
    letters are put into lower case first, as the tokenizer does it itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {"": b""}

    def _words(self, text: str) -> list[str]:
        if "<|" not in text:  # special tokens keep their case
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, in one call for those of Latin-1 letters, which normalisation doesn't compose."""
        simple = [len(w) <= KEPT_LENGTH and max(w) < "\u0100" for w in words]
        plain = [w for w, s in zip(words, simple) if s]
        other = [w for w, s in zip(words, simple) if not s]
        out = {}
        if plain:
            found = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in plain])
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            cut = (4 * np.searchsorted(at, starts)).tolist()
            raw = np.asarray(found.ids, "<u4").tobytes()
            out = {w: raw[cut[i]:cut[i + 1]] for i, w in enumerate(plain)}
        for word, found in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            out[word] = np.asarray(found.ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = [self._words(t) for t in texts]
        missing = set().union(*parts).difference(self.known)
        if not missing:
            return [b"".join(map(self.known.__getitem__, words)) for words in parts]
        room = KEPT_WORDS - len(self.known)
        new = self._new(list(missing))
        self.known.update(new)
        found = [b"".join(map(self.known.__getitem__, words)) for words in parts]
        for at, word in enumerate(new):  # the memory is filled once
            if at >= room or len(word) > KEPT_LENGTH:
                del self.known[word]
        return found


def piece_task(tokenizer: str, capacity: int, end: int):
    """Task function: (id, text) to pieces, with their ranks among the task's pieces of their length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = kept(f"words {tokenizer}", lambda: WordEncoder(tokenizer))
        task, seen, last = TaskContext.get().partitionId(), Counter(), np.asarray([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                some = batch.iloc[at:at + TOGETHER]
                rows = []
                for key, ids in zip(some["id"], encoder.encode([t or "" for t in some["text"]])):
                    ids += last
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start:start + 4 * capacity]
                        length = len(part) // 4
                        rows.append((key, piece, start // 4, length, part, zlib.crc32(part), task, seen[length]))
                        seen[length] += 1
                yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids", "ids_crc32", "task", "rank"])
    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
) -> DataFrame:
    """The pieces of all documents, stored: ids (little-endian unsigned 32 bit) and their place in the document."""
    key = docs.schema[id].dataType.simpleString()
    return cut_texts(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(
        piece_task(tokenizer, capacity, end),
        f"id {key}, piece int, start long, length long, ids binary, ids_crc32 long, task int, rank long"))


# -- plan -----------------------------------------------------------------------------------------


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slots for pieces by length and rank: rows (length, first rank, first sequence, offset).

    Lengths are placed from long to short, each piece where the least room is left that holds it, all
    equal cases at once: runs of sequences with the same content are one entry.  Rows of one length
    cover its ranks without gaps; the k-th rank of a row is in the k-th sequence from its first.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: runs (first, end) of sequences
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank, space = histogram[length], 0, length
        while left:
            while space < capacity and not room[space]:
                space += 1
            if not room[space]:  # nothing open has room
                sequences += (new := -(-left // (capacity // length)))
                room[capacity].append((sequences - new, sequences))
                space = capacity
            first, end = room[space].pop()
            each = min(space // length, left)  # pieces that fill a sequence as far as they go
            full = min(end - first, left // each)
            for i in range(each):
                slots.append((length, rank, first, capacity - space + i * length))
                rank += full
            left -= each * full
            if first + full < end:
                room[space].append((first + full, end))
            room[space - each * length].append((first, first + full))
    return np.array(slots, np.int64).reshape(-1, 4)


def slot_of(length: Column, rank: Column, slots: np.ndarray) -> Column:
    """``sequence_id`` and ``offset`` of the piece with this rank among those of its length."""
    ordered = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    ends = np.searchsorted(ordered[:, 0], np.arange(ordered[:, 0].max(initial=0) + 2))

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        # Lengths are small and ranks below 2^48, so one number orders both.
        at = np.searchsorted((ordered[:, 0] << 48) + ordered[:, 1], (n << 48) + r, "right") - 1
        assert (at >= ends[n]).all()
        return pd.DataFrame({"sequence_id": ordered[at, 2] + r - ordered[at, 1], "offset": ordered[at, 3]})

    return look_up(length, rank)


def pack(
    docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END,
) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``capacity`` tokens.

    ``id``, ``piece`` (from 0), ``start`` (ids of the document before it), ``length``, ``ids`` (binary,
    little-endian unsigned 32 bit), ``ids_crc32``, ``sequence_id`` (from 0, without gaps) and ``offset``.
    A document is the tokenizer's ids and then ``end``; only longer ones are cut, after each ``capacity``
    ids.  A null or empty text is the single id ``end``.  Repeated rows and rows with null ids are packed
    one by one; an empty table gives an empty result; other columns are ignored.  Which of several
    pieces of equal length gets which slot may differ between runs, the number of sequences not.
    """
    pieces = token_pieces(docs, tokenizer, id=id, text=text, capacity=capacity, end=end)
    counts = pieces.groupBy("length", "task").count()
    # At most one row per length.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = F.sum("count").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("shift"))
    slot = slot_of(F.col("length"), F.col("rank") + F.col("shift"), plan_slots(histogram, capacity))
    return pieces.join(shifts, ["task", "length"]).withColumn("slot", slot).select(
        F.col("id").alias(id), "piece", "start", "length", "ids", "ids_crc32", "slot.sequence_id", "slot.offset")


def packed_digest(docs: DataFrame) -> DataFrame:
    """The places of all pieces in sequences of 4096 ids of the public word tokenizer."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))

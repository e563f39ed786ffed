"""Token counts with a digest cache.

A count depends on the text and the tokenizer only, so it is stored under the SHA-256 of the text and
a digest of the tokenizer's file and library version.  Texts whose digest is in the cache are not
encoded; of the others one copy each is encoded, and the new counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.base import full, kept, query, table
from turnwise.session import new_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHE = "digest binary, tokenizer string, n_tokens long"
TOGETHER = 64  # texts that are encoded in one call


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer: its file and the version of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as file:
        return hashlib.sha256(library.encode() + b"\0" + file.read()).hexdigest()


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(x, add_special_tokens=False)) for x in texts]


def count_texts(path: str):
    """Task function: (digest, text) rows to (digest, n_tokens) rows; a few texts at a time leave the Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = kept(f"counter {path}", lambda: _counter(path))
        for batch in batches:
            texts, n = batch.column("text"), []
            for i in range(0, len(texts), TOGETHER):
                n += count(texts.slice(i, TOGETHER).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])
    return run


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The stored counts; none if the folder is new."""
    try:
        return spark.read.schema(CACHE).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, *, id: str = "doc_id", text: str = "text", limit: int = 4096,
) -> DataFrame:
    """``id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``) of every row.

    ``tokenizer`` is a ``.model`` or ``.json`` file that every executor can read, ``cache`` a folder in
    shared storage.  A null text counts as empty.  Rows with equal or null ids are counted one by one,
    equal texts are encoded once; an empty table gives an empty result and leaves the cache as it is.
    Other columns are ignored.  No begin, end or added special tokens; special strings inside texts are
    treated as the library does by default; nothing is cut or padded.

    Two jobs that run at once may append the same count twice; reads take one of equal rows.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    rows = docs.select(F.col(id).alias("id"), full(text).alias("text")).withColumn(
        "digest", F.unhex(F.sha2("text", 256)))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version)
    # Copies meet in the map tasks first, so a text of many copies is sent once by each of them.
    misses = rows.select("digest", "text").join(known.select("digest"), "digest", "left_anti").groupBy("digest").agg(
        F.first("text").alias("text"))
    misses.mapInArrow(count_texts(tokenizer), "digest binary, n_tokens long").select(
        "digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(
        F.max("n_tokens").alias("n_tokens"))
    return rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "digest").select(
        F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), new_folder(spark, "token-counts"))

"""Sinks: snapshots, TSV, JSON maps, split tables, pseudonymised folders."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.text import list_literal, text_list_literal
from turnwise.operators.identity import apply_map
from turnwise.sources.readers import _readable, tsv_layouts

# Executors get task functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def latest_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """Newest snapshot and its number; the number comes from the partition folders alone."""
    if not _readable(spark, path):
        return None, 0
    rows = spark.read.parquet(path)
    newest = rows.select("snapshot").distinct().agg(F.max("snapshot")).first()[0]
    return rows.where(F.col("snapshot") == newest).drop("snapshot"), newest


def rows_digest(rows: DataFrame) -> dict:
    """Columns, number of rows and the sums of two 64-bit hashes of the rows: equal for the same rows in any order.

    Rows that repeat count as often as they are there, and a null is told from any value.  Two tables of different rows
    have one digest with a probability of about 2 ** -128.
    """
    columns = sorted(rows.columns)
    cells = [c for name in columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    sums = [F.sum(F.xxhash64(F.lit(k), *cells).cast("decimal(38,0)")).cast("string").alias(f"sum{k}") for k in (1, 2)]
    row = rows.agg(F.count(F.lit(1)).alias("rows"), *sums).first()
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return {"columns": [f"{c} {kinds[c]}" for c in columns], **row.asDict()}


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equality as multisets, by the digests of both."""
    return rows_digest(a) == rows_digest(b)


def _digest_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/_digests/{number}"  # a name that table scans leave out


def snapshot_digest(spark: SparkSession, path: str, number: int) -> dict:
    """The stored digest of a snapshot; of one without it is computed."""
    stored = _digest_path(path, number)
    if _readable_text(spark, stored):
        return json.loads(spark.read.text(stored).first()["value"])
    return rows_digest(spark.read.parquet(path).where(F.col("snapshot") == number).drop("snapshot"))


def _readable_text(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException
    try:
        return not spark.read.text(path).isEmpty()
    except AnalysisException:
        return False


def save_snapshot(rows: DataFrame, path: str) -> int:
    """Append a numbered snapshot unless the newest one has the same rows.

    Whether it has is told by the digest of the new rows and the one that is stored beside the snapshot, so an unchanged
    table is read once and the snapshots not at all.
    """
    spark = rows.sparkSession
    old, number = latest_snapshot(spark, path)
    digest = rows_digest(rows)
    if old is not None and digest == snapshot_digest(spark, path, number):
        return number
    rows.withColumn("snapshot", F.lit(number + 1)).write.mode("append").partitionBy("snapshot").parquet(path)
    spark.createDataFrame([(json.dumps(digest),)], "value string").coalesce(1).write.mode("overwrite").text(_digest_path(path, number + 1))
    return number + 1


def write_tsv(rows: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """TSV without index; arrays of texts become JSON arrays, other arrays list literals."""
    def flat(field):
        kind = field.dataType.simpleString()
        if not kind.startswith("array"):
            return F.col(f"`{field.name}`")
        literal = text_list_literal if kind == "array<string>" else list_literal
        return literal(F.col(f"`{field.name}`")).alias(field.name)

    # Quotes inside a text are doubled, as the reader expects them; blanks at its ends stay.
    rows.select(*[flat(f) for f in rows.schema.fields]).write.mode("overwrite").option("sep", "\t").option(
        "header", True).option("encoding", encoding).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json_map(rows: DataFrame, path: str, key: str = "qid", value: str = "prompt", one_object: bool = False) -> None:
    """``key`` to ``value`` as JSON maps in key order: one entry per line, each a map of its own.

    With ``one_object`` the folder holds a single file with one map, for tools that want that; it is written by one task.
    """
    entry = F.to_json(F.create_map(F.col(key).cast("string"), F.col(value)))
    if not one_object:
        rows.orderBy(key).select(entry).write.mode("overwrite").text(path)
        return
    lines = rows.select(F.col(key).cast("string").alias("key"), entry.alias("line")).withColumn(
        "line", F.expr("substring(line, 2, length(line) - 2)"))
    last = lines.agg(F.max("key")).first()[0]
    body = lines.select(F.lit(1).alias("part"), "key", F.when(F.col("key") == last, F.col("line")).otherwise(
        F.concat("line", F.lit(","))).alias("line"))
    ends = rows.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "part int, key string, line string")
    body.unionByName(ends).coalesce(1).sortWithinPartitions("part", "key").select("line").write.mode("overwrite").text(path)


def array_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task function: the objects of a partition as the elements of one array."""
    held, start = None, "["
    for batch in batches:
        for value in batch["value"]:
            if held is not None:
                yield pd.DataFrame({"value": [f"{start}{held},"]})
                start = ""
            held = value
    if held is not None:
        yield pd.DataFrame({"value": [f"{start}{held}]"]})


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """Files with one JSON array each, on one line; as many files as ``rows`` has partitions."""
    rows.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(array_task, "value string").write.mode(
        "overwrite").option("lineSep", " ").text(path)


def pending_requests(requests: DataFrame, path: str, keys: tuple[str, ...] = ("qid", "rep")) -> DataFrame:
    """Requests without an answer at ``path`` yet: how an interrupted run goes on."""
    spark = requests.sparkSession
    from pyspark.errors import AnalysisException
    try:
        done = spark.read.json(path)
        if not set(keys) <= set(done.columns):
            return requests
    except AnalysisException:
        return requests
    typed = done.select(*[F.col(k).cast(requests.schema[k].dataType).alias(k) for k in keys])
    return requests.join(typed, list(keys), "left_anti")


def append_answers(answers: DataFrame, path: str) -> None:
    answers.write.mode("append").json(path)


def write_split_tables(rows: DataFrame, split: DataFrame, path: str, key: str = "qid") -> None:
    """Rows partitioned by split, written once."""
    rows.join(split.select(key, "split"), key).write.mode("ignore").partitionBy("split").parquet(path)


def read_split_ids(spark: SparkSession, path: str, split: str, key: str = "qid") -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).select(key).distinct().orderBy(key)


ID_COLUMNS = ("Q-PID", "Annotator", "Participant id")


def write_anonymised(
    spark: SparkSession, source: str, names: DataFrame, target: str, prefix: str = "ANON_", pattern: str = "*.tsv",
) -> int:
    """Pseudonymised copies of the TSV files of a folder, without finished ones and unknown kinds; how many layouts.

    One job for each layout (encoding and header line), whatever the number of files: its rows are
    written to ``target/layout=<n>/file=<prefix><name>``.
    """
    layouts = tsv_layouts(spark, f"{source.rstrip('/')}/{pattern}")
    for n, (columns, rows) in enumerate(layouts):
        column = next((c for c in ID_COLUMNS if c in columns), None)
        if column is None:
            continue
        mapped = apply_map(rows.where(~F.startswith("file", F.lit(prefix))), names, column).select(
            *[F.col(f"`{c}`") for c in columns], F.concat(F.lit(prefix), "file").alias("file"))
        mapped.write.mode("overwrite").partitionBy("file").option("sep", "\t").option("header", True).option(
            "escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(
                f"{target.rstrip('/')}/layout={n}")
    return len(layouts)


def anonymise_folder(
    spark: SparkSession, source: str, names: DataFrame, target: str, prefix: str = "ANON_", pattern: str = "*.tsv",
) -> list[str]:
    """``write_anonymised``, and the folders that it wrote by name: for folders with a moderate number of files."""
    layouts = write_anonymised(spark, source, names, target, prefix, pattern)
    written = []
    for n in range(layouts):
        folder = f"{target.rstrip('/')}/layout={n}"
        if _readable_csv(spark, folder):
            found = spark.read.option("sep", "\t").option("header", True).csv(folder).select("file").distinct().orderBy("file")
            written += [f"{folder}/file={r['file']}" for r in found.collect()]
    return written


def _readable_csv(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException
    try:
        return "file" in spark.read.option("header", True).csv(path).columns
    except AnalysisException:
        return False

"""A parallel scan of JSON arrays: files of one huge line are read by many tasks.

The text source splits files at any short separator.  With ``}`` as the separator, the pieces are fragments that end
where a record may end, and every file block is read by a task of its own.  Whether a brace is one depends on all that
precedes it (a string may be open), so each fragment is a transition: for a start outside and inside a
string, how far it goes down into brackets, and whether it leaves a string open.  Transitions compose,
hence a block needs one small row: its quotes, and its change of depth for both starts.  Those rows are summed up
over the blocks of a file, which gives every block its state at the start, and running sums inside the block give it
to each fragment.  A fragment that comes back to the depth of the array ends a record.

Records that lie in one block are put together there; only the first and last pieces of blocks are shuffled by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

SEPARATOR = "}"


def fragments(spark: SparkSession, path) -> DataFrame:
    """``file``, ``block`` (its first byte), ``place`` (in the block) and ``value``: the text up to the next separator."""
    return spark.read.option("lineSep", SEPARATOR).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")


def _count(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, letters, ""))


def _depth(parts: Column, start: int) -> Column:
    """Change of depth by the parts (between quotes) that are outside of strings, the separator included."""
    outside = F.array_join(F.filter(parts, lambda p, i: i % 2 == start), "")
    closes = F.when((F.size(parts) - 1) % 2 == start, 1).otherwise(0)
    return _count(outside, "{[") - _count(outside, "}]") - closes


def transitions(rows: DataFrame) -> DataFrame:
    """Fragments with the number of their quotes and the change of depth from outside (``down0``) and inside (``down1``) a string.

    A backslash hides the character after it.  The last one of a fragment hides the separator, which stands in a string then.
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    parts = F.split(plain, '"')
    return rows.withColumn("parts", parts).select(
        "file", "block", "place", "value", (F.size("parts") - 1).alias("quotes"),
        _depth(F.col("parts"), 0).alias("down0"), _depth(F.col("parts"), 1).alias("down1"))


def json_records(spark: SparkSession, path, depth: int = 1) -> DataFrame:
    """``file`` and ``json`` of all objects that lie ``depth`` deep in JSON files.

    Depth 1 are the elements of an array, depth 0 objects that follow each other (one per line, or in any layout).  The
    text of a record is that of the file.  What follows the last record, and a record that is cut off, are no records.
    """
    inside = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = transitions(fragments(spark, path)).withColumn("seen", F.sum("quotes").over(inside))
    even = (F.col("seen") - F.col("quotes")) % 2 == 0
    # The change of depth if the block starts outside or inside a string.
    rows = rows.withColumns({
        "go0": F.when(even, F.col("down0")).otherwise(F.col("down1")), "go1": F.when(even, F.col("down1")).otherwise(F.col("down0"))})
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(*[F.sum(c).alias(f"all_{c}") for c in ("quotes", "go0", "go1")])
    blocks = blocks.withColumn("state", F.coalesce(F.sum("all_quotes").over(before), F.lit(0)) % 2).withColumn(
        "go", F.when(F.col("state") == 0, F.col("all_go0")).otherwise(F.col("all_go1"))).withColumn(
        "level", F.coalesce(F.sum("go").over(before), F.lit(0))).select("file", "block", "state", "level")
    rows = rows.join(blocks, ["file", "block"])
    level = F.col("level") + F.sum(F.when(F.col("state") == 0, F.col("go0")).otherwise(F.col("go1"))).over(inside)
    rows = rows.withColumn("ends", (((F.col("state") + F.col("seen")) % 2 == 0) & (level == depth)).cast("int"))
    rows = rows.withColumn("record", F.sum("ends").over(inside) - F.col("ends"))
    pieces = rows.groupBy("file", "block", "record").agg(
        _glued("place", "value").alias("text"), F.max("ends").alias("ends"))
    # Behind the first end in its block a piece has the whole start of its record.
    whole = (F.col("record") > 0) & (F.col("ends") == 1)
    upto = Window.partitionBy("file").orderBy("block", "record").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = pieces.where(~whole).withColumn("number", F.sum("ends").over(upto) - F.col("ends")).groupBy("file", "number").agg(
        _glued("block", "text").alias("text"), F.max("ends").alias("ends")).where("ends = 1")
    found = pieces.where(whole).select("file", "text").unionByName(cut.select("file", "text"))
    # Before a record stand the separators of the array.
    return found.select("file", F.concat(F.regexp_replace("text", r"^[^{]*", ""), F.lit(SEPARATOR)).alias("json"))


def _glued(order: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), SEPARATOR)


def read_json_array(spark: SparkSession, path, schema: DataType | str) -> DataFrame:
    """Rows of JSON files that hold one array of objects each, whatever its layout, read by as many tasks as files have blocks."""
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return json_records(spark, path).select(F.from_json("json", kind).alias("r")).select("r.*")

"""Readers for corpora, exports, split files, prompts and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.text import string_list
from turnwise.plans.ordered import row_numbers
from turnwise.session import cut_lineage
from turnwise.sources.json_scan import read_json_array

INTERVIEW = ("id string, program string, date string, url string, title string, summary string, "
             "utt array<string>, speaker array<string>")


def read_interviews(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Interviews from files that hold a JSON array (any layout) or JSON lines; both are split between tasks."""
    return spark.read.schema(INTERVIEW).json(path) if lines else read_json_array(spark, path, INTERVIEW)


def ingest_interviews(
    spark: SparkSession, path: str, target: str, partitions: int | None = None, lines: bool = False,
) -> DataFrame:
    """One-time conversion to Parquet, so that later reads prune columns and need no scan for the records."""
    rows = read_interviews(spark, path, lines)
    rows = rows.repartition(partitions, "id") if partitions else rows.repartition("id")
    rows.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _tsv(spark: SparkSession):
    return spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("escape", '"')


def read_cut_corpus(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A corpus saved as TSV with list literals in ``speaker`` and ``utt``.

    A literal that cannot be parsed ends the job; with ``strict`` off it is NULL, and
    ``unparsed_lists`` has the rows.
    """
    rows = _tsv(spark).csv(path)

    def parsed(name: str):
        found = string_list(name)
        if not strict:
            return found
        return F.when(F.col(name).isNotNull() & found.isNull(), F.raise_error(
            F.concat(F.lit(f"not a list in {name}: "), F.substring(name, 1, 200))).cast("array<string>")).otherwise(found)

    return rows.withColumns({name: parsed(name) for name in ("speaker", "utt")})


def unparsed_lists(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a saved corpus with a list literal that cannot be parsed, as they are in the file."""
    bad = [F.col(c).isNotNull() & string_list(c).isNull() for c in ("speaker", "utt")]
    return _tsv(spark).csv(path).where(bad[0] | bad[1])


def cut_corpus(interviews: DataFrame, qids: DataFrame, target: str, recreate: bool = False) -> DataFrame:
    """Interviews that occur in the annotated pairs, written once and read back."""
    from turnwise.functions.text import conversation_of
    spark = interviews.sparkSession
    wanted = qids.select(conversation_of("qid").alias("id")).distinct()
    return read_through(spark, target, lambda: interviews.join(wanted, "id", "left_semi"), recreate)


def read_through(spark: SparkSession, target: str, build, recreate: bool = False) -> DataFrame:
    """Table at ``target`` if it is there, else built and written."""
    if recreate or not _readable(spark, target):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _readable(spark: SparkSession, target: str) -> bool:
    from pyspark.errors import AnalysisException
    try:
        spark.read.parquet(target)
        return True
    except AnalysisException:
        return False


def _tsv_heads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file``, ``list_no`` (which of ``paths``), ``wide`` (UTF-16) and ``header`` of each file that is not empty.

    Files are read as lines of bytes (each byte one Latin-1 letter), and of all lines only the first one of the block at
    byte 0 leaves a task: a byte order mark there tells UTF-16, of other files it is the header.
    """
    kinds = "file string, list_no int, wide boolean, header string"
    found = spark.createDataFrame([], kinds)
    for n, path in enumerate(paths):
        lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").schema("line string").csv(path)
        first = lines.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("place"), "line").where("block = 0").groupBy("file").agg(
                F.min_by("line", "place").alias("line"))
        header = F.regexp_replace(F.make_valid_utf8(F.encode("line", "ISO-8859-1").cast("string")), "^\ufeff", "")
        found = found.unionByName(first.select(
            "file", F.lit(n).alias("list_no"), F.substring("line", 1, 2).isin("\u00ff\u00fe", "\u00fe\u00ff").alias("wide"), header.alias("header")))
    return found


def _cells(spark: SparkSession, paths: list[str], wide: bool, width: int) -> DataFrame:
    """``file``, ``place`` and ``cells`` of all records, header lines included."""
    kinds = ", ".join(f"c{i} string" for i in range(width))
    rows = _tsv(spark).option("header", False).option("encoding", "UTF-16" if wide else "UTF-8").schema(kinds).csv(paths)
    cells = [F.regexp_replace("c0", "^\ufeff", "") if i == 0 else F.col(f"c{i}") for i in range(width)]
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.array(*cells).alias("cells"))


def column_names(header: list[str | None]) -> list[str]:
    """Names of the columns under a header: ``_c<place>`` where it has none, with the place added where one comes twice."""
    lower = [None if name is None else name.lower() for name in header]
    return [
        f"_c{i}" if not name else f"{name}{i}" if lower.count(lower[i]) > 1 else name for i, name in enumerate(header)]


def tsv_cells(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[tuple[int, list[str]]]]:
    """Records of TSV files of mixed encoding and differing columns, and the layouts: number and column names.

    ``file``, ``file_no`` (place in the list, files of one path by name), ``layout`` and ``cells``.  Files with the same
    encoding and header line have one layout, and of all files one row for each layout reaches the driver.  The header
    lines are no records, also where a file repeats its own.  Files without a line have none.
    """
    heads = cut_lineage(_tsv_heads(spark, paths))
    if any("\"" in r.header and r.header.count("\"") % 2 for r in heads.where("NOT wide").select("header").distinct().toLocalIterator()):
        raise ValueError("a header line ends inside a quoted name")
    narrow = heads.where("NOT wide").select("file", "header")
    splitter = {"sep": "\t", "escape": '"'}
    width = heads.agg(F.max(F.when(~F.col("wide"), F.size(F.split("header", "\t"))))).first()[0] or 0
    headers = spark.createDataFrame([], "file string, names array<string>")
    if width:
        kinds = ", ".join(f"c{i} string" for i in range(width))
        parsed = narrow.select("file", "header", F.from_csv("header", kinds, splitter).alias("h")).select(
            "file", F.slice(F.array("h.*"), F.lit(1), F.size(F.split("header", "\t"))).alias("names"))
        headers = headers.unionByName(parsed)
    wide = heads.where("wide").select("file")
    some_wide = not wide.isEmpty()
    if some_wide:
        # How many columns they have is not known before they are decoded: a header has at most as many as its letters.
        lines = spark.read.option("encoding", "UTF-16").option("sep", "\u0001").option("quote", "").option("multiLine", True).schema(
            "line string").csv(paths).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), "line")
        first = cut_lineage(lines.join(wide, "file", "left_semi").groupBy("file").agg(F.min_by("line", "place").alias("line")))
        most = first.agg(F.max(F.size(F.split("line", "\t")))).first()[0]
        kinds = ", ".join(f"c{i} string" for i in range(most))
        parsed = first.withColumn("line", F.regexp_replace("line", "^\ufeff", "")).select(
            "file", "line", F.from_csv("line", kinds, splitter).alias("h")).select(
                "file", F.slice(F.array("h.*"), F.lit(1), F.size(F.split("line", "\t"))).alias("names"))
        headers, width = headers.unionByName(parsed), max(width, most)
    listed = headers.join(heads.select("file", "list_no", "wide"), "file")
    numbered = row_numbers(listed, [], ["list_no", "file"], "file_no", probe=listed.select("list_no", "file")).select(
        "file", "wide", "names", (F.col("file_no") - 1).cast("int").alias("file_no"))
    layouts = numbered.groupBy("wide", "names").agg(F.min("file_no").alias("first"))
    # One row for each layout.
    kinds = sorted(layouts.collect(), key=lambda r: r["first"])
    placed = cut_lineage(numbered.join(layouts.withColumnRenamed("first", "layout"), ["wide", "names"]).select(
        "file", "file_no", "layout", "names"))
    frames = [_cells(spark, paths, False, width)] if any(not r["wide"] for r in kinds) else []
    frames = [(f, False) for f in frames] + ([(_cells(spark, paths, True, width), True)] if some_wide else [])
    parts = []
    for cells, is_wide in frames:
        own = [r["first"] for r in kinds if r["wide"] == is_wide]
        parts.append(cells.join(placed.where(F.col("layout").isin(own)), "file"))
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows.where(~F.slice("cells", F.lit(1), F.size("names")).eqNullSafe(F.col("names")))
    return rows.select("file", "file_no", "layout", "cells"), [(r["first"], column_names(r["names"])) for r in kinds]


def read_tsv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """TSV files of mixed encoding and differing columns as one table; ``file_no`` is the place of the file in the list.

    Columns are united by name; the plan grows with the number of layouts, not of files.
    """
    rows, layouts = tsv_cells(spark, paths)
    names = list(dict.fromkeys(name for _, own in layouts for name in own))

    def value(name: str):
        found = F.lit(None).cast("string")
        for layout, own in layouts:
            if name in own:
                found = F.when(F.col("layout") == layout, F.get("cells", F.lit(own.index(name)))).otherwise(found)
        return found.alias(name)
    return rows.select(*[value(name) for name in names], "file_no")


def tsv_layouts(spark: SparkSession, path: str) -> list[tuple[list[str], DataFrame]]:
    """Column names and rows (with ``file``, the file's name) of the files of each encoding and header line in a folder."""
    rows, layouts = tsv_cells(spark, [path])
    name = F.url_decode(F.regexp_extract("file", "[^/]*$", 0))
    return [(own, rows.where(F.col("layout") == layout).select(
        *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(own)], name.alias("file"))) for layout, own in layouts]


def read_exports(spark: SparkSession, paths: list[str], options=None) -> DataFrame:
    """Many survey exports as one long table."""
    from turnwise.operators.annotations import ExportOptions, transform_export
    return transform_export(read_tsv(spark, paths).drop("file_no"), options or ExportOptions())


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """``split, id`` from a JSON object of id lists."""
    rows = spark.read.option("multiLine", True).schema(
        "train array<string>, val array<string>, test array<string>").json(path)
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("ids")) for s in ("train", "val", "test")])
    return rows.select(F.explode(parts).alias("p")).select("p.split", F.explode("p.ids").alias("id"))


def read_json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """``key, value`` of JSON maps: one per line, or one per file with an entry per line or in any layout.

    Files with a map or an entry per line are split between tasks.  Only if some line is neither, files
    are read whole, each as one value.
    """
    kind = f"map<string,{value}>"
    line = F.trim(F.regexp_replace("value", r"^\ufeff", ""))
    entry = F.when(line.startswith("{") & line.endswith("}"), line).otherwise(
        F.concat(F.lit("{"), F.regexp_replace(line, r",$", ""), F.lit("}")))
    lines = spark.read.text(path).select(line.alias("line"), F.from_json(entry, kind).alias("map")).where(
        ~F.col("line").isin("", "{", "}"))
    if not lines.where("map IS NULL").isEmpty():
        lines = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("map"))
    return lines.select(F.explode("map").alias("key", "value"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``qid, prompt`` from JSON maps."""
    return read_json_map(spark, path).toDF("qid", "prompt")


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """``qid, rep, reply`` from JSON maps of answer lists; a nested list gives its first element."""
    rows = read_json_map(spark, path, "array<string>").toDF("qid", "answers")
    first = F.get(F.from_json("reply", "array<string>"), F.lit(0))
    return rows.select("qid", F.posexplode("answers").alias("rep", "reply")).withColumn(
        "reply", F.when(F.startswith("reply", F.lit("[")), F.coalesce(first, F.col("reply"))).otherwise(F.col("reply")))


def read_ids(spark: SparkSession, path: str, columns: tuple[str, ...] = ("PC IDs", "QID")) -> DataFrame:
    """Distinct sorted ids of a file, from whichever id column it has."""
    rows = read_tsv(spark, [path])
    have = [F.col(f"`{c}`") for c in columns if c in rows.columns]
    if not have:
        raise ValueError(f"no id column among {rows.columns}")
    return rows.select(F.coalesce(*have).alias("qid")).where("qid IS NOT NULL").distinct().orderBy("qid")


def read_pair_ids(spark: SparkSession, path: str) -> DataFrame:
    """Stored pair positions: ``qid, conv, guest_pos, guest_idx, host_idx, reply_idx``."""
    from turnwise.functions.text import int_list, pair_id
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select(
        pair_id(F.col("`Interview ID`"), F.col("`First IE Utterance ID`")).alias("qid"),
        F.col("`Interview ID`").alias("conv"), F.col("`First IE Utterance ID`").cast("int").alias("guest_pos"),
        int_list("`Consecutive List of IE IDs`").alias("guest_idx"),
        int_list("`Consecutive List of IR IDs`").alias("host_idx"),
        int_list("`Consecutive List of IE reply IDs to IR`").alias("reply_idx"))

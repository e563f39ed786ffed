"""Queries that go through files or streams: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.base import NEED_SQL, ORDER, query, table, votes, with_ctes
from turnwise.catalog.dialogue import _reply_rows
from turnwise.functions.text import string_list
from turnwise.operators.dialogue import explode_interviews
from turnwise.operators import sampling as s
from turnwise.operators import votes as v
from turnwise.session import new_folder
from turnwise.sources import readers, writers
from turnwise.streaming import votes as sv


@query("tsv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def tsv_round_trip(spark, sf_dir):
    folder = new_folder(spark, "tsv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    writers.write_tsv(rows.where("c_acctbal > 0"), f"{folder}/wide", "UTF-16")
    writers.write_tsv(rows.where("c_acctbal <= 0"), f"{folder}/plain")
    return readers.read_tsv(spark, [f"{folder}/wide/*.csv", f"{folder}/plain/*.csv"]).select(*rows.columns)


TURNS_SQL = """SELECT conv_id, turn, md5(role || '/' || text || '/' || array_to_string(str_split(text, '. '), '|')) AS text_md5
FROM conversations"""


def _turns(spark, sf_dir):
    """Turns with their text and its parts, made awkward: quotes, apostrophes, brackets, line breaks and blanks at the ends."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "role", "text", F.split("text", r"\. ").alias("parts"))


@query("tsv_texts", TURNS_SQL)
def tsv_texts(spark, sf_dir):
    folder = new_folder(spark, "turns")
    odd = F.lit(" don't say \"x\", ['y']\n\t\\\\ ")
    rows = _turns(spark, sf_dir).withColumn("text", F.concat(odd, "text", odd)).withColumn(
        "parts", F.transform("parts", lambda p: F.concat(odd, p, odd)))
    writers.write_tsv(rows, folder)
    back = readers.read_tsv(spark, [f"{folder}/*.csv"]).withColumn("parts", string_list("parts"))
    plain = lambda c: F.substring(c, F.length(odd) + 1, F.length(c) - 2 * F.length(odd))
    whole = F.startswith("text", odd) & F.endswith("text", odd) & F.forall("parts", lambda p: F.startswith(p, odd) & F.endswith(p, odd))
    return back.where(whole).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat_ws("/", "role", plain(F.col("text")), F.array_join(F.transform("parts", plain), "|"))).alias("text_md5"))


@query("json_map_texts", "SELECT conv_id || '-' || turn AS qid, md5(text) AS text_md5 FROM conversations")
def json_map_texts(spark, sf_dir):
    folder = new_folder(spark, "prompts")
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.col("text").alias("prompt"))
    writers.write_json_map(rows, folder)
    return readers.read_prompts(spark, folder).select("qid", F.md5("prompt").alias("text_md5"))


@query("reply_map_texts", "SELECT conv_id || '-' || turn AS qid, t.rep, md5(CASE t.rep WHEN 0 THEN text ELSE role END) AS reply_md5 FROM conversations, (VALUES (0), (1)) t(rep)")
def reply_map_texts(spark, sf_dir):
    folder = new_folder(spark, "replies")
    rows = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("qid"), F.array("text", "role").alias("answers"))
    writers.write_json_map(rows, folder, value="answers", one_object=True)
    return readers.read_replies(spark, folder).select("qid", "rep", F.md5("reply").alias("reply_md5"))


UTTERANCES_SQL = """SELECT CAST(conv_id AS VARCHAR) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
  role AS speaker, md5(text) AS text_md5 FROM conversations"""


def _interview_rows(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("id")).agg(turns.alias("t"))
    return rows.select("id", F.col("t.role").alias("speaker"), F.col("t.text").alias("utt"))


def _utterances(interviews):
    return explode_interviews(interviews).select("conv", F.col("pos").cast("long").alias("pos"), "speaker", F.md5("text").alias("text_md5"))


@query("ingested_utterances", UTTERANCES_SQL)
def ingested_utterances(spark, sf_dir):
    folder = new_folder(spark, "interviews")
    _interview_rows(spark, sf_dir).write.json(f"{folder}/json")
    return _utterances(readers.ingest_interviews(spark, f"{folder}/json", f"{folder}/parquet", lines=True))


@query("scanned_utterances", UTTERANCES_SQL)
def scanned_utterances(spark, sf_dir):
    """From arrays on one line; a title full of quotes, escapes and brackets stands before each list of turns."""
    folder = new_folder(spark, "arrays")
    odd = F.lit('}{"[\\"}],{\\')
    rows = _interview_rows(spark, sf_dir).select("id", F.concat(odd, "id", odd).alias("title"), "speaker", "utt")
    writers.write_json_arrays(rows, folder)
    back = readers.read_interviews(spark, folder)
    return _utterances(back.where(F.col("title") == F.concat(odd, "id", odd)))


@query("split_from_file", """WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 10 < 7 THEN 'train' WHEN c_custkey % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM customer)
SELECT split, CAST(c_custkey AS VARCHAR) AS id FROM p""")
def split_from_file(spark, sf_dir):
    folder = new_folder(spark, "split")
    key = F.col("c_custkey") % 10
    lists = [F.collect_list(F.when(test, F.col("c_custkey").cast("string"))).alias(name) for name, test in (
        ("train", key < 7), ("val", key == 7), ("test", key > 7))]
    table(spark, sf_dir, "customer").agg(*lists).write.json(folder)
    return readers.read_split(spark, folder)


@query("ids_from_files", "SELECT DISTINCT 'Q-' || l_partkey AS qid FROM lineitem WHERE l_tax > 0.04")
def ids_from_files(spark, sf_dir):
    folder = new_folder(spark, "ids")
    line = table(spark, sf_dir, "lineitem").where("l_tax > 0.04").select(F.concat(F.lit("Q-"), "l_partkey").alias("QID"), "l_suppkey")
    writers.write_tsv(line, folder)
    return readers.read_ids(spark, f"{folder}/*.csv")


ROWS_PER_FILE = 500_000


@query("anonymised_files", """SELECT l_returnflag AS flag, coalesce('A' || s.s_suppkey, CAST(l_suppkey AS VARCHAR)) AS annotator, count(*) AS n
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def anonymised_files(spark, sf_dir):
    folder = new_folder(spark, "files")
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_suppkey").cast("string").alias("Annotator"))
    # One file per part, each with its header line, as exports come; as many as the rows ask for.
    places = max(3, -(-line.count() // ROWS_PER_FILE))
    body = line.select(F.monotonically_increasing_id().alias("n"), "*").select(
        F.pmod("n", F.lit(places)).alias("place"), F.concat_ws("\t", "Annotator", "l_returnflag").alias("value"))
    heads = spark.range(places).select(F.col("id").alias("place"), F.lit("Annotator\tflag").alias("value"))
    heads.withColumn("o", F.lit(0)).unionByName(body.withColumn("o", F.lit(1))).repartition(places, "place").sortWithinPartitions(
        "place", "o").select("place", "value").write.partitionBy("place").text(f"{folder}/in")
    names = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").cast("string").alias("orig"), F.concat(F.lit("A"), "s_suppkey").alias("anon"))
    writers.write_anonymised(spark, f"{folder}/in/*", names, f"{folder}/out", pattern="part-*")
    rows = spark.read.option("sep", "\t").option("header", True).csv(f"{folder}/out/layout=*/file=*")
    return rows.groupBy("flag", F.col("Annotator").alias("annotator")).agg(F.count(F.lit(1)).alias("n"))


@query("snapshots", """SELECT 'first' AS step, 1 AS snapshot, count(*) AS n FROM orders UNION ALL
SELECT 'same', 1, count(*) FROM orders UNION ALL SELECT 'changed', 2, count(*) FROM orders WHERE o_orderstatus <> 'P'""")
def snapshots(spark, sf_dir):
    folder = new_folder(spark, "snapshots")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    steps = []
    for step, rows in (("first", orders), ("same", orders), ("changed", orders.where("o_orderstatus <> 'P'"))):
        number = writers.save_snapshot(rows, folder)
        newest, _ = writers.latest_snapshot(spark, folder)
        steps.append(newest.agg(F.lit(step).alias("step"), F.lit(number).alias("snapshot"), F.count(F.lit(1)).alias("n")))
    return steps[0].union(steps[1]).union(steps[2])


@query("read_through", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def read_through(spark, sf_dir):
    folder = new_folder(spark, "cache")
    build = lambda: table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    readers.read_through(spark, folder, build)
    return readers.read_through(spark, folder, build).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("split_tables", """WITH raw_votes AS (SELECT DISTINCT l_partkey AS item, l_suppkey FROM lineitem),
t AS (SELECT item, count(*) AS n FROM raw_votes GROUP BY item),
p AS (SELECT item, (sum(n) OVER (ORDER BY md5('9|' || item), item) - n) / (SELECT sum(n) FROM t) AS p FROM t)
SELECT item FROM p WHERE p >= 0.70 AND p < 0.85""")
def split_tables(spark, sf_dir):
    folder = new_folder(spark, "splits")
    kept = votes(spark, sf_dir)
    weights = v.vote_tuples(kept).select("item", F.col("n").alias("weight"))
    writers.write_split_tables(kept, s.weighted_split(weights, 9, "item"), folder, "item")
    return writers.read_split_ids(spark, folder, "dev", "item")


@query("pending_requests", """SELECT conv_id || '-' || turn AS qid, rep FROM conversations, range(0, 2) t(rep)
WHERE NOT (rep = 0 AND role = 'user')""")
def pending_requests(spark, sf_dir):
    folder = new_folder(spark, "answers")
    rows = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("qid"), "role", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("rep"))
    writers.append_answers(rows.where("rep = 0 AND role = 'user'").select("qid", "rep", F.col("role").alias("reply")), folder)
    return writers.pending_requests(rows.select("qid", "rep"), folder)


@query("cut_corpus", """SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS n_utt FROM conversations
WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND turn > 2) GROUP BY conv_id""")
def cut_corpus(spark, sf_dir):
    folder = new_folder(spark, "corpus")
    rows = _reply_rows(spark, sf_dir).select(F.col("conv").alias("id"), "utt_id", "speaker")
    qids = table(spark, sf_dir, "conversations").where("role = 'assistant' AND turn > 2").select(
        F.concat_ws("-", "conv_id", "turn").alias("qid"))
    return readers.cut_corpus(rows, qids, folder).groupBy("id").agg(F.count(F.lit(1)).alias("n_utt"))


# -- streams ------------------------------------------------------------------------------------

def _drain(spark, sf_dir, build, label: str, keys: list[str] | None = None, each: int = sv.ROWS_PER_STATE):
    """Line items as votes arrive in three parts by time; after each the stream goes on from its checkpoint.

    All tasks write a part and the stream takes all that is new, so its batches follow each other in time.  The result
    is written to the shared folder and read.  With ``keys`` the stream is in update mode, and the newest row of each
    key counts.  A partition of state is for ``each`` of the rows.
    """
    folder = new_folder(spark, label)
    line = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", F.col("l_shipdate").cast("timestamp").alias("ts"))
    rows, cuts = line.agg(F.count(F.lit(1)), F.percentile_approx(F.unix_micros("ts"), [1 / 3, 2 / 3])).first()
    cuts = cuts or [0, 0]
    part = F.when(F.unix_micros("ts") <= cuts[0], 0).when(F.unix_micros("ts") <= cuts[1], 1).otherwise(2)
    for n in range(3):
        line.where(part == n).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(line.schema).parquet(f"{folder}/in").select(
            F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("annotator"), F.col("l_orderkey").alias("session"),
            F.col("l_linenumber").alias("line"), "ts", (F.col("l_quantity") > 25).cast("int").alias("vote"))
        stream = build(arriving)
        if keys is None:
            writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
        else:
            # Batches are numbered through, also after a restart.
            writer = stream.writeStream.foreachBatch(
                lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{folder}/out")).outputMode("update")
        with sv.state_partitions(spark, rows, each):
            writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    if keys is None:
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    out = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


@query("stream_tallies", with_ctes(NEED_SQL) + """, t AS (
  SELECT l_partkey AS item, CAST(sum(CAST(l_quantity > 25 AS INTEGER)) AS BIGINT) AS yes, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT item, yes, n, CAST(greatest(0, need) AS BIGINT) AS need FROM t JOIN need USING (yes, n)""")
def stream_tallies(spark, sf_dir):
    out = _drain(spark, sf_dir, sv.running_tallies, "tallies", ["item"])
    return out.select("item", "yes", "n", F.col("need").cast("long").alias("need"))


STOP_STREAM = """WITH raw_votes AS (
  SELECT l_partkey AS item, l_shipdate AS ts, l_suppkey || '-' || l_orderkey || '-' || l_linenumber AS a, CAST(l_quantity > 25 AS INTEGER) AS vote FROM lineitem),
run AS (SELECT item, row_number() OVER w AS n, CAST(sum(vote) OVER w AS BIGINT) AS yes FROM raw_votes
        WINDOW w AS (PARTITION BY item ORDER BY ts, a ROWS UNBOUNDED PRECEDING)),
ok AS (SELECT *, CASE WHEN yes = 0 OR yes = n THEN 0.0 ELSE -(yes / n) * log2(yes / n) - (1 - yes / n) * log2(1 - yes / n) END AS h FROM run)
SELECT item, min(n) AS n, arg_min(yes, n) AS yes FROM ok WHERE n >= 15 OR (n >= 3 AND h < 0.8) GROUP BY item"""


@query("stream_stops", STOP_STREAM)
def stream_stops(spark, sf_dir):
    bundles = sv.bundles_for(spark, table(spark, sf_dir, "lineitem").count())

    def stops(votes):
        return sv.stopping_rounds(votes.withColumn("annotator", F.concat_ws("-", "annotator", "session", "line")),
                                  forget_after="9000 days", bundles=bundles)
    return _drain(spark, sf_dir, stops, "stops", each=sv.ROWS_PER_BUNDLES).select("item", "n", "yes")


@query("stream_first_submissions", "SELECT DISTINCT l_partkey AS item, l_suppkey AS annotator FROM lineitem")
def stream_first_submissions(spark, sf_dir):
    return _drain(spark, sf_dir, lambda votes: sv.first_submissions(votes, "9000 days"), "first").select("item", "annotator")


@query("stream_last_submissions", """SELECT item, annotator, session, line, vote FROM (
  SELECT l_partkey AS item, l_suppkey AS annotator, l_orderkey AS session, l_linenumber AS line, CAST(l_quantity > 25 AS INTEGER) AS vote,
    row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS place FROM lineitem)
WHERE place = 1""")
def stream_last_submissions(spark, sf_dir):
    out = _drain(spark, sf_dir, sv.last_submissions, "last", ["item", "annotator"])
    return out.select("item", "annotator", "session", "line", "vote")


@query("stream_anonymised", """SELECT CASE WHEN s_acctbal > 0 THEN 'A' || s_suppkey END AS anon, count(*) AS n
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def stream_anonymised(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("orig"), F.concat(F.lit("A"), "s_suppkey").alias("anon"))
    out = _drain(spark, sf_dir, lambda votes: sv.anonymised(votes, names), "anonymised")
    return out.groupBy("anon").agg(F.count(F.lit(1)).alias("n"))

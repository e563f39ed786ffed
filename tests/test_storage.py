import heapq
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnwise.operators import annotations as an
from turnwise.sources import readers, writers
from turnwise.streaming import votes as sv

WIDE = [
    {"Q-PID": "Start", "ResponseId": "Response ID", "StartDate": "Start Date", "EndDate": "End Date", "Progress": "Progress",
     "Q_RESPONSE_TYPE": "t", "Duration (in seconds)": "d", "Q-Comment": "c", "Quality_Fails": "f"},
    {"Q-PID": "{}", "ResponseId": "{}", "StartDate": "{\"ImportId\":\"startDate\"}", "EndDate": "{}", "Progress": "{}",
     "Q_RESPONSE_TYPE": "{}", "Duration (in seconds)": "{}", "Q-Comment": "{}", "Quality_Fails": "{}"},
    {"Q-PID": "ann1", "ResponseId": "R_1", "StartDate": "2023-06-13 06:20:11", "EndDate": "2023-06-13 06:27:11",
     "Progress": "100", "Q_RESPONSE_TYPE": "Completed", "Duration (in seconds)": "420", "Q-Comment": "two\nlines",
     "Quality_Fails": "0", "Q-CNN-1-3-R2_x_2": "On", "Q-CNN-1-3-P_x_1": "On", "Q-CNN-1-3-C": "4", "Q-CNN-1-3-CL": "hm"},
    {"Q-PID": "ann2", "ResponseId": "R_2", "StartDate": "2023-06-14 06:20:11", "EndDate": "2023-06-14 06:27:11",
     "Progress": "100", "Q_RESPONSE_TYPE": "Completed", "Duration (in seconds)": "42", "Q-Comment": None,
     "Quality_Fails": "1", "Q-CNN-1-3-R2_x_1": "On", "Q-CNN-1-3-R2_x_2": "On", "Q-CNN-1-3-P_x_1": "On", "Q-CNN-1-3-C": "2"},
    {"Q-PID": "ann3", "ResponseId": "R_3", "StartDate": "2023-06-15 06:20:11", "EndDate": "2023-06-15 06:27:11",
     "Progress": "30", "Q_RESPONSE_TYPE": "In Process", "Duration (in seconds)": "9", "Q-Comment": None, "Quality_Fails": "2"},
    {"Q-PID": "test", "ResponseId": "R_4", "StartDate": "2023-06-15 06:20:11", "EndDate": "2023-06-15 06:27:11",
     "Progress": "100", "Q_RESPONSE_TYPE": "Completed", "Duration (in seconds)": "9", "Q-Comment": None, "Quality_Fails": "2"},
]
COLUMNS = ["Q-PID", "ResponseId", "StartDate", "EndDate", "Progress", "Q_RESPONSE_TYPE", "Duration (in seconds)", "Q-Comment",
           "Quality_Fails", "Q-CNN-1-3-R2_x_1", "Q-CNN-1-3-R2_x_2", "Q-CNN-1-3-P_x_1", "Q-CNN-1-3-Timer", "Q-CNN-1-3-C", "Q-CNN-1-3-CL"]


def export_file(path, encoding="utf-16"):
    pd.DataFrame(WIDE, columns=COLUMNS).to_csv(path, sep="\t", index=False, encoding=encoding)
    return str(path)


def long_rows(df):
    return {(r["qid"], r["category"], r["session"]): r["highlighted"] for r in df.collect()}


def test_export_reshape_from_utf16(spark, tmp_path):
    path = export_file(tmp_path / "e.tsv")
    got = long_rows(readers.read_exports(spark, [path]))
    assert got["CNN-1-3", "Referred", "R_1"] == "[2]" and got["CNN-1-3", "Referred", "R_2"] == "[1, 2]"
    assert got["CNN-1-3", "Paraphrase", "R_2"] == "[1]" and got["CNN-1-3", "Is Referring", "R_2"] == "History"
    assert got["CNN-1-3", "Comment", "R_1"] == "hm" and got["R_1", "Comment", "R_1"] == "two\nlines"
    assert got["R_2", "Time", "R_2"] == "42" and got["R_1", "EndTime", "R_1"] == "2023-06-13 06:27:11"
    assert not any(s in ("R_3", "R_4") for _, _, s in got)
    assert len(got) == 2 * 4 + 2 * 4


def test_export_without_history_and_with_fails(spark, tmp_path):
    path = export_file(tmp_path / "e.tsv", "utf-8")
    opts = an.ExportOptions(include_history=False, include_fails=True)
    got = long_rows(readers.read_exports(spark, [path], opts))
    assert got["CNN-1-3", "Paraphrase", "R_2"] == "[]" and got["CNN-1-3", "Referred", "R_2"] == "[1, 2]"
    assert got["R_3", "Stopped", "R_3"] == "1" and got["R_3", "# failed ACs", "R_3"] == "2" and got["R_1", "Stopped", "R_1"] == "0"
    admitted = long_rows(readers.read_exports(spark, [path], an.ExportOptions(admitted=("ann3",))))
    assert ("R_3", "Comment", "R_3") in admitted


def test_mixed_files_are_united(spark, tmp_path):
    pd.DataFrame({"QID": ["b", "a"], "x": ["é", "2"]}).to_csv(tmp_path / "1.tsv", sep="\t", index=False, encoding="utf-16")
    pd.DataFrame({"PC IDs": ["a", "c"]}).to_csv(tmp_path / "2.tsv", sep="\t", index=False)
    rows = readers.read_tsv(spark, [str(tmp_path / "1.tsv"), str(tmp_path / "2.tsv")])
    assert {(r["QID"], r["PC IDs"], r["x"], r["file_no"]) for r in rows.collect()} == {
        ("b", None, "é", 0), ("a", None, "2", 0), (None, "a", None, 1), (None, "c", None, 1)}
    assert [r["qid"] for r in readers.read_ids(spark, str(tmp_path / "1.tsv")).collect()] == ["a", "b"]


def test_json_sources(spark, tmp_path):
    (tmp_path / "split.json").write_text(json.dumps({"train": ["a", "b"], "val": ["c"], "test": []}))
    assert {(r["split"], r["id"]) for r in readers.read_split(spark, str(tmp_path / "split.json")).collect()} == {
        ("train", "a"), ("train", "b"), ("val", "c")}
    (tmp_path / "p.json").write_text(json.dumps({"q1": "say\n\"x\"", "q2": "y"}, indent=4))
    assert {(r["qid"], r["prompt"]) for r in readers.read_prompts(spark, str(tmp_path / "p.json")).collect()} == {
        ("q1", "say\n\"x\""), ("q2", "y")}
    (tmp_path / "r.json").write_text(json.dumps({"q1": ["a", ["b", "c"]], "q2": ["[not json"]}))
    assert {(r["qid"], r["rep"], r["reply"]) for r in readers.read_replies(spark, str(tmp_path / "r.json")).collect()} == {
        ("q1", 0, "a"), ("q1", 1, "b"), ("q2", 0, "[not json")}
    corpus = [{"id": "i1", "speaker": ["a", "b"], "utt": ["x", "y"], "date": "2020-01-01"}]
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    rows = readers.ingest_interviews(spark, str(tmp_path / "c.json"), str(tmp_path / "parquet"))
    assert rows.first()["utt"] == ["x", "y"]


def test_cut_corpus_and_pair_ids(spark, tmp_path):
    pd.DataFrame({"id": ["a"], "speaker": ["['x', 'y']"], "utt": ["['1', '2']"]}).to_csv(tmp_path / "c.tsv", sep="\t", index=False)
    assert readers.read_cut_corpus(spark, str(tmp_path / "c.tsv")).first()["speaker"] == ["x", "y"]
    pd.DataFrame({"Interview ID": ["NPR-4"], "First IE Utterance ID": [10], "Consecutive List of IE IDs": ["[10, 11]"],
                  "Consecutive List of IR IDs": ["[12]"], "Consecutive List of IE reply IDs to IR": ["[13]"]}).to_csv(
        tmp_path / "ids.tsv", sep="\t")
    row = readers.read_pair_ids(spark, str(tmp_path / "ids.tsv")).first()
    assert (row["qid"], row["guest_idx"], row["reply_idx"]) == ("NPR-4-10", [10, 11], [13])


def test_corpus_survives_a_round_trip(spark, tmp_path):
    texts = ["don't", 'say "x"', "a\tb\nc", " blanks ", "[1]", "\\"]
    rows = spark.createDataFrame([("i1", "a \"quoted\"\ntitle", texts, ["A", "O'B"] * 3)], "id string, title string, utt array<string>, speaker array<string>")
    writers.write_tsv(rows, str(tmp_path / "c"))
    assert readers.read_cut_corpus(spark, str(tmp_path / "c")).first() == rows.first()
    (tmp_path / "bad.tsv").write_text("id\tspeaker\tutt\nx\t['a', b\t['c']\ny\t['a']\t['c']\n")
    with pytest.raises(Exception, match="not a list in speaker"):
        readers.read_cut_corpus(spark, str(tmp_path / "bad.tsv")).collect()
    assert [r["id"] for r in readers.unparsed_lists(spark, str(tmp_path / "bad.tsv")).collect()] == ["x"]
    assert readers.read_cut_corpus(spark, str(tmp_path / "bad.tsv"), strict=False).where("speaker IS NULL").count() == 1


def test_json_maps_survive_a_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{i}", f"p '{i}' \"x\"\n{{,}}") for i in range(30)], "qid string, prompt string")
    for one in (False, True):
        path = str(tmp_path / f"m{one}")
        writers.write_json_map(rows, path, one_object=one)
        assert sorted(readers.read_prompts(spark, path).collect()) == sorted(rows.collect())
    (text,) = [p.read_text() for p in (tmp_path / "mTrue").glob("part-*")]
    assert json.loads(text) == {r["qid"]: r["prompt"] for r in rows.collect()}
    lists = spark.createDataFrame([("q1", ["a", "b\"c"]), ("q2", [])], "qid string, answers array<string>")
    writers.write_json_map(lists, str(tmp_path / "lists"), value="answers")
    assert {(r["qid"], r["rep"], r["reply"]) for r in readers.read_replies(spark, str(tmp_path / "lists")).collect()} == {("q1", 0, "a"), ("q1", 1, "b\"c")}


def test_long_headers_are_read_whole(spark, tmp_path):
    wide = [f"column_{i:060d}" for i in range(1_200)]
    for n, last in ((1, "x"), (2, "y")):
        pd.DataFrame({**{c: [n] for c in wide}, last: [n]}).to_csv(tmp_path / f"{n}.tsv", sep="\t", index=False)
    rows = readers.read_tsv(spark, [str(tmp_path / "1.tsv"), str(tmp_path / "2.tsv")]).select("x", "y", "file_no")
    assert {tuple(r) for r in rows.collect()} == {("1", None, 0), (None, "2", 1)}


def test_snapshots_only_on_change(spark, tmp_path):
    path = str(tmp_path / "db")
    rows = spark.createDataFrame([(1, ["a"]), (1, ["a"]), (2, None)], "k int, l array<string>")
    assert [writers.save_snapshot(rows, path), writers.save_snapshot(rows, path)] == [1, 1]
    assert writers.save_snapshot(rows.limit(2), path) == 2
    newest, number = writers.latest_snapshot(spark, path)
    assert number == 2 and newest.count() == 2


def test_interrupted_requests_go_on(spark, tmp_path):
    path = str(tmp_path / "answers")
    requests = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "qid string, rep int")
    assert writers.pending_requests(requests, path).count() == 3
    writers.append_answers(requests.where("qid = 'a'").withColumn("reply", F.lit("x")), path)
    assert [r["qid"] for r in writers.pending_requests(requests, path).collect()] == ["b"]


def test_anonymised_folder(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    pd.DataFrame({"QID": ["q"], "Annotator": ["u1"]}).to_csv(src / "long.tsv", sep="\t", index=False, encoding="utf-16")
    pd.DataFrame({"other": ["u1"]}).to_csv(src / "unknown.tsv", sep="\t", index=False)
    pd.DataFrame({"Annotator": ["u1"]}).to_csv(src / "ANON_done.tsv", sep="\t", index=False)
    names = spark.createDataFrame([("u1", "PROLIFIC_1")], "orig string, anon string")
    written = writers.anonymise_folder(spark, str(src), names, str(tmp_path / "out"))
    assert [w.rsplit("/", 1)[-1] for w in written] == ["file=ANON_long.tsv"]
    (src / "more.tsv").write_text("QID\tAnnotator\nq2\tu1\nq3\tu2\n")
    (src / "also.tsv").write_text("QID\tAnnotator\nq4\tu1\n")
    written = writers.anonymise_folder(spark, str(src), names, str(tmp_path / "out2"))
    assert sorted(w.rsplit("/", 1)[-1] for w in written) == ["file=ANON_also.tsv", "file=ANON_long.tsv", "file=ANON_more.tsv"]
    rows = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out2" / "*" / "*"))
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(map(str, [("q", "PROLIFIC_1"), ("q2", "PROLIFIC_1"), ("q3", "u2"), ("q4", "PROLIFIC_1")]))
    assert readers.read_tsv(spark, [written[0] + "/*.csv"]).first()["Annotator"] == "PROLIFIC_1"


def test_split_tables_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "qid string, v int")
    split = spark.createDataFrame([("a", "train"), ("b", "dev")], "qid string, split string")
    writers.write_split_tables(rows, split, str(tmp_path / "s"))
    writers.write_split_tables(rows.limit(0), split, str(tmp_path / "s"))
    assert [r["qid"] for r in writers.read_split_ids(spark, str(tmp_path / "s"), "train").collect()] == ["a"]


def test_corrections_and_fill(spark):
    long = spark.createDataFrame([("q1", "Comment", "old"), ("q1", "Is Referring", "Yes"), ("q2", "Is Referring", "No")],
                                 "qid string, category string, highlighted string")
    fix = spark.createDataFrame([("q1", "Comment", "new", 1), ("q1", "Comment", None, 2), ("q1", "Is Referring", "No", 3)],
                                "qid string, category string, highlighted string, ord int")
    fixed = {(r["qid"], r["category"]): r["highlighted"] for r in an.apply_corrections(long, fix).collect()}
    assert fixed == {("q1", "Comment"): None, ("q1", "Is Referring"): "Yes", ("q2", "Is Referring"): "No"}
    filled = {(r["qid"], r["category"]): r["highlighted"] for r in an.fill_highlights(long).collect()}
    assert filled["q1", "Paraphrase"] == "-" and filled["q2", "Referred"] == "[]" and len(filled) == 7


def test_stream_stops_over_several_batches(spark, tmp_path):
    votes = [("a", f"u{i}", x, f"2024-01-01 00:00:{i:02d}") for i, x in enumerate([1, 0, 1, 1, 1, 1, 0])]
    votes += [("b", f"u{i}", i % 2, f"2024-01-01 00:00:{i:02d}") for i in range(20)]
    votes += [("c", f"u{i}", 1, f"2024-01-01 00:00:{i:02d}") for i in range(2)]
    df = spark.createDataFrame(votes, "item string, annotator string, vote int, ts string").withColumn("ts", F.to_timestamp("ts"))
    src = str(tmp_path / "in")
    for lo, hi in ((0, 2), (2, 5), (5, 99)):
        df.where(f"CAST(substr(annotator, 2) AS INT) >= {lo} AND CAST(substr(annotator, 2) AS INT) < {hi}").coalesce(1) \
            .write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    query = sv.stopping_rounds(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["item"]: (r["yes"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": (4, 5), "b": (7, 15)}


def test_unknown_ids_go_to_the_side(spark):
    batch = spark.createDataFrame([("u1", "A1", 1), ("x", None, 2)], "annotator string, anon string, v int")
    seen = {}
    sv.split_unknown(batch, lambda d: seen.update(known=[tuple(r) for r in d.collect()]),
                     lambda d: seen.update(unknown=[tuple(r) for r in d.collect()]))
    assert seen == {"known": [("A1", 1)], "unknown": [("x",)]}


def test_layouts_of_many_files(spark, tmp_path):
    """Names with letters whose UTF-16 bytes hold a line feed, quoted and empty names, empty files, a repeated header line."""
    (tmp_path / "a.tsv").write_bytes("﻿id\tĊ ਊ\tx\n1\tਊ\t2\n3\t\t4\n".encode("utf-16-le"))
    (tmp_path / "b.tsv").write_bytes("﻿id\tĊ ਊ\tx\n5\ty\t6\n".encode("utf-16-be"))
    (tmp_path / "c.tsv").write_text("﻿id\t\"x\"\t\tid2\n7\t8\t9\t10\nid\tx\t\tid2\n11\t\"two\nlines\"\t\t\n")
    (tmp_path / "d.tsv").write_text("")
    (tmp_path / "e.tsv").write_text("id\tx\n")
    for k in range(40):
        (tmp_path / f"f{k:02}.tsv").write_text(f"x\tid\n{k}\t{100 + k}\n")
    rows, layouts = readers.tsv_cells(spark, [str(tmp_path)])
    assert [names for _, names in layouts] == [["id", "Ċ ਊ", "x"], ["id", "x", "_c2", "id2"], ["id", "x"], ["x", "id"]]
    got = readers.read_tsv(spark, [str(tmp_path)])
    assert got.columns == ["id", "Ċ ਊ", "x", "_c2", "id2", "file_no"]
    want = [("1", "ਊ", "2", None, None, 0), ("3", None, "4", None, None, 0), ("5", "y", "6", None, None, 1),
            ("7", None, "8", "9", "10", 2), ("11", None, "two\nlines", None, None, 2)]
    want += [(str(100 + k), None, str(k), None, None, 4 + k) for k in range(40)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert readers.column_names(["a", None, "A", "b"]) == ["a0", "_c1", "A2", "b"]


def test_a_header_that_is_cut_off(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\t\"two\nlines\"\n1\t2\n")
    with pytest.raises(ValueError, match="header"):
        readers.read_tsv(spark, [str(tmp_path)])


def test_snapshot_digests(spark, tmp_path):
    rows = [(1, "a", None), (1, "a", None), (2, None, [1, 2]), (None, "b", [])]
    kinds = "x int, y string, z array<int>"
    first = spark.createDataFrame(rows, kinds)
    path = str(tmp_path / "s")
    assert writers.save_snapshot(first, path) == 1
    assert writers.save_snapshot(spark.createDataFrame(rows[::-1], kinds).repartition(3).select("z", "x", "y"), path) == 1
    for n, other in enumerate([rows[1:], rows + rows[:1], [(1, None, None), (1, "a", None), *rows[2:]], [(1, "a", None)] * 2 + [(2, "a", [1, 2]), (None, "b", [])]], 2):
        assert writers.save_snapshot(spark.createDataFrame(other, kinds), path) == n
    assert writers.save_snapshot(spark.createDataFrame([(r[0], r[1], r[2]) for r in other], "x long, y string, z array<int>"), str(tmp_path / "t")) == 1
    got, number = writers.latest_snapshot(spark, path)
    assert number == 5 and writers.same_rows(got, spark.createDataFrame(other, kinds))
    # A snapshot without a stored digest is read once to get it.
    old = str(tmp_path / "old")
    first.withColumn("snapshot", F.lit(1)).write.partitionBy("snapshot").parquet(old)
    assert writers.save_snapshot(first, old) == 1


def _run_stream(spark, build, schema, folder, mode="append"):
    stream = build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True)
    if mode == "update":
        writer = writer.outputMode("update").foreachBatch(
            lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("append").parquet(f"{folder}/out"))
    else:
        writer = writer.format("parquet").option("path", f"{folder}/out")
    writer.start().awaitTermination()


def test_streams_go_on_from_their_checkpoint_and_forget(spark, tmp_path):
    """Three starts of one stream; state of items and pairs that are old by event time is dropped by its timer."""
    schema = "item string, annotator string, session int, line int, vote int, ts timestamp"
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    parts = [
        [("a", "u1", 1, 1, 1, day(1)), ("a", "u2", 1, 2, 1, day(1)), ("b", "u1", 1, 1, 0, day(2)), ("b", "u1", 1, 2, 1, day(2))],
        [("a", "u3", 1, 1, 1, day(3)), ("b", "u1", 0, 9, 1, day(2)), ("c", "u9", 1, 1, 1, day(20))],
        [("a", "u4", 1, 1, 0, day(20)), ("a", "u1", 2, 1, 0, day(20)), ("b", "u1", 2, 1, 0, day(21))]]
    for name, build, mode in (
            ("stops", lambda v: sv.stopping_rounds(v, forget_after="5 days"), "append"),
            ("last", lambda v: sv.last_submissions(v, forget_after="5 days"), "update")):
        folder = str(tmp_path / name)
        for part in parts:
            df = spark.createDataFrame([(*r[:-1], r[-1]) for r in part], schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
            df.write.mode("append").parquet(f"{folder}/in")
            _run_stream(spark, build, df.schema, folder, mode)
    stops = [tuple(r) for r in spark.read.parquet(str(tmp_path / "stops" / "out")).collect()]
    assert stops == [("a", 3, 3)]  # three votes of two starts; the ones of the third start begin anew
    last = spark.read.parquet(str(tmp_path / "last" / "out"))
    got = sorted((r.item, r.annotator, r.session, r.line, r.vote) for r in last.collect() if r.item != "c")
    assert got == sorted([
        ("a", "u1", 1, 1, 1), ("a", "u2", 1, 2, 1), ("b", "u1", 1, 2, 1), ("a", "u3", 1, 1, 1),
        ("a", "u1", 2, 1, 0), ("a", "u4", 1, 1, 0), ("b", "u1", 2, 1, 0)])


def test_exports_get_as_many_files_as_rows_ask_for(spark, tmp_path, monkeypatch):
    """However many rows there are, a file (and the task that sorts it) holds a bounded number; the counts stay."""
    from turnwise.catalog import storage
    rows = [(i % 7, "ANR"[i % 3]) for i in range(95)]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, float(i - 3)) for i in range(7)], "s_suppkey long, s_acctbal double").write.parquet(
        f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(storage, "ROWS_PER_FILE", 10)
    monkeypatch.setattr(storage, "new_folder", lambda session, label: f"{tmp_path}/{label}")
    got = {(r["flag"], r["annotator"]): r["n"] for r in storage.anonymised_files(spark, str(tmp_path)).collect()}
    expected = {}
    for key, flag in rows:
        name = (flag, f"A{key}" if key > 3 else str(key))
        expected[name] = expected.get(name, 0) + 1
    assert got == expected
    assert len(list(tmp_path.glob("files/in/place=*"))) == 10


def test_state_grows_by_partitions(spark, tmp_path):
    """The more rows a stream is to see, the more partitions its state has, kept out of the heap; a restart keeps them."""
    df = spark.createDataFrame([(i % 50, i % 7, i, i, i % 2) for i in range(400)], "item int, annotator int, ts int, line int, vote int")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    for begin in range(2):
        df.where(f"ts % 2 = {begin}").write.mode("append").parquet(f"{tmp_path}/in")
        with sv.state_partitions(spark, 400, each=40):
            stream = sv.last_submissions(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ("ts", "line"))
            query = stream.writeStream.foreachBatch(lambda batch, k: batch.write.mode("append").parquet(f"{tmp_path}/out")).outputMode(
                "update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]
        assert state["numShufflePartitions"] == 10
        assert any(name.startswith("rocksdb") for name in state["customMetrics"])
        assert spark.conf.get("spark.sql.shuffle.partitions") == usual
    last = {}
    for r in df.collect():
        last[r["item"], r["annotator"]] = max(r["ts"], last.get((r["item"], r["annotator"]), -1))
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("item", "annotator").agg({"ts": "max"}).collect()
    assert {(r[0], r[1]): r[2] for r in got} == last


def _stops(batches, threshold=0.8, max_votes=15):
    """The plain rule, vote by vote: rows are (item, annotator, vote, micros), without a time they are last."""
    tally, stopped = {}, []
    for batch in batches:
        for item in {r[0] for r in batch}:
            yes, n, closed = tally.get(item, (0, 0, False))
            mine = [(t is None, t or 0, a, v) for i, a, v, t in batch if i == item and v is not None]
            for *_, vote in heapq.nsmallest(max_votes, mine):
                if not closed:
                    yes, n = yes + vote, n + 1
                    closed = sv._settled(yes, n, threshold, max_votes)
                    stopped += [(item, yes, n)] if closed else []
            tally[item] = yes, n, closed
    return sorted(stopped, key=str)


@pytest.mark.parametrize("kind", ["bigint", "string", "date"])
def test_stops_of_many_items_share_rows_of_state(spark, tmp_path, kind):
    """A row of state and a call of Python is for a bundle of items, however many there are; equal times go by name."""
    draw = random.Random(5)
    batches = [[(draw.choice([None, *range(300)]), f"u{draw.randrange(40)}", draw.choice([None, 0, 0, 1, 1, 1]),
                 None if draw.random() < 0.02 else (1_700_000_000 + 86_400 * (3 * k + draw.randrange(3))) * 1_000_000)
                for _ in range(3_000)] for k in range(3)]
    item = {"bigint": F.col("item") + (1 << 60), "string": F.concat(F.lit("i \""), "item"), "date": F.expr("date_add(DATE'0012-03-04', CAST(item AS INT))")}[kind]
    back = {}
    for batch in batches:
        df = spark.createDataFrame(batch, "item long, annotator string, vote int, us long").withColumn("key", item)
        back |= {r["key"]: r["item"] for r in df.select("key", "item").distinct().collect()}
        df.select(F.col("key").alias("item"), "annotator", "vote", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        votes = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        query = sv.stopping_rounds(votes, bundles=8).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 9
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.schema["item"].dataType.simpleString() == kind
    assert sorted(((back[r["item"]], r["yes"], r["n"]) for r in out.collect()), key=str) == _stops(batches)


def test_votes_of_a_bundle_are_held_in_parts(monkeypatch):
    """However many votes an item has, also at one time, no more than its earliest are held; the decision stays."""
    draw = random.Random(6)
    monkeypatch.setattr(sv, "ROWS_AT_ONCE", 50)
    votes = [("x" if draw.random() < 0.9 else f"i{draw.randrange(3)}", f"u{draw.randrange(900)}", draw.randrange(2), draw.choice([7, 7, 8]) * 1_000) for _ in range(5_000)]
    chunks = (pd.DataFrame(votes[k:k + 100], columns=["item", "annotator", "vote", "ts_us"]) for k in range(0, len(votes), 100))
    most, earliest = [], sv._earliest
    monkeypatch.setattr(sv, "_earliest", lambda rows, n: most.append(len(rows["item"])) or earliest(rows, n))
    got = sv._gathered(chunks, 15, False)
    assert max(most) <= 300
    for item in ("x", "i0", "i1", "i2"):
        mine = heapq.nsmallest(15, [(t, a, v) for i, a, v, t in votes if i == item])
        assert [x[1:] for x in zip(got["item"], got["ts_us"], got["annotator"], got["vote"]) if x[0] == item] == mine
    assert set(got["seen"]) == {8}

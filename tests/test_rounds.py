import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import identity as idn
from turnwise.operators import rounds as rd
from turnwise.operators import sampling as s

SCHEMA = ("study string, version string, status string, qids array<string>, admitted array<string>, "
          "participated array<string>, valid array<string>, votes array<struct<yes:double,n:int>>")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def first_fit_decreasing(sizes, length=10):
    if all(x == 0 for x in sizes) or all(x >= length for x in sizes):
        return [[i] for i in range(len(sizes))]
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        home = next((b for b in bins if sum(sizes[j] for j in b) + sizes[i] <= length), None)
        if home is None:
            bins.append([i])
        else:
            home.append(i)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_first_fit_decreasing(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 12, 15][: 3 + 2 * seed]) for _ in range(rnd.randrange(5, 120))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sizes)], "study int, size int")
    got = {}
    for r in rd.pack_studies(df).collect():
        got.setdefault(r["bin"], set()).add(r["study"])
    assert [got[b] for b in sorted(got)] == [set(b) for b in first_fit_decreasing(sizes)]


def test_round_closes_and_reopens(spark):
    rows = [
        ("A", "0", "COMPLETE", ["q1", "q2"], ["u1", "u2", "u3"], ["u1", "u2"], ["u1"], [(2.0, 6), (0.0, 3)]),
        ("B", "0", "COMPLETE", ["q3"], ["u1"], ["u1"], ["u1"], [(2.0, 9)]),
        ("C", "0", "PENDING", ["q4"], ["u1"], [], [], [(0.0, 0)]),
        ("D", "LAST", "COMPLETE", ["q5"], ["u1"], ["u1"], ["u1"], [(3.0, 3)]),
        ("E|F", "0|0", "COMPLETE", ["q6", "q7"], ["u1", "u9"], ["u1"], ["u1"], [(1.0, 3), (3.0, 3)]),
        ("E", "0", "COMPLETE", ["q6"], [], [], [], [(1.0, 3)]),
        ("F", "0", "COMPLETE", ["q7"], [], [], [], [(1.0, 3)]),
        ("E|F", "1|1", "COMPLETE", ["q6", "q7"], ["u1", "u9"], ["u1"], ["u1"], [(1.0, 3), (3.0, 3)]),
        ("T", "TRAIN", "COMPLETE", ["q0"], ["u1", "u5"], ["u1", "u5"], ["u5"], [(1.0, 3)]),
    ]
    rounds = table(spark, rows)
    plan = {(r["study"], r["version"]): r for r in rd.rerun_plan(rounds).collect()}
    assert set(plan) == {("A", "0"), ("B", "0"), ("E|F", "1|1")}
    a, b, ef = plan["A", "0"], plan["B", "0"], plan["E|F", "1|1"]
    assert (a["open_qids"], a["places"], a["remaining"], a["next_study"], a["closed_version"]) == (["q1"], 3, ["u3"], "A", "0")
    assert (b["open_qids"], b["closed_version"], b["next_study"]) == ([], "LAST", "")
    assert (ef["open_qids"], ef["next_study"], ef["next_version"], ef["closed_version"]) == (["q6"], "E", "1", "1|LAST")
    assert {(r["study"], r["version"]) for r in rd.highest_versions(rounds).collect()} == {
        ("D", "LAST"), ("A", "0"), ("B", "0"), ("E|F", "1|1")}
    assert {r["annotator"] for r in rd.qualified_annotators(rounds).collect()} == {"u5"}
    hist = {(r["study"], r["annotator"]) for r in rd.participant_history(rounds).collect()}
    assert ("E", "u1") in hist and ("F", "u1") in hist and ("A", "u3") not in hist
    load = {r["annotator"]: r["n_items"] for r in rd.workloads(rounds, rd.qualified_annotators(rounds)).collect()}
    assert load["u5"] == 0 and load["u1"] == 2 + 1 + 1 + 2 + 2


def test_failing_annotators(spark):
    rows = [(f"S{i}", "0", "COMPLETE", ["q"], [], ["r4", "r5", "r6"], ["r6"] if i else ["r5", "r6"], [(1.0, 1)]) for i in range(4)]
    assert {r["annotator"] for r in rd.failed_rounds(table(spark, rows)).collect()} == {"r4"}


def test_votes_carry_over_rounds(spark):
    items = spark.createDataFrame([("A", "q", 0, 2.0, 6), ("A", "q", 1, 0.0, 3), ("A", "z", 0, 1.0, 1)],
                                  "study string, qid string, version int, yes double, n int")
    got = {(r["qid"], r["version"]): (r["cum_yes"], r["cum_n"]) for r in rd.cumulate_votes(items).collect()}
    assert got == {("q", 0): (2.0, 6), ("q", 1): (2.0, 9), ("z", 0): (1.0, 1)}
    now = items.where("version = 1")
    assert rd.carry_votes(now, items).first().asDict() == {"study": "A", "qid": "q", "version": 1, "yes": 2.0, "n": 9}


def test_merged_studies(spark):
    packed = spark.createDataFrame([(0, "A", 3, "0", ["q1", "q2", "q3"], 2), (0, "B", 1, "4", ["q9"], 1), (1, "C", 2, "1", ["x"], 5)],
                                   "bin long, study string, size int, version string, qids array<string>, places int")
    got = {r["bin"]: r for r in rd.merged_studies(packed).collect()}
    assert (got[0]["study"], got[0]["version"], got[0]["qids"], got[0]["places"]) == ("A|B", "1|5", ["q1", "q2", "q3", "q9"], 1)


def test_candidates_skip_history_and_full_annotators(spark):
    studies = spark.createDataFrame([("S", 2, 3), ("T", 1, 50)], "study string, places long, n_items long")
    cap = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("d", 3), ("e", 0)], "annotator string, room long")
    history = spark.createDataFrame([("S", "a")], "study string, annotator string")
    got = [(r["study"], r["annotator"]) for r in rd.study_candidates(studies, cap, history).orderBy("study", "nth").collect()]
    assert got == [("S", "b"), ("S", "c")]


def test_pseudonyms_go_on_from_the_largest(spark):
    known = spark.createDataFrame([("u1", "PROLIFIC_7"), ("u2", "PROLIFIC_3")], "orig string, anon string")
    seen = spark.createDataFrame([("u9", 1), ("u1", 2), (None, 3), ("Lead-Team", 4), ("u8", 0), ("u9", 9)], "orig string, at int")
    got = {r["orig"]: r["anon"] for r in idn.extend_map(known, seen, "at").collect()}
    assert got == {"u1": "PROLIFIC_7", "u2": "PROLIFIC_3", "u8": "PROLIFIC_8", "u9": "PROLIFIC_9", "Lead-Team": "Lead-team"}
    rows = spark.createDataFrame([(1, "u9"), (2, "zz")], "k int, annotator string")
    mapped = idn.apply_map(rows, idn.extend_map(known, seen, "at"), "annotator")
    assert {(r["k"], r["annotator"]) for r in mapped.collect()} == {(1, "PROLIFIC_9"), (2, "zz")}


def test_lists_are_mapped_or_quarantined(spark):
    rows = spark.createDataFrame([
        (1, "0", ["u1", "x"], ["u1"]), (2, "0", ["u1"], ["u1", "x"]), (3, "TRAIN", ["u1"], ["x"]), (4, "0", [], [])],
        "id int, version string, admitted array<string>, valid array<string>")
    names = spark.createDataFrame([("u1", "A1")], "orig string, anon string")
    done, bad = idn.apply_map_to_lists(rows, names, ["id"], ["admitted", "valid"])
    assert {r["id"]: (r["admitted"], r["valid"]) for r in done.collect()} == {
        1: (["A1", "x"], ["A1"]), 3: (["u1"], ["x"]), 4: ([], [])}
    assert [r["id"] for r in bad.collect()] == [2]


def test_weighted_split_is_disjoint_and_near_its_shares(spark):
    rows = spark.range(2000).select(F.col("id").alias("qid"), (F.col("id") % 7 + 1).alias("weight"))
    got = s.weighted_split(rows, 3)
    assert got.select("qid").distinct().count() == 2000
    sizes = {r["split"]: r["n_annotations"] for r in s.split_sizes(got).collect()}
    total = sum(sizes.values())
    assert sizes["train"] / total == pytest.approx(0.7, abs=0.01) and sizes["dev"] / total == pytest.approx(0.15, abs=0.01)


def test_list_split_of_twenty(spark):
    ids = spark.range(20).select(F.col("id").alias("qid"))
    got = s.list_split(ids, 5).collect()
    counts = {k: sum(r["split"] == k for r in got) for k in ("train", "dev", "test")}
    assert counts == {"train": 14, "dev": 3, "test": 3}
    assert {r["qid"]: r["split"] for r in got} == {r["qid"]: r["split"] for r in s.list_split(ids, 5).collect()}

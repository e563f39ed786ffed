import json
import pytest
from pyspark.sql import functions as F

from turnwise.functions import measures as m
from turnwise.functions import quotes as q
from turnwise.functions import text as t
from turnwise.operators import agreement as a
from turnwise.operators import evaluation as e
from turnwise.operators import highlights as h
from turnwise.operators import stopping as st
from turnwise.operators import votes as v


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(x, list) else 'string'}" for k, x in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


def votes_of(spark, rows):
    """Rows are annotators, columns items, None = missing."""
    data = [(i, ann, x, ann) for ann, row in enumerate(rows) for i, x in enumerate(row) if x is not None]
    return spark.createDataFrame(data, "item int, annotator int, vote int, ord int")


def test_kappa_golden(spark):
    lists = spark.createDataFrame(list(zip([1, 0, 1, 1, 0, 1], [0, 0, 1, 1, 0, 0])), "x int, y int")
    row = a.two_list_scores(lists, "x", "y").first()
    assert row["kappa"] == pytest.approx(0.4) and row["overlap"] == pytest.approx(4 / 6)
    same = spark.createDataFrame([(1, 1)] * 4, "x int, y int")
    assert a.two_list_scores(same, "x", "y").first()["kappa"] == 1.0


def test_alpha_golden(spark):
    rows = [[0, 0, 1, 1, 1], [None] * 5, [0, 1, 1, 1, 0]]
    assert a.krippendorff_alpha(votes_of(spark, rows)).first()["alpha"] == pytest.approx(0.25)
    assert a.krippendorff_alpha(votes_of(spark, [[1, 1], [1, 1]])).first()["alpha"] is None


def test_alpha_with_categories(spark):
    # The worked example with three coders and fifteen units.
    coders = ["*****34123313*3", "12*3*41211133*3", "**213*1211*1*44"]
    coders = ["* * * * * 3 4 1 2 1 1 3 3 * 3", "1 * 2 1 3 3 4 3 * * * * * * *", "* * 2 1 3 4 4 * 2 1 1 3 3 * 4"]
    data = [(u, c) for row in coders for u, c in enumerate(row.split()) if c != "*"]
    df = spark.createDataFrame(data, "unit int, value string")
    assert a.nominal_alpha(df, "unit", "value").first()["alpha"] == pytest.approx(0.691358, abs=1e-6)


def test_fleiss_of_perfect_agreement(spark):
    assert a.fleiss_kappa(votes_of(spark, [[1, 0, 1]] * 3), 3).first()["fleiss"] == pytest.approx(1.0)


def test_majority_of_others_ties(spark):
    rows = [[1], [0], [1]]
    acc = {r["annotator"]: r["accuracy"] for r in a.majority_accuracy(votes_of(spark, rows)).collect()}
    assert acc == {0: 1.0, 1: 0.0, 2: 1.0}  # 0.5 counts as yes
    mv = {r["annotator"]: r["overlap"] for r in a.majority_kappa(votes_of(spark, rows)).collect()}
    assert mv == {0: 0.0, 1: 0.0, 2: 0.0}  # 0.5 rounds to even: no


@pytest.mark.parametrize("yes,n,need", [
    (0, 3, 0), (1, 3, 2), (2, 3, 2), (3, 3, 0), (1, 5, 0), (2, 5, 4), (2, 6, 3), (2, 9, 0), (4, 9, 6), (7, 14, 1),
    (7, 15, 0), (0, 1, 2), (10, 20, -5), (0, 20, 0), (0, 0, 3)])
def test_votes_needed(spark, yes, n, need):
    df = spark.createDataFrame([(yes, n)], "y int, n int")
    assert df.select(m.votes_needed("y", "n")).first()[0] == need


def test_reopened_items(spark):
    tallies = spark.createDataFrame(
        [("s", i, y, 3) for i, y in enumerate([2, 0, 3, 3, 1, 1, 0, 3, 3, 3], 1)], "study string, item int, yes int, n int")
    assert sorted(r["item"] for r in st.open_items(tallies).collect()) == [1, 5, 6]
    assert st.smallest_need(tallies).first()["places"] == 2


def test_highlight_jaccard(spark):
    marks = spark.createDataFrame([(1, 1, [1, 5, 6]), (1, 2, [1, 5]), (2, 1, [1]), (2, 2, [])],
                                  "item int, annotator int, hl array<int>")
    assert h.mean_joint_jaccard(marks).first()[0] == pytest.approx(2 / 3)
    empty = marks.where("item = 2")
    assert h.mean_joint_jaccard(empty).first()[0] == 0.0
    assert h.mean_joint_jaccard(marks.where("item = 9")).first()[0] is None


def test_weights_without_yes_votes(spark):
    marks = spark.createDataFrame([(1, 1, []), (1, 2, []), (2, 1, [2]), (2, 2, [1, 2])], "item int, annotator int, hl array<int>")
    toks = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"])], "item int, toks array<string>")
    got = {r["item"]: (r["weights"], r["yes"], r["n"]) for r in h.token_weights(marks, toks).collect()}
    assert got == {1: ([0.0, 0.0], 0, 2), 2: ([0.5, 1.0, 0.0], 2, 2)}


def test_zip_sum(spark):
    flags = spark.createDataFrame([(1, [0, 1, 1]), (1, [0, 1, 0]), (2, [0, 0])], "item int, flags array<int>")
    assert {r["item"]: r["sums"] for r in h.zip_sum(flags).collect()} == {1: [0, 2, 1], 2: [0, 0]}


def test_mean_cosine_equals_pairs(spark):
    import itertools
    import math
    vecs = [[1.0, 2.0], [0.5, -1.0], [3.0, 0.1]]
    df = spark.createDataFrame([(1, x) for x in vecs], "item int, vec array<double>")
    cos = [sum(i * j for i, j in zip(x, y)) / math.hypot(*x) / math.hypot(*y) for x, y in itertools.combinations(vecs, 2)]
    assert h.mean_cosine(df).first()["mean_cosine"] == pytest.approx(sum(cos) / 3)


def test_text_helpers(spark):
    assert one(spark, t.tokens("x"), x="a  b") == ["a", "", "b"]
    assert one(spark, t.tokens("x", "run"), x=" a \n b ") == ["a", "b"]
    assert one(spark, t.tokens("x", "run"), x="  ") == []
    assert one(spark, t.conversation_of("x"), x="CNN-67148-13") == "CNN-67148"
    assert one(spark, t.position_of("x"), x="CNN-67148-13") == 13
    assert one(spark, t.fraction("x"), x=" 10 / 20").asDict() == {"yes": 10, "n": 20}
    assert one(spark, t.fraction("x"), x="10") is None and one(spark, t.fraction("x"), x="a/b") is None
    assert one(spark, t.int_list("x"), x="[1, 5, 6]") == [1, 5, 6] and one(spark, t.int_list("x"), x="-") is None
    assert one(spark, t.string_list("x"), x="['a', 'b']") == ["a", "b"]
    for texts in (["don't", "y"], ['say "x"', "it's"], ["both ' and \" here"], ["[a]", "b\n\tc", "back\\slash \\x41"], ["é\xa0\x07", ""], []):
        assert one(spark, t.string_list("x"), x=repr(texts)) == texts
        assert one(spark, t.string_list("x"), x=json.dumps(texts)) == texts
    assert one(spark, t.string_list("x"), x="['a', b") is None
    assert one(spark, t.next_versions("x"), x="0|12") == "1|13"
    assert one(spark, t.rescale(F.array(*[F.lit(float(x)) for x in (0, 5, 4, 9, 10)]))) == [0, 50, 40, 90, 100]
    assert one(spark, t.rescale(F.array(F.lit(2.0), F.lit(2.0)))) == [0, 0]
    assert one(spark, t.mark_upper("x", F.array(F.lit(1), F.lit(3))), x=["a", "b", "c"]) == "A b C"
    assert one(spark, t.marked_text("x", F.array(F.lit(3), F.lit(1))), x=["a", "b", "c"]) == "c a"
    assert one(spark, t.marked_text("x", F.array().cast("array<int>")), x=["a"]) == ""
    spans = one(spark, t.equal_spans(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.5, 0.0)])))
    assert [(s["start"], s["stop"], s["weight"]) for s in spans] == [(0, 2, 0.0), (2, 3, 0.5), (3, 4, 0.0)]
    assert one(spark, t.equal_spans(F.array().cast("array<double>"))) == []
    assert one(spark, t.marked_flags(F.lit(4), F.array(F.lit(4), F.lit(1), F.lit(9)))) == [1, 0, 0, 1]


NJ = "so the state of new jersey is doing well and they have it right"


def test_quote_flags(spark):
    text = "Hello, this is a test. Hello, David."
    for quote in ('"Hello, David."', '"Hello, David"'):
        assert one(spark, q.quote_flags("x", "y"), x=text, y=quote) == [0, 0, 0, 0, 0, 1, 1]
    assert one(spark, q.quote_flags("x", "y"), x=text, y='"hello David"') is None
    assert one(spark, q.quote_flags("x", "y", True), x=text, y='"hello David"') == [0, 0, 0, 0, 0, 1, 1]
    assert one(spark, q.quote_flags("x", "y"), x=NJ, y='"new jersey is" and "have it"') == [0] * 4 + [1] * 3 + [0] * 4 + [1, 1, 0]
    assert one(spark, q.quote_flags("x", "y"), x=text, y='"" "Hello"') is None


def test_quoted_phrases(spark):
    assert one(spark, q.quoted_phrases("x"), x='He said "A b" and "C"') == ["a b", "c"]
    assert one(spark, q.quoted_phrases("x"), x="<quote>A</quote>") == ["a"]
    assert one(spark, q.quoted_phrases("x", F.lit("plain")), x="'A b'") == ["a b"]
    assert one(spark, q.quoted_phrases("x", F.lit("it's")), x="'A b'") == ["'a b'"]
    assert one(spark, q.quoted_phrases("x"), x='"open end') == ["open end"]


def test_verdicts(spark):
    assert one(spark, q.verdict("x"), x=" **Yes**, it is") == 1
    assert one(spark, q.verdict("x"), x="Not sure") == 0
    assert one(spark, q.verdict("x"), x="Maybe") is None
    assert one(spark, q.labelled_text("x", "Classification"), x="a\nClassification: Yes. \nClassification: No") == "Yes."
    assert one(spark, q.labelled_text("x", "Classification"), x="Yes") is None
    assert one(spark, q.says_none("x"), x="None.") is True
    assert one(spark, q.says_none("x"), x='he said "none of it"') is False
    assert one(spark, q.first_positions("x", "y"), x="a b a c", y="c a z") == [3, 0, -1]


def test_macro_scores(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (2, 0)], "gold int, pred int")
    row = e.macro_scores(df).first()
    assert row["accuracy"] == pytest.approx(0.6)
    assert row["f1"] == pytest.approx((2 / 3 + 2 * 2 / 6 + 0) / 3)


def test_stop_rules(spark):
    votes = [(1, i, x, i) for i, x in enumerate([1, 0, 1, 1, 1, 1, 0])] + [(2, i, 0, i) for i in range(4)]
    df = spark.createDataFrame(votes, "item int, annotator int, vote int, ord int")
    rows = st.vote_prefixes(df, 15, ["ord"])
    got = {r["item"]: r for r in rows.select(
        "item", st.need_stop().alias("need"), st.agreeing_stop(3).alias("agree"), st.agreeing_stop(9).alias("never"),
        st.entropy_stop(0.7).alias("entropy")).collect()}
    assert (got[1]["need"], got[1]["agree"], got[1]["never"]) == (5, 4, 7)
    assert (got[2]["need"], got[2]["agree"], got[2]["never"], got[2]["entropy"]) == (3, 3, 4, 3)


def test_kept_and_doubled_sessions(spark):
    rows = [("q1", "a", 1, "s1", 1, 1), ("q1", "a", 0, "s2", 2, 1), ("q2", "a", 1, "s1", 1, 2), ("q2", "b", 1, "s3", 3, 1)]
    df = spark.createDataFrame(rows, "item string, annotator string, vote int, session string, start int, line int")
    assert {(r["item"], r["annotator"], r["vote"]) for r in v.keep_last_vote(df).collect()} == {
        ("q1", "a", 0), ("q2", "a", 1), ("q2", "b", 1)}
    left = v.drop_doubled_sessions(df)
    assert {(r["item"], r["session"]) for r in left.collect()} == {("q1", "s2"), ("q2", "s3")}


@pytest.mark.parametrize("window_rows", [5_000, 10])
def test_running_median(spark, small_tasks, window_rows):
    import random
    import statistics
    rnd = random.Random(6)
    rows = [("hot" if i % 3 else f"k{i % 4}", i, float(rnd.randrange(9))) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, id int, value double")
    got = {r["id"]: r["running_median"] for r in v.running_median(df, "g", ["id"], window_rows).collect()}
    for g, i, _ in rows:
        assert got[i] == statistics.median(x for h, j, x in rows if h == g and j <= i)


@pytest.mark.parametrize("seed", range(3))
def test_best_annotator_split(spark, seed):
    import random
    rnd = random.Random(seed)
    m = 9
    rows = [(i, a) for i in range(12) for a in range(1, m + 1) if rnd.random() < 0.6]
    votes = spark.createDataFrame(rows, "item int, annotator int")
    ranked = spark.createDataFrame([(a, a) for a in range(1, m + 1)], "annotator int, rank long")
    expected = None
    for split in range(1, m + 1):
        left = [sum(a <= split for i, a in rows if i == item) for item in range(12)]
        right = [sum(a > split for i, a in rows if i == item) for item in range(12)]
        left, right = [x for x in left if x], [x for x in right if x]
        if left and right and min(left) == min(right):
            expected = (split, min(left))
    got = v.best_annotator_split(votes, ranked).first()
    assert (got["split_at"], got["max_k"]) == (expected or (None, None))


def test_agreement_by_cut(spark):
    votes = spark.createDataFrame(
        [(i, a, (i + a * (i % 3)) % 2, a) for i in range(12) for a in range(6)], "item int, annotator int, vote int, ord int")
    got = {(r["cut"], r["measure"]): r["value"] for r in st.agreement_by_cut(votes, ["ord"]).collect()}
    assert {c for c, _ in got} == {"first", "dynamic", "all"} and len(got) == 39
    assert got["first", "n_pairs"] == 3 and got["all", "n_pairs"] == 15
    only = a.agreement_report(votes, "all").collect()
    assert {r["measure"]: r["value"] for r in only} == {m: x for (c, m), x in got.items() if c == "all"}

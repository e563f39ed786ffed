"""Ordered and tiled plans give the same results split and unsplit."""

import itertools
import random
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import agreement, stopping
from turnwise.operators.dialogue import canonical_speakers, conversation_roles
from turnwise.operators.sets import in_every_study
from turnwise.operators.stopping import bootstrap_reliability, draws
from turnwise.operators.votes import arrival_progress, first_votes, keep_last_vote, running_median, split_coverage
from turnwise.plans import tiles
from turnwise.plans.ordered import ROWS_PER_TASK_CONF, Ordered, row_numbers
from turnwise.plans.quantiles import exact_quantiles
from turnwise.plans.tiles import _pack, _unpack, pair_tables, pairwise_jaccard


def skewed(n=400, seed=3):
    """One key holds a third of the rows, and order values repeat."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randrange(40)}"
        rows.append((key, rnd.randrange(60), i, rnd.randrange(5)))
    return rows


def test_running_and_previous_on_a_hot_key(spark, small_tasks):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, t int, id int, v int")
    o = Ordered(df, ["k"], ["t", "id"]).running(total=F.col("v"), rn=F.lit(1).cast("long")).previous(before="v")
    assert o.split
    got = {r["id"]: (r["total"], r["rn"], r["before"]) for r in o.result().collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        total, rn, before = 0, 0, None
        for _, _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            total, rn = total + v, rn + 1
            expected[i] = (total, rn, before)
            before = v
    assert got == expected


def test_previous_keeps_nulls_apart(spark, small_tasks):
    df = spark.createDataFrame([("a", i, None if i % 7 == 0 else i) for i in range(100)], "k string, i int, v int")
    got = Ordered(df, ["k"], ["i"]).previous(b="v").result().collect()
    for r in got:
        i = r["i"] - 1
        assert r["b"] == (None if i < 0 or i % 7 == 0 else i)


def test_null_keys_form_a_group(spark, small_tasks):
    df = spark.createDataFrame([(None, i) for i in range(70)] + [("a", i) for i in range(5)], "k string, i int")
    got = row_numbers(df, ["k"], ["i"]).collect()
    assert sorted(r["rn"] for r in got if r["k"] is None) == list(range(1, 71))


def test_global_numbers_are_dense(spark, small_tasks):
    ids = [f"x{i:04d}" for i in range(500)]
    random.Random(1).shuffle(ids)
    got = row_numbers(spark.createDataFrame([(i,) for i in ids], "id string"), [], ["id"]).collect()
    assert {r["id"]: r["rn"] for r in got} == {i: n for n, i in enumerate(sorted(ids), 1)}


def test_equal_order_values_stay_in_one_range(spark, small_tasks):
    df = spark.createDataFrame([("a", 1)] * 100 + [("a", 2)] * 10, "k string, t int")
    got = row_numbers(df, ["k"], ["t"]).collect()
    assert sorted(r["rn"] for r in got) == list(range(1, 111))
    assert max(r["rn"] for r in got if r["t"] == 1) == 100


def test_plain_plan_without_hot_keys(spark):
    df = spark.createDataFrame(skewed(), "k string, t int, id int, v int")
    assert not Ordered(df, ["k"], ["t", "id"]).split


@pytest.mark.parametrize("block,shard", [(256, 2048), (4, 3), (1, 1)])
def test_pair_tables_match_all_pairs(spark, block, shard):
    rnd = random.Random(5)
    votes = {}
    for item in range(25):
        for ann in range(18):
            if item == 0 or rnd.random() < 0.3:
                votes[item, ann] = rnd.randrange(2)
    df = spark.createDataFrame([(i, a, v) for (i, a), v in votes.items()], "item int, annotator int, vote int")
    got = {(r["a"], r["b"]): (r["n11"], r["n10"], r["n01"], r["n00"])
           for r in pair_tables(df, block=block, items_per_tile=shard).collect()}
    expected = {}
    for a, b in itertools.combinations(range(18), 2):
        cells = [0, 0, 0, 0]
        for item in range(25):
            if (item, a) in votes and (item, b) in votes:
                cells[{(1, 1): 0, (1, 0): 1, (0, 1): 2, (0, 0): 3}[votes[item, a], votes[item, b]]] += 1
        if sum(cells):
            expected[a, b] = tuple(cells)
    assert got == expected


def _votes_with_a_hot_item(seed=8):
    """Item 0 has all 40 annotators, the others about three."""
    rnd = random.Random(seed)
    return {(i, a): rnd.randrange(2) for i in range(120) for a in range(40) if i == 0 or rnd.random() < 0.08}


def _all_pairs(votes, study=lambda item: 0):
    out = {}
    for (i, a), x in votes.items():
        for b in range(a + 1, 40):
            if (i, b) in votes:
                cells = out.setdefault((study(i), a, b), [0, 0, 0, 0])
                cells[3 - 2 * x - votes[i, b]] += 1
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("listed,per_task", [(1024, 1 << 22), (1024, 50), (10, 50), (1, 10)])
@pytest.mark.parametrize("shared", [1, 2])
def test_listed_pairs_and_tiles_add_up(spark, listed, per_task, shared):
    votes = _votes_with_a_hot_item()
    df = spark.createDataFrame([(i, f"p{a:02d}", v) for (i, a), v in votes.items()], "item int, annotator string, vote int")
    rows = pair_tables(df, min_shared=shared, block=8, listed=listed, pairs_per_task=per_task).collect()
    got = {(0, int(r["a"][1:]), int(r["b"][1:])): (r["n11"], r["n10"], r["n01"], r["n00"]) for r in rows}
    assert len(got) == len(rows)
    assert got == {k: v for k, v in _all_pairs(votes).items() if sum(v) >= shared}


@pytest.mark.parametrize("listed,per_task", [(1024, 1 << 22), (1024, 60), (10, 60)])
def test_pairs_of_groups_of_items(spark, listed, per_task):
    votes = _votes_with_a_hot_item()
    df = spark.createDataFrame(
        [(f"s{i // 10}", i, a, v) for (i, a), v in votes.items()], "study string, item int, annotator int, vote int")
    rows = pair_tables(df, "study", 2, block=8, listed=listed, pairs_per_task=per_task).collect()
    got = {(r["study"], r["a"], r["b"]): (r["n11"], r["n10"], r["n01"], r["n00"]) for r in rows}
    assert len(got) == len(rows)
    assert got == {k: v for k, v in _all_pairs(votes, lambda i: f"s{i // 10}").items() if sum(v) >= 2}


@pytest.mark.parametrize("study", [None, "study"])
@pytest.mark.parametrize("listed,per_task", [(1024, 1 << 22), (1024, 50), (10, 50), (1, 10)])
def test_pairs_of_equal_counts_leave_their_tasks_together(spark, study, listed, per_task):
    votes = _votes_with_a_hot_item()
    df = spark.createDataFrame(
        [(i // 10, i, f"p{a:02d}", v) for (i, a), v in votes.items()], "study int, item int, annotator string, vote int")
    rows = pair_tables(df, study, 2, block=8, listed=listed, pairs_per_task=per_task, tally=True).collect()
    got = {(r["n11"], r["n10"], r["n01"], r["n00"]): r["c"] for r in rows}
    pairs = _all_pairs(votes, (lambda i: i // 10) if study else (lambda i: 0))
    assert len(got) == len(rows)
    assert got == Counter(v for v in pairs.values() if sum(v) >= 2)


def test_pairs_are_sent_in_few_bytes():
    """4 million pairs of 60,000 members take less than two bytes each, with their counts."""
    draw = np.random.default_rng(4)
    steps = draw.geometric(1 / 1800, 1 << 20)
    packed = _pack(steps)
    assert (_unpack(packed) == steps).all()
    assert len(packed) + len(_pack(np.ones_like(steps))) < 2 * len(steps)


def test_last_votes_are_sent_once(spark):
    """The order columns are not sent beside the row that holds them; the latest row counts."""
    df = spark.createDataFrame(
        [(1, 1, 5, 2, 1, 0), (1, 1, 4, 2, 2, 1), (1, 1, 9, 1, 9, 1), (2, 1, 1, 1, 1, None), (None, 1, 1, 1, 1, 1)],
        "item int, annotator int, session int, start int, line int, vote int")
    rows = keep_last_vote(df)
    assert {tuple(r) for r in rows.collect()} == {(1, 1, 5, 2, 1, 0), (2, 1, 1, 1, 1, None), (None, 1, 1, 1, 1, 1)}
    assert "max_by" not in rows._jdf.queryExecution().toString()


def _raw_votes(spark):
    """Some annotators voted again on an item; item 0 has many votes; some keys and votes are missing."""
    rnd = random.Random(12)
    rows = [(i, a, rnd.randrange(30), rnd.randrange(3), k, rnd.choice([0, 1, 1, None]))
            for i in range(60) for a in range(30) if i == 0 or rnd.random() < 0.2 for k in range(rnd.choice([1, 1, 1, 3]))]
    rows += [(None, a, 1, 1, 1, a % 2) for a in range(4)]
    return spark.createDataFrame(rows, "item int, annotator int, session int, start int, line int, vote int")


@pytest.mark.parametrize("listed,per_task,rows", [(1024, 1 << 22, 1 << 18), (1024, 50, 20), (10, 50, 1 << 18)])
def test_raw_votes_give_the_same_pairs(spark, monkeypatch, listed, per_task, rows):
    monkeypatch.setattr(tiles, "VOTES_PER_TASK", rows)
    raw = _raw_votes(spark)
    some = {"block": 8, "listed": listed, "pairs_per_task": per_task}
    for make, most in ((keep_last_vote, None), (lambda x: first_votes(keep_last_vote(x), 3), 3)):
        want = Counter(map(tuple, pair_tables(make(raw), **some).collect()))
        assert want == Counter(map(tuple, pair_tables(raw, most=most, prepare=make, **some).collect()))


def test_raw_votes_are_sent_once(spark):
    """Neither the last votes nor the items that are listed need another shuffle."""
    plan = pair_tables(_raw_votes(spark), tally=True, pairs_per_task=200, prepare=keep_last_vote)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange hashpartitioning(item" in line]
    assert len(sent) == 1 and "REPARTITION_BY_NUM" in sent[0]


def test_studies_of_raw_votes_are_those_of_votes(spark):
    raw = _raw_votes(spark)
    columns = ["n11", "n10", "n01", "n00", "c"]
    blocks = agreement.study_blocks(keep_last_vote(raw).select("item", "annotator", "vote"))
    want = agreement.pairwise_kappa(blocks, 2, "study", tally=True).select(*columns).collect()
    got = agreement.study_kappa(raw, keep_last_vote, 2, tally=True).select(*columns)
    assert want and Counter(map(tuple, want)) == Counter(map(tuple, got.collect()))


@pytest.mark.parametrize("listed", [1024, 10])
def test_report_of_raw_votes_is_that_of_votes(spark, monkeypatch, listed):
    monkeypatch.setattr(agreement, "LISTED", listed)
    raw = _raw_votes(spark)
    want = {r["measure"]: r["value"] for r in agreement.agreement_report(keep_last_vote(raw), "all").collect()}
    got = {r["measure"]: r["value"] for r in agreement.agreement_report(raw, "all", prepare=keep_last_vote).collect()}
    assert got == pytest.approx(want) and None not in want.values()


def test_votes_of_small_items_are_not_copied(spark):
    """However many blocks of annotators there are, a vote of an item with few votes is moved once."""
    df = spark.createDataFrame([(i, 7 * i + a, a % 2) for i in range(50) for a in range(5)], "item int, annotator int, vote int")
    rows = pair_tables(df, block=1)
    assert "Generate" not in rows._jdf.queryExecution().toString()
    assert rows.count() == 50 * 10


@pytest.mark.parametrize("per_block", [64, 5, 1])
def test_pairwise_jaccard_matches_all_pairs(spark, per_block):
    rnd = random.Random(9)
    rows = []
    for item, n in ((0, 40), (1, 3), (2, 1), (3, 6)):
        for _ in range(n):
            rows.append((item, sorted(rnd.sample(range(1, 7), rnd.randrange(0, 4)))))
    df = spark.createDataFrame(rows, "item int, hl array<int>")
    got = {r["item"]: (r["overlap"], r["pairs"]) for r in pairwise_jaccard(df, per_block).collect()}
    for item in range(4):
        sets = [set(h) for i, h in rows if i == item and h]
        js = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2)]
        if not sets:
            assert item not in got
            continue
        assert got[item][1] == len(js)
        assert got[item][0] == pytest.approx(sum(js))


def both_paths(spark, make):
    """Rows of ``make()`` with groups of any size in one task, and cut into ranges of about ten rows."""
    key = lambda r: str(tuple(r))
    plain = sorted(make().collect(), key=key)
    spark.conf.set(ROWS_PER_TASK_CONF, "20")
    try:
        return plain, sorted(make().collect(), key=key)
    finally:
        spark.conf.unset(ROWS_PER_TASK_CONF)


def gaps(spark, n=400):
    """A hot group with NULL values, a group of NULLs only, repeated order values, a NULL group."""
    rnd = random.Random(11)
    rows = [("hot" if i % 2 else rnd.choice(["a", "none", None]), i // 3, i, None if i < 40 or rnd.random() < 0.3 else float(rnd.randrange(6)), rnd.randrange(2))
            for i in range(n)]
    return spark.createDataFrame(
        [(k, t, i, None if k == "none" else v, a) for k, t, i, v, a in rows], "k string, t int, id int, value double, accepted int")


def test_running_sums_with_nulls(spark):
    df = gaps(spark)
    plain, split = both_paths(spark, lambda: Ordered(df, ["k"], ["t", "id"]).running(
        total=F.col("value"), n=F.lit(1).cast("long"), seen=F.col("value").isNotNull().cast("int")).previous(before="value").result())
    assert plain == split and any(r["total"] is None for r in plain)


def test_arrival_progress_on_both_paths(spark):
    df = gaps(spark)
    plain, split = both_paths(spark, lambda: arrival_progress(df, "k", ["t", "id"]))
    assert plain == split


def test_running_median_on_both_paths(spark, small_tasks):
    df = gaps(spark, 120)
    key = lambda r: (r["id"],)
    window = sorted(running_median(df, "k", ["t", "id"]).collect(), key=key)
    bits = sorted(running_median(df, "k", ["t", "id"], window_rows=1).select(*df.columns, "running_median").collect(), key=key)
    assert window == bits
    few = spark.createDataFrame([("g", i, i, v, 0) for i, v in enumerate([5.0, None, 1.0, 9.0, 2.0, None, 7.0])], df.schema)
    for rows in (5_000, 1):
        got = sorted(running_median(few, "k", ["t", "id"], window_rows=rows).collect(), key=key)
        assert [r["running_median"] for r in got] == [5, 5, 3, 5, 3.5, 3.5, 5]


def test_ranges_follow_the_rows(spark):
    """More than 2,000 ranges, and no range above the limit."""
    df = spark.range(2_200).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 2_200).alias("t"))
    spark.conf.set(ROWS_PER_TASK_CONF, "2")
    try:
        o = Ordered(df, ["k"], ["t"])
        sizes = [r["count"] for r in o.df.groupBy("__range").count().collect()]
        assert len(sizes) > 2_000 and max(sizes) <= 2
        got = o.row_number().result().agg(F.count_if(F.col("rn") == F.col("t") + 1)).first()[0]
        assert got == 2_200
    finally:
        spark.conf.unset(ROWS_PER_TASK_CONF)


def test_casts_on_both_paths(spark):
    rows = [("c1", i, s) for i, s in enumerate(["ANN", "BOB", None, "ANN", "BOB RAY"])]
    rows += [("c2", i, f"NAME {i % 40}") for i in range(60)] + [("c3", 0, None), ("c4", 0, ""), ("c4", 1, "X"), ("c5", 0, "A" * 3_000), ("c5", 1, "A" * 2_999)]
    said = spark.createDataFrame([(c, p, s, "t") for c, p, s in rows], "conv string, pos int, speaker string, text string")
    for operator in (canonical_speakers, conversation_roles):
        plain, one, split = (sorted(map(tuple, operator(said, n).collect()), key=str) for n in (1_000, 32, 0))
        assert plain == one == split
    roles = {r["conv"]: (r["n_speakers"], r["two_speakers"]) for r in conversation_roles(said).collect()}
    assert roles["c1"] == (2, True) and "c3" not in roles


def test_exact_quantiles(spark):
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75, "low": 0.0, "top": 1.0}
    for values in ([], [3.0], [5.0, None, 1.0, 9.0, 2.0, None, 7.0], [1.0] * 50 + [2.0] * 50, [float(i * 7 % 101) for i in range(101)]):
        rows = spark.createDataFrame([(v,) for v in values], "v double")
        want = rows.agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()])
        plain, split = both_paths(spark, lambda: exact_quantiles(rows, F.col("v"), shares))
        assert plain == split == want.collect()


def test_highlights_of_a_large_item_meet_only_where_they_share_tokens(spark, small_tasks):
    """Short lists along a long text: the index of tokens leaves out most pairs of blocks, and nothing else."""
    rng = random.Random(5)
    rows = [("big", sorted({s + d for d in (0, rng.randint(0, 3), rng.randint(0, 3))})) for s in rng.sample(range(5_000), 400)]
    rows += [("big", [7]), ("big", [7]), ("small", [1, 2]), ("small", [2]), ("none", [])]
    df = spark.createDataFrame(rows, "item string, hl array<int>")
    want = {}
    for item in ("big", "small"):
        sets = [set(h) for i, h in rows if i == item and h]
        want[item] = (sum(len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2)), len(sets) * (len(sets) - 1) / 2)
    got = {r["item"]: (r["overlap"], r["pairs"]) for r in pairwise_jaccard(df, 8).collect()}
    assert set(got) == set(want)
    for item in want:
        assert got[item] == pytest.approx(want[item])


def test_pairs_of_more_items_than_a_word_holds(spark):
    """Counts over several words of 64 items, in one study and in many small ones."""
    rng = random.Random(8)
    votes = [(i, f"a{p}", rng.randint(0, 1), i // 7) for i in range(300) for p in range(12) if rng.random() < 0.6]
    df = spark.createDataFrame(votes, "item int, annotator string, vote int, study int")
    for extra, keys in ((None, lambda r: ()), ("study", lambda r: (r[3],))):
        want = {}
        by_item = {}
        for r in votes:
            by_item.setdefault((keys(r), r[0]), []).append((r[1], r[2]))
        for (key, _), people in by_item.items():
            for (a, x), (b, y) in itertools.combinations(sorted(people), 2):
                cell = want.setdefault((*key, a, b), [0, 0, 0, 0])
                cell[{(1, 1): 0, (1, 0): 1, (0, 1): 2, (0, 0): 3}[x, y]] += 1
        for block in (256, 3):
            got = pair_tables(df, extra, block=block).collect()
            assert {(*([r[extra]] if extra else []), r["a"], r["b"]): [r["n11"], r["n10"], r["n01"], r["n00"]] for r in got} == want


def test_running_median_of_many_values_takes_few_passes(spark, small_tasks, monkeypatch):
    """Codes of 9 bits: two passes of a digit, one stored table each besides the ones before."""
    from turnwise.operators import votes as v
    rng = random.Random(6)
    rows = [(rng.choice(["x", "x", "x", None, "y"]), i, float(rng.randint(0, 399)) if rng.random() < 0.9 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, id int, value double")
    stored = []
    cut = v.cut_lineage
    monkeypatch.setattr(v, "cut_lineage", lambda d: stored.append(d.columns) or cut(d))
    got = {r["id"]: r["running_median"] for r in v.running_median(df, "g", ["id"], 1).collect()}
    seen, want = {}, {}
    for g, i, value in rows:
        own = seen.setdefault(g, [])
        if value is not None:
            own.append(value)
        middle = sorted(own)
        want[i] = (middle[(len(own) - 1) // 2] + middle[len(own) // 2]) / 2 if own else None
    assert got == want
    assert sum("range" in columns for columns in stored) == 2


@pytest.mark.parametrize("items", [[b"12345", b"99999"], [b""], [b"x" * 44], [b"y" * 45], [b"q" * 60]])
def test_draws_are_md5(items):
    """The draws of many items at once are those of the digests, also of names too long for one block."""
    got = draws(1, items, 100, 20)
    for g, item in enumerate(items):
        for r, j in itertools.product((1, 9, 10, 99, 100), (1, 9, 10, 20)):
            assert got[g, r - 1, j - 1] == int.from_bytes(md5(b"1|%d|%s|%d" % (r, item, j)).digest()[:4], "big")


def test_bootstrap_is_dealt_by_number(spark, monkeypatch):
    """Few bytes are much work: the number of tasks follows the draws."""
    monkeypatch.setattr(stopping, "DRAWS_PER_TASK", 500)
    df = spark.createDataFrame([(i, a, a % 2) for i in range(40) for a in range(5)], "item int, annotator int, vote int")
    rows = bootstrap_reliability(df, 5, 10, order=["annotator"])
    assert "RepartitionByExpression [item#" in (plan := rows._jdf.queryExecution().toString()) and "], 4" in plan
    assert sorted(r["k"] for r in rows.collect()) == [1, 2, 3, 4, 5]


def test_spans_are_merged_before_they_are_cut(spark):
    """Split points by brute force; many items with the same spans leave few rows to cut into blocks."""
    rnd = random.Random(2)
    votes = {(i, a) for i in range(30) for a in range(1, 24) if rnd.random() < 0.4}
    df = spark.createDataFrame([(i, f"p{a}") for i, a in votes], "item int, annotator string")
    ranked = spark.createDataFrame([(f"p{a}", a) for a in range(1, 24)], "annotator string, rank int")
    rows = split_coverage(df, ranked)
    assert rows._jdf.queryExecution().toString().count("Generate") >= 6  # halves, blocks and points in two plans
    got = {r["i"]: (r["min_left"], r["min_right"]) for r in rows.collect()}
    items = {i for i, _ in votes}
    for split in range(1, 24):
        left = [n for i in items if (n := sum(1 for j, a in votes if j == i and a <= split))]
        right = [n for i in items if (n := sum(1 for j, a in votes if j == i and a > split))]
        assert got[split] == (min(left, default=None), min(right, default=None))


def test_members_of_studies_are_dealt_by_number(spark, small_tasks):
    members = spark.createDataFrame([(s, a) for s in range(6) for a in range(20) if (s + a) % 5], "study int, annotator int")
    studies = spark.createDataFrame([(s // 2, s) for s in range(6)], "group int, study int")
    rows = in_every_study(members, studies)
    assert "RepartitionByExpression [group#" in (plan := rows._jdf.queryExecution().toString()) and "], 5" in plan
    assert {tuple(r) for r in rows.collect()} == {
        (g, a) for g in range(3) for a in range(20) if (2 * g + a) % 5 and (2 * g + 1 + a) % 5}

import random

import pytest
from pyspark.sql import functions as F

from turnwise.operators import dialogue as d
from turnwise.operators import pairs as p

HOST, GUEST = "JO ADAMS, host", "Dr. LEE BROWN (Director)"
#   A 24-utterance talk: host 0-1, guest 2, ... guest 10-11, 15-16; utterance 18 is one word.
SPEAKERS = [0, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 1, 0, 1, 0, 1, 1, 0, 1, 0, 1, 0, 1, 0]
EXPECTED = [([4], [5], [6]), ([6], [7], [8]), ([8], [9], [10, 11]), ([10, 11], [12], [13]),
            ([13], [14], [15, 16]), ([15, 16], [17], [18])]


def talk(conv="NPR-4", names=(HOST, GUEST), speakers=SPEAKERS):
    return [(conv, i, names[s], "Mm-hmm." if i == 18 else f"this is utterance {i}") for i, s in enumerate(speakers)]


def utterances(spark, rows):
    return spark.createDataFrame(rows, "conv string, pos int, speaker string, text string")


def positions(df):
    return sorted((tuple(r["guest_idx"]), tuple(r["host_idx"]), tuple(r["reply_idx"]))
                  for r in p.pair_positions(df).collect())


def test_six_pairs(spark):
    rows = talk() + talk("SHORT", speakers=[0, 1, 0, 1]) + [
        r if r[1] != 9 else (r[0], r[1], "THIRD PERSON", r[3]) for r in talk("THREE")]
    runs = d.speaker_runs(utterances(spark, rows))
    got = positions(p.extract_pairs(runs))
    assert got == sorted(tuple(tuple(x) for x in e) for e in EXPECTED)
    reasons = {(r["source"], r["reason"]): r["n"] for r in p.rejects_by_source(
        runs, d.conversation_roles(utterances(spark, rows))).collect()}
    assert reasons == {("NPR", "kept"): 6, ("NPR", "short_guest"): 1, ("other", "short_dialogue"): 1,
                       ("other", "not_two_speakers"): 1}


def test_pairs_of_a_hot_conversation(spark, small_tasks):
    rnd = random.Random(2)
    long = [0]
    while len(long) < 300:
        long += [1 - long[-1]] * rnd.randrange(1, 4)
    rows = talk("HOT", speakers=long) + talk()
    split = d.speaker_runs(utterances(spark, rows))
    assert split.split
    got = positions(p.extract_pairs(split))
    spark.conf.set("spark.turnwise.rowsPerTask", "1000000")
    plain = d.speaker_runs(utterances(spark, rows))
    assert not plain.split
    assert got == positions(p.extract_pairs(plain)) and len(got) > 50


def test_chunk_halo(spark, small_tasks, monkeypatch):
    monkeypatch.setattr(p, "CHUNK", 8)
    rows = talk("HOT", speakers=[i % 2 for i in range(200)])
    got = positions(p.extract_pairs(d.speaker_runs(utterances(spark, rows))))
    assert got == sorted(((i,), (i + 1,), (i + 2,)) for i in range(3, 197, 2) if 18 not in (i, i + 1))


def test_strict_short_turns(spark):
    rows = [(c, i, s, "hi" if i == 12 else t) for c, i, s, t in talk()]
    runs = d.speaker_runs(utterances(spark, rows))
    assert len(positions(p.extract_pairs(runs))) == 6  # two guest utterances skip the test of the host
    assert len(positions(p.extract_pairs(runs, strict=True))) == 5


NAMES = ["MADELEINE BRAND, host", "Mr. RANDY HALL", "STEVE PROFFITT", "Ms. SUSAN STURGILL", "PROFFITT", "Ms. BARBARA LEBEY"]


@pytest.mark.parametrize("in_row", [32, 1])
def test_canonical_names(spark, in_row):
    got = {r["speaker"]: r["canon"] for r in d.canonical_speakers(
        utterances(spark, [("c", i, n, "x") for i, n in enumerate(NAMES)]), in_row).collect()}
    assert got == {n: ("STEVE PROFFITT" if n == "PROFFITT" else n) for n in NAMES}


@pytest.mark.parametrize("in_row", [32, 1])
def test_canonical_names_against_the_rule(spark, in_row):
    rnd = random.Random(4)
    rows = []
    for conv in range(6):
        for pos in range(rnd.randrange(3, 20)):
            rows.append((f"c{conv}", pos, "".join(rnd.choice("AB ") for _ in range(rnd.randrange(1, 5))), "x"))
    got = {(r["conv"], r["speaker"]): r["canon"]
           for r in d.canonical_speakers(utterances(spark, rows), in_row).collect()}
    for conv, _, name, _ in rows:
        last = {r[2]: r[1] for r in rows if r[0] == conv}
        owners = [n for n in last if name in n]
        assert got[conv, name] == max(owners, key=lambda n: (len(n), last[n]))


def test_roles_with_many_names_agree(spark):
    rows = utterances(spark, talk() + talk("B", ("LEE", "LEE BROWN, anchor")) + talk("C", ("A HOST", "B ANCHOR")))
    few = {r["conv"]: r.asDict() for r in d.conversation_roles(rows).collect()}
    many = {r["conv"]: r.asDict() for r in d.conversation_roles(rows, in_row=0).collect()}
    assert few == many
    assert [few[c]["two_speakers"] for c in ("NPR-4", "B", "C")] == [True, False, False]


@pytest.mark.parametrize("names,expected", [
    (("A", "B"), True), (("A", "B, HOST"), False), (("A", "B (anchor)"), False)])
def test_two_speakers(spark, names, expected):
    assert d.conversation_roles(utterances(spark, talk(names=names))).first()["two_speakers"] is expected


def test_run_starts(spark):
    df = spark.createDataFrame([("a", i) for i in (4, 6, 8, 10, 11, 12, 14)], "conv string, pos int")
    assert sorted(r["pos"] for r in d.run_starts(df).collect()) == [4, 6, 8, 10, 14]


def test_texts_rebuilt_from_positions(spark):
    rows = utterances(spark, talk())
    pairs = p.extract_pairs(d.speaker_runs(rows))
    direct = {r["qid"]: r for r in p.pair_texts(pairs, " \n").collect()}
    for r in p.rebuild_texts(p.pair_positions(pairs), rows).collect():
        for side in ("guest_text", "host_text", "reply_text"):
            assert r[side] == direct[r["qid"]][side]


def test_resolved_ids(spark):
    runs = d.speaker_runs(utterances(spark, talk()))
    qids = spark.createDataFrame([("NPR-4-10",), ("NPR-4-22",), ("NPR-4-0",), ("X-1",)], "qid string")
    got = {r["qid"]: (r["guest_stop"], r["host_stop"], r["resolved"]) for r in p.resolve_pair_ids(qids, runs).collect()}
    assert got["NPR-4-10"] == (12, 13, True)
    assert not got["NPR-4-22"][2] and not got["NPR-4-0"][2] and not got["X-1"][2]


def test_cap_ignores_rejected_pairs(spark):
    rows = [("a", i, f"a-{i}", "w " * (300 if i < 3 else 3), "x y") for i in range(10)]
    df = spark.createDataFrame(rows, "conv string, guest_pos int, qid string, guest_text string, host_text string")
    assert sorted(r["guest_pos"] for r in p.capped_pairs(df).collect()) == [3, 4, 5, 6, 7]


def test_interviews_explode_in_order(spark):
    df = spark.createDataFrame([("i", ["a", "b"], ["x", "y"])], "id string, speaker array<string>, utt array<string>")
    assert [(r["pos"], r["speaker"], r["text"]) for r in d.explode_interviews(df).orderBy("pos").collect()] == [
        (0, "a", "x"), (1, "b", "y")]


def test_shuffled_conversations_stay_together(spark):
    df = spark.createDataFrame([(c, i) for c in "abcdef" for i in range(3)], "conv string, guest_pos int")
    got = [(r["conv"], r["guest_pos"]) for r in d.shuffled_conversations(df, 1).collect()]
    assert [g for _, g in got] == [0, 1, 2] * 6 and len({c for c, _ in got[:3]}) == 1
    assert got == [(r["conv"], r["guest_pos"]) for r in d.shuffled_conversations(df, 1).collect()]
    assert F is not None


def test_phrases_are_found_letter_by_letter(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "b", "ca", "x", "Zürich", "東京", "a.b", "%_", "(c"]
    texts = [(k, rng.choice(["", " "]) + rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(200)]
    texts += [(200, None), (201, ""), (None, "ab abc b"), (3, "again ca x b"), (202, "ab " * 3_000 + "end")]
    phrases = {"ab", "b", "bc b", "ab abc b", " x ", "x  ca", "ca\nx", "京", "%_", "(c ab", "c b x a", "never here", "not x b", "b end", "ab ab ab end"}
    for text in rng.sample([t for _, t in texts if t and len(t) > 12], 10):
        at = rng.randrange(len(text) - 8)
        phrases.add(text[at:at + rng.randint(1, 30)])
    frame = spark.createDataFrame(texts, "doc_id int, text string")
    table = spark.createDataFrame([(p,) for p in phrases] + [(None,), ("ab",)], "phrase string")
    want = {(k, p) for k, t in texts for p in phrases if t is not None and p in t}
    assert {tuple(r) for r in p.phrase_hits(frame, table, "doc_id", "text").collect()} == want
    rows = sorted(map(str, [(k, t) for k, t in texts if t is not None and any(p in t for p in ("x b", "Zürich 東京 ca"))]))
    assert sorted(map(str, map(tuple, p.search_texts(frame, ["x b", "Zürich 東京 ca"], "text", "doc_id").collect()))) == rows
    assert p.search_texts(frame, [], "text", "doc_id").count() == 0
    assert p.search_texts(frame, [""], "text", "doc_id").count() == len(texts) - 1
    plan = p.search_texts(frame, sorted(phrases), "text", "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "never here" not in plan

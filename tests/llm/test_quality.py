import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import quality
from turnwise.llm.quality import RuleModel, fit_quality, fit_rules, held_out, holds, score_quality, statistics

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def corpus(prose):
    draw, rows = random.Random(8), []
    spoil = [
        lambda t: t.upper().replace(" ", "!! "), lambda t: " ".join(w for w in t.split() for _ in range(6)),
        lambda t: t.replace(" ", "### "), lambda t: t.replace(" ", " | ")]
    for i in range(800):
        text = prose(draw.randint(8, 150)).capitalize() + "."
        bad = draw.random() < 0.25
        rows.append((i, draw.choice(spoil)(text) if bad else text, int(not bad)))
    return rows


def test_held_out_accuracy(spark, documents, corpus, odd):
    docs = documents([(i, t) for i, t, _ in corpus] + [(i and i + 10_000, t) for i, t in odd])
    labels = spark.createDataFrame([(i, q, 0, "x") for i, _, q in corpus] + [(None, 1, 0, "x"), (5, None, 0, "x"), (99_999, 0, 0, "x")], LABELS)
    model = fit_quality(docs, labels)
    assert 0 < len(model.rules) < 200
    scored = score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held"), "score", "predicted").collect()
    assert len(scored) == len(corpus) + len(odd)
    truth = {i: q for i, _, q in corpus}
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    own = [r for r in scored if r.held and r.doc_id in truth]
    assert len(own) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.95
    again = fit_quality(docs.repartition(7), labels.repartition(3))
    assert again == model


def test_held_out_labels_are_never_learned(spark, documents, corpus):
    docs = documents([(i, t) for i, t, _ in corpus])
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0, "x") for i, _, q in corpus]
    straight = [(i, q, 0, "x") for i, _, q in corpus]
    assert fit_quality(docs, spark.createDataFrame(flipped, LABELS)) == fit_quality(docs, spark.createDataFrame(straight, LABELS))


def test_without_two_classes(spark, documents):
    docs = documents([(1, "a"), (2, None)])
    none = spark.createDataFrame([], LABELS)
    model = fit_quality(docs, none)
    assert model.rules == [] and [r.score for r in score_quality(docs, model).collect()] == [0.5, 0.5]
    assert score_quality(documents([]), model).collect() == []
    assert fit_rules(np.zeros((3, 12)), np.ones(3)).intercept == pytest.approx(np.log(4))


def test_compiled_rules_are_the_plain_ones(spark, documents, corpus, odd):
    docs = documents([(i, t) for i, t, _ in corpus[:200]] + odd)
    x = [tuple(r[0]) for r in docs.select(statistics(quality.full("text"))).collect()]
    x = np.array(x, float)
    y = np.array([q for _, _, q in corpus[:200]] + [1] * len(odd), float)
    model = fit_rules(x, y)
    want = model.intercept + sum(w * holds(r, x) for r, w in model.rules)
    got = [r.score for r in score_quality(docs, model).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-want)))


def test_statistics(spark):
    rows = spark.createDataFrame([("Ab ab ab! 12\nÉ #",), ("",)], "text string")
    full, empty = (r[0] for r in rows.select(statistics(rows.text)).collect())
    assert (full.chars, full.words, full.lines) == (16, 6, 1 / 6)
    assert full.upper == 2 / 16 and full.digits == 2 / 16 and full.marks == 1 / 16 and full.symbols == 1 / 16
    assert full.distinct == 1.0 and full.repeats == 0.0 and full.short == 1.0
    assert all(v == 0 for v in empty)
    repeated = spark.createDataFrame([("x x x y y",)], "text string")
    assert repeated.select(statistics(repeated.text)).first()[0].repeats == 3 / 5


def test_clashing_columns_are_replaced(spark):
    docs = spark.createDataFrame([("a", 7.0, "x", 1)], "text string, score double, Predicted string, row int")
    got = score_quality(docs, RuleModel(0.0, []))
    assert got.columns == ["text", "row", "score", "predicted"] and got.first() == ("a", 1, 0.5, 1)

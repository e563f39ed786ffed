import random

import numpy as np
import pytest

from turnwise.llm.licenses import CUE, NEW, TEMPLATES, UNKNOWN, fit_licenses, ngrams, paragraph_ngrams, scan_licenses, words_of


@pytest.fixture(scope="module")
def model(prose):
    return fit_licenses([prose(random.Random(i).randint(3, 40)) for i in range(300)])


@pytest.fixture(scope="module")
def scanned(spark, documents, model, prose, odd):
    rows, want = list(odd), {}
    for k, (family, notices) in enumerate(TEMPLATES.items()):
        for n, notice in enumerate(notices):
            key = 1_000 + 10 * k + n
            rows.append((key, f"{prose(30)}\n{notice}\n{prose(20)}"))
            rows.append((key + 5_000, notice.upper() + " " + prose(5)))
            want[key, 1] = want[key + 5_000, 0] = family
    for n, notice in enumerate(UNKNOWN):
        rows.append((20_000 + n, f"{prose(10)}\n\n{notice}"))
    rows += [(30_000 + n, prose(100)) for n in range(30)] + [(None, TEMPLATES["mit"][0]), (None, TEMPLATES["mit"][0])]
    return rows, want, scan_licenses(documents(rows), model).collect()


def test_families(scanned):
    rows, want, got = scanned
    found = {(r.doc_id, r.paragraph): r for r in got}
    for key, family in want.items():
        assert found[key].family == family, (key, family, found[key])
    assert sum(r.doc_id is None and r.family == "mit" for r in got) == 2
    assert not [r for r in got if r.doc_id and (r.doc_id < 1_000 or r.doc_id >= 30_000)]
    new = [r for r in got if r.doc_id and 20_000 <= r.doc_id < 30_000]
    assert all(r.family == NEW for r in new)


def test_scan_is_the_plain_classifier(scanned, model):
    rows, _, got = scanned
    best = {}
    for key, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if not CUE.search(line.lower()):
                continue  # holds no feature
            p = model.probabilities(line)
            if p[-1] < p[:-1].max():
                overlap = max(len(own & ngrams(line)) / len(own) for f, own in model.templates if f == model.classes[p[:-1].argmax()])
                best.setdefault((key, n), (model.classes[p[:-1].argmax()], p[:-1].max(), overlap))
    assert {(r.doc_id, r.paragraph) for r in got} == set(best)
    for r in got:
        family, p, overlap = best[r.doc_id, r.paragraph]
        assert r.predicted == family and r.probability == pytest.approx(p, abs=1e-5) and r.overlap == pytest.approx(overlap, abs=1e-5)
        assert r.family == (family if p >= model.threshold and overlap >= 0.6 else NEW)


def test_weights_are_sparse_and_hold_cues(model):
    assert 0 < len(model.weights) < 1_000
    assert np.mean([np.mean(np.abs(w) < 1e-9) for w in model.weights.values()]) > 0.25


def test_ngrams_are_the_same_in_both_places(spark):
    texts = ["Licensed under CC BY-NC 4.0.", "one", "", "É 1.2.3 x", "a b c d a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [set(r[0]) for r in rows.select(paragraph_ngrams(words_of(rows.t))).collect()] == [ngrams(t) for t in texts]


def test_empty(documents, model):
    assert scan_licenses(documents([]), model).collect() == []
    assert scan_licenses(documents([(1, None), (2, "")]), model).collect() == []


SHORT = {
    "This article is available under CC BY-SA 4.0.": "cc-by-sa", "CC BY 4.0": "cc-by", "Released under MIT.": "mit",
    "Distributed under the BSD 3-Clause terms.": "bsd", "Available under MPL 2.0": "mpl-2.0"}


def test_notices_without_a_cue(documents, model, prose):
    assert not any(CUE.search(t.lower()) for t in SHORT)
    rows = [(n, f"{prose(12)}\n{t}\n{prose(12)}") for n, t in enumerate(SHORT)]
    got = scan_licenses(documents(rows), model).collect()
    assert {(r.doc_id, r.paragraph): r.family for r in got} == {(n, 1): f for n, f in enumerate(SHORT.values())}


def test_scan_is_the_plain_classifier_without_cues(documents, model, prose):
    draw, words = random.Random(5), ["mit", "by", "cc", "sa", "nc", "bsd", "mpl", "2.0", "4.0", "3", "1.2by", "under", "the", "released"]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 6)) + prose(draw.randint(1, 4)).split()) for _ in range(400)]
    want = {n: p[:-1].max() for n, p in enumerate(map(model.probabilities, texts)) if p[-1] < p[:-1].max()}
    got = scan_licenses(documents(list(enumerate(texts))), model).collect()
    assert 20 < len(want) and {r.doc_id: r.probability for r in got} == pytest.approx(want, abs=1e-5)


def test_german_mit_is_other_text(documents, prose):
    draw = random.Random(9)
    german = [f"{prose(draw.randint(1, 8))} mit {prose(draw.randint(1, 8))} by {prose(2)}" for _ in range(300)]
    model = fit_licenses(german)
    got = scan_licenses(documents([*enumerate(german), (1_000, "Released under MIT.")]), model).collect()
    assert [(r.doc_id, r.family) for r in got] == [(1_000, "mit")]

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline as pipeline
from turnwise.llm import similar
from turnwise.llm.similar import BAND, BANDS, buckets, common_counts, minima, shingle_set, similar_groups


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows):
    """Row numbers to the smallest id that is reached over pairs at 0.8 or more, all pairs compared."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if similarity(sets[i], sets[j]) >= 0.8:
            root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), (True, 10 ** 9)), (key is not None, key or 0))
    return [(key, least[top(i)][1] if least[top(i)][0] else None) for i, (key, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def planted(prose):
    """Texts with copies in which some words are replaced, and texts that share a repeated line only."""
    draw, rows = random.Random(8), []
    for _ in range(70):
        words = prose(draw.randint(6, 400)).split()
        rows.append((len(rows), " ".join(words)))
        for _ in range(3):
            copy = list(words)
            for at in draw.sample(range(len(copy)), draw.randint(0, max(1, len(copy) // 30))):
                copy[at] = prose(1)
            rows.append((len(rows), " ".join(copy)))
    line = prose(12)
    rows += [(len(rows) + k, "\n".join([line] * 20 + [prose(60)])) for k in range(15)]
    return rows


def test_against_all_pairs(documents, planted, odd):
    rows = planted + [(10_000 + (i or 0) if i else None, t) for i, t in odd if len(t or "") < 5_000]
    got = [tuple(r) for r in similar_groups(documents(rows)).select("doc_id", "first").collect()]
    assert sorted(got, key=str) == sorted(groups(rows), key=str)


def test_stage_drops_near_copies_and_keeps_texts_with_a_common_line(spark, prose, documents):
    words = prose(150).split()
    near = list(words)
    for at in (30, 70, 110):
        near[at] = "other"
    line = prose(12)
    rows = [(1, " ".join(words)), (2, " ".join(near)), *[(10 + k, "\n".join([line] * 20 + [prose(60)])) for k in range(5)]]
    assert 0.8 <= similarity(grams(rows[0][1]), grams(rows[1][1])) < 0.9
    docs = pipeline.cut_lineage(documents(rows))
    assert sorted(r.doc_id for r in pipeline.duplicates(spark, docs, "").collect()) == [1, 10, 11, 12, 13, 14]


def test_buckets_meet_as_often_as_their_number_says(prose):
    draw, met, pairs, expected = random.Random(4), 0, 0, 0.0
    for _ in range(300):
        words = prose(120).split()
        copy = list(words)
        for at in draw.sample(range(120), 6):
            copy[at] = "other"
        a, b = shingle_set(" ".join(words), 5), shingle_set(" ".join(copy), 5)
        s = similarity(set(a.tolist()), set(b.tolist()))
        same = int((buckets(minima(a)) == buckets(minima(b))).sum())
        met, pairs, expected = met + same, pairs + BANDS, expected + BANDS * s ** BAND
        assert same or s < 0.8
    assert met == pytest.approx(expected, rel=0.1)


def test_tiles_and_parts_of_large_buckets(documents, planted, prose, monkeypatch):
    """Copies of one text with so many changes that few pairs are similar, and a bucket cut into many parts."""
    draw, base = random.Random(3), prose(120).split()
    rows = list(planted[:40])
    for k in range(60):
        copy = list(base)
        for at in draw.sample(range(120), draw.choice([1, 2, 3])):
            copy[at] = prose(1)
        rows.append((1_000 + k, " ".join(copy)))
    want = sorted(groups(rows), key=str)
    monkeypatch.setattr(similar, "STARS", 0)
    assert sorted(map(tuple, similar_groups(documents(rows)).collect()), key=str) == want
    for name, value in {"TILE": 7, "PAIRS_AT_ONCE": 50, "SETS": 40, "ROWS": 60}.items():
        monkeypatch.setattr(similar, name, value)
    assert sorted(map(tuple, similar_groups(documents(rows)).collect()), key=str) == want


def test_counts_of_common_shingles():
    draw = random.Random(2)
    sets = [np.array(sorted(draw.sample(range(400), draw.randint(0, 90))), np.uint64) for _ in range(30)]
    plain = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    assert common_counts(sets, 12, columns=16).tolist() == plain[:12, 12:].tolist()
    whole = common_counts(sets, columns=16)
    off = ~np.eye(30, dtype=bool)
    assert whole[off].tolist() == plain[off].tolist()


def test_sketches_keep_pairs_at_the_limit(prose):
    """Pairs a little above 0.8 agree in far more minima than are asked for."""
    draw = random.Random(6)
    for _ in range(200):
        words = prose(150).split()
        copy = list(words)
        for at in draw.sample(range(150), 3):
            copy[at] = "other"
        a, b = shingle_set(" ".join(words), 5), shingle_set(" ".join(copy), 5)
        if similarity(set(a.tolist()), set(b.tolist())) >= 0.8:
            assert (minima(a) == minima(b)).sum() >= similar.AGREE


def test_very_long_and_empty_tables(documents, prose):
    long = prose(60_000)
    rows = [(1, long), (2, long + " tail"), (3, prose(60_000)), (4, None), (5, "")]
    assert sorted(map(tuple, similar_groups(documents(rows)).collect())) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)]
    assert similar_groups(documents([])).collect() == []

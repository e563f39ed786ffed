import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import negatives
from turnwise.llm.negatives import Best, Block, mine_negatives, search

ROWS = "vec_id long, label int, vector array<long>, rank string, anchor string"


def plain(rows, is_anchor, positives=5, count=5):
    """All pairs scored; of rows with one id the least."""
    usable = {}
    for i, lab, v in rows:
        if i is not None and lab is not None and v is not None and None not in v:
            usable[i] = min(usable.get(i, (lab, v)), (lab, v))
    out = []

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    for a, (lab, v) in usable.items():
        if not is_anchor(a):
            continue
        scored = sorted((-score(v, w), i, other) for i, (other, w) in usable.items() if i != a)
        for s, p, other in [x for x in scored if x[2] == lab][:positives]:
            fits = [(-t, i) for t, i, o in scored if o != lab and 80 * -s <= 100 * -t <= 100 * -s][:count]
            out += [(a, p, k, i, -s, t) for k, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS)
    return sorted(map(tuple, mine_negatives(frame, F.col("vec_id") % 10 == 0, **how).collect()))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    out = []
    for i in range(600):
        label = draw.choice([0, 0, 0, 1, 2, 3, 50 + i])  # a hot label, some of one row
        out.append((i, label, [draw.randint(-9, 9) + 3 * (k == label) for k in range(6)]))
    same = [5, -5, 5, -5, 5, 5]
    out += [(1_000 + i, i % 3, same) for i in range(200)]  # a common vector: ties
    out += [(2_000, None, [1] * 6), (2_010, 1, None), (2_020, 1, [1, None, 1]), (None, 1, [9] * 6), (2_030, 1, []), (2_040, 2, [3, 3])]
    out += [out[10], out[10], (20, 99, [9] * 6), (2_050, 0, [0] * 6), (-10, 1, [-9, 9, 9, 1, 2, 3])]
    return out


@pytest.mark.parametrize("sizes", [(8_192, 1_024), (60, 9)])
def test_against_all_pairs(spark, rows, sizes):
    assert mined(spark, rows, block=sizes[0], chunk=sizes[1]) == plain(rows, lambda i: i % 10 == 0)


def test_other_counts_and_shares(spark, rows):
    got = mined(spark, rows, positives=2, negatives=1, block=100)
    assert got == plain(rows, lambda i: i % 10 == 0, 2, 1)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1, 2])]) == []
    assert mined(spark, [(0, 1, [1, 2]), (10, None, None)]) == []
    assert mined(spark, [(0, 1, [1, 2]), (1, 1, [-1, -2]), (2, 2, [1, 0])]) == []  # the only positive is below zero


def test_lists_are_not_read_to_their_ends():
    """Rows that stand out end the search early, and with the rows that a full scan finds."""
    draw = np.random.default_rng(4)
    vectors = draw.integers(-20, 20, (4_000, 4))
    vectors[:40] += 200
    block = Block(np.arange(4_000), np.zeros(4_000), vectors.astype(float))
    met = []
    reading = block.met
    block.met = lambda *a: met.append(reading(*a)) or met[-1]
    best = Best(None, None, 5)
    anchor = np.array([[3.0, 2.0, 1.0, 4.0]])
    search(block, anchor, [np.ones(4_000, bool)], [[best]])
    scores = vectors @ anchor[0]
    order = np.lexsort([np.arange(4_000), -scores])[:5]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
    assert len(np.unique(np.concatenate(met))) < 400


def test_threshold_must_fall_strictly_below():
    best = Best(None, None, 2)
    best.add(np.array([7, 7, 9]), np.array([5, 4, 6]))
    assert best.ids.tolist() == [6, 4] and not best.done(7.0) and best.done(6.9)
    window = Best(5, 8, 2)
    window.add(np.array([7, 9, 4]), np.array([1, 2, 3]))
    assert window.ids.tolist() == [1] and not window.done(5.0) and window.done(4.9)


def test_products_beyond_64_bits_end_the_job():
    with pytest.raises(ValueError):
        negatives.exact(np.full((1, 2), 1 << 40), np.full((1, 2), 1 << 40))
    assert negatives.exact(np.full((1, 2), 1 << 25), np.full((1, 2), 1 << 30)) == np.int64

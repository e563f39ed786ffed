import random
import re
from collections import Counter

import numpy as np
import pytest

from turnwise.llm import decontamination
from turnwise.llm.decontamination import RADIUS, build_index, find_contamination, matches

ITEMS = "item_id long, text string, similarity string, id int"


def grams(text):
    words = re.findall(r"\w+", (text or "").lower())
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)]


def best_similarity(text, item):
    """The largest similarity of a window of the item's size or, at the ends of the text, of a shorter one."""
    all_, own = grams(text), grams(item)
    windows = [all_[start:start + len(own)] for start in range(len(all_))] + [all_[:n] for n in range(1, min(len(own), len(all_)))]
    best = 0.0
    for window in windows:
        common = sum((Counter(window) & Counter(own)).values())
        best = max(best, common / (len(window) + len(own) - common))
    return best


@pytest.fixture(scope="module")
def planted(prose):
    draw = random.Random(2)
    items = [(i, prose(draw.randint(9, 90))) for i in range(40)]
    items += [(40, items[0][1]), (41, None), (42, ""), (43, "only four words here"), (None, prose(30)), (44, prose(400))]
    docs = []
    for n, (_, text) in enumerate(items):
        words = (text or "").split()
        docs.append((n, f"{prose(draw.randint(0, 200))} {text} {prose(draw.randint(0, 200))}"))
        docs.append((100 + n, prose(50) + "\n" + (text or "").upper().replace(" ", ", ") + "! " + prose(3)))
        changed = list(words)
        if changed:
            changed[draw.randrange(len(changed))] = "other"
        docs.append((200 + n, prose(40) + " " + " ".join(changed) + " " + prose(40)))
        docs.append((300 + n, " ".join(words[1:])))
    docs += [(400 + n, prose(300)) for n in range(20)]
    return items, docs


def test_against_all_windows(spark, documents, planted, odd):
    items, docs = planted
    docs = docs + odd[:6] + odd[7:9]
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in items], ITEMS)
    got = find_contamination(documents(docs), frame).collect()
    found = {(r.doc_id, r.item_id): r.similarity for r in got}
    texts = [t for _, t in docs]
    missed, near = 0, 0
    for (d, text) in docs:
        for (i, item) in items:
            best = best_similarity(text, item) if grams(item) else 0.0
            if best == 1.0:
                assert found.pop((d, i)) == 1.0
            elif best >= 0.8:
                near += 1
                missed += found.pop((d, i), None) is None
    assert not found  # nothing below the similarity
    assert missed <= 0.01 * near  # the fingerprints of near copies may differ in more bits than the radius
    assert len(texts) == len(docs)


def test_blocks_of_items_and_long_documents(spark, documents, planted, monkeypatch, prose):
    items, docs = planted
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in items], ITEMS)
    whole = sorted(map(tuple, find_contamination(documents(docs), frame).collect()), key=str)
    assert sorted(map(tuple, find_contamination(documents(docs), frame, items_at_once=7).collect()), key=str) == whole
    long = " ".join(t for _, t in docs)
    index = build_index([t for _, t in items], RADIUS)
    once = matches([long, None, long], index, 0.8)
    monkeypatch.setattr(decontamination, "AT_ONCE", 7)
    assert matches([long, None, long], index, 0.8) == once
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 2_000)
    assert sorted(map(tuple, find_contamination(documents(docs), frame).collect()), key=str) == whole
    assert {i for _, i in once} == {n for n, (_, t) in enumerate(items) if grams(t)}


def test_empty(spark, documents):
    items = spark.createDataFrame([(1, "one two three four five six", "x", 0)], ITEMS)
    assert find_contamination(documents([]), items).collect() == []
    assert find_contamination(documents([(1, "one two three four five six")]), items.limit(0)).collect() == []
    got = find_contamination(documents([(1, "x one TWO three four five six"), (1, "x one TWO three four five six")]), items).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1.0, 1, 6)] * 2


def test_the_skip_loses_nothing(planted, prose):
    """Windows that hold too few known shingles are not looked at; without that the result is the same."""
    items, docs = planted
    index = build_index([t for _, t in items], RADIUS)
    texts = [t for _, t in docs] + [items[0][1][:200] + " " + prose(50), (items[1][1] + " ") * 3, prose(400)]
    assert matches(texts, index, 0.8) == matches(texts, index, 0.8, skip=False)
    assert matches(texts, index, 0.6) == matches(texts, index, 0.6, skip=False)


@pytest.mark.parametrize("end", [False, True])
def test_passages_cut_off_at_the_ends_of_a_text(prose, end):
    """A little more than 0.8 of an item, at the beginning or the end of a longer text."""
    draw, found = random.Random(11), 0
    for _ in range(200):
        item = prose(draw.randint(20, 90)).split()
        kept = -(-(len(item) - 4) * 42 // 50) + 4
        part = item[:kept] if end else item[-kept:]
        text = " ".join([*prose(80).split(), *part] if end else [*part, *prose(80).split()])
        assert 0.8 <= best_similarity(text, " ".join(item)) < 0.9
        found += bool(matches([text], build_index([" ".join(item)], RADIUS), 0.8))
    assert found >= 199


def recall(prose, draw, low, high, cases):
    """Share of altered items inside longer texts that are found, for best similarities in a range."""
    found = tried = 0
    while tried < cases:
        item = prose(draw.randint(20, 90)).split()
        copy = list(item)
        for at in draw.sample(range(len(copy)), draw.randint(1, 4)):
            copy[at] = "other"
        text = " ".join([*prose(40).split(), *copy, *prose(40).split()])
        if low <= best_similarity(text, " ".join(item)) < high:
            tried += 1
            found += bool(matches([text], build_index([" ".join(item)], RADIUS), 0.8))
    return found / tried


@pytest.mark.parametrize("low, high, least", [(0.8, 0.85, 0.99), (0.85, 0.9, 0.995), (0.9, 1.0, 1.0)])
def test_recall_by_similarity(prose, low, high, least):
    assert recall(prose, random.Random(12), low, high, 100) >= least


def test_words():
    text = "Zürich's naïve_x 東京 İ 3½ \U0001f600 e\u0301 \ud800 \n a" * 3
    words = re.findall(r"\w+", text.lower())
    got = decontamination.word_hashes(text.lower())
    assert len(got) == len(words) and len(set(got.tolist())) == len(set(words))
    assert dict(zip(words, got.tolist())) == {w: int(decontamination.word_hashes(w)[0]) for w in words}


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = "Some words, one_two three; 東京 four " * 40
    whole = decontamination.shingles(text)
    monkeypatch.setattr(decontamination, "LETTERS", 10)
    assert decontamination.shingles(text).tolist() == whole.tolist()


@pytest.mark.parametrize("items", [40, 3_000])
def test_multi_index_guarantees_the_radius(items):
    draw = np.random.default_rng(1)
    hashes = [(k, draw.integers(0, 2 ** 63, 30, dtype=np.uint64)) for k in range(items)]
    index = decontamination.ItemIndex(30, hashes + [(99, hashes[0][1])], RADIUS)
    prints = np.tile(index.prints, 100)[:4_000]
    for k in range(len(prints)):
        for b in draw.choice(64, draw.integers(0, 24), replace=False):
            prints[k] ^= np.uint64(1) << np.uint64(b)
    near = np.nonzero(np.bitwise_count(prints[:, None] ^ index.prints[None, :]) <= RADIUS)
    got = index.candidates(prints)
    assert [x.tolist() for x in got] == [x.tolist() for x in near]

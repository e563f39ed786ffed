import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from turnwise.llm import mixing
from turnwise.llm.mixing import NEAR, count_words, mix_documents, mixture, source_targets

DOCS = "doc_id long, text string, source string, size int, u string, mix int"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Shares by weight, the excess shared again until no target is above three times its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1.0 + k % 3 for k, s in enumerate(order)}
    total, bounded = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in bounded]
        if not free:
            return {s: 3.0 * sizes[s] for s in sizes}
        level = (total - sum(3.0 * sizes[s] for s in bounded)) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 3.0 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in bounded else level * weight[s] for s in sizes}
        bounded |= above


def plain(rows):
    """The mix in a loop: documents by their odds, those that are too large passed over, as long as one fits."""
    sizes, out = {}, []
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    target = targets(sizes)
    for source, size in sizes.items():
        own = [(i, t) for i, t, s in rows if s == source]
        ratio = target[source] / size if size else 0.0
        whole = int(ratio)
        p, extra = ratio - whole, set()
        if p > 0:
            units = {}
            for i, t in own:
                text = hashlib.md5((t or "").encode()).hexdigest()
                draw = hashlib.md5(f"12|{'null' if i is None else i}|{text}".encode()).hexdigest()[:13]
                u = (int(draw, 16) + 0.5) / float(1 << 52)
                if words(t):
                    units.setdefault((u / (1 - u) / (p / (1 - p)), words(t)), []).append((i, t))
            missing, going = target[source] - whole * size, True
            while going and missing > NEAR * target[source]:
                room, run, new = missing, 0, []
                for (odds, n), docs in sorted(units.items()):
                    if (odds, n) not in extra and n <= room:
                        run += n * len(docs)
                        if run > room:
                            break
                        new.append((odds, n))
                        missing = room - run
                extra |= set(new)
                going = bool(new)
            left = sorted((n, odds) for odds, n in units if (odds, n) not in extra)
            if left and missing > NEAR * target[source] and left[0][0] - missing < missing:
                extra.add(left[0][::-1])
            chosen = [d for key in extra for d in units[key]]
        else:
            chosen = []
        for i, t in own:
            n = words(t)
            out.append((i, n, size, target[source], n * (whole + ((i, t) in chosen))))
    return sorted(out, key=str)


def mixed(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS)
    got = mix_documents(frame).select(
        "row.doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))
    return sorted(map(tuple, got.collect()), key=str)


@pytest.fixture(scope="module")
def rows(prose):
    draw, out = random.Random(7), []
    for i in range(600):
        source = draw.choice(["hot", "hot", "hot", "a", "b", "Ö", "z", None])
        out.append((i, prose(int(draw.paretovariate(1.1) * 6)), source))
    out += [(1_000, prose(20_000), "a"), (1_001, prose(4), "tiny"), (1_002, None, "b"), (1_003, "", "none"), (1_004, " \t\n", "none")]
    out += [(None, prose(30), "a"), (None, prose(40), "b"), (5, prose(12), "z"), (1_005, "same text", "z"), (1_005, "same text", "z")]
    return out


def test_against_a_loop(spark, rows, monkeypatch):
    want = plain(rows)
    assert mixed(spark, rows) == want
    monkeypatch.setattr(mixing, "BUCKETS", 3)
    assert mixed(spark, rows) == want


def test_targets_are_met(spark, rows):
    taken, sources = {}, {}
    by_id = {(i, words(t)): s for i, t, s in rows}
    for i, size, source_size, target, words_taken in mixed(spark, rows):
        source = by_id[i, size]
        taken[source] = taken.get(source, 0) + words_taken
        sources[source] = (source_size, target)
        assert words_taken <= 3 * size
    assert sum(t for _, t in sources.values()) == pytest.approx(sum(s for s, _ in sources.values()))
    for source, (size, target) in sources.items():
        assert target <= 3 * size
        if source in ("hot", "b", "z", "Ö", None):
            assert taken[source] == pytest.approx(target, rel=0.02)
    # Source a wants fewer words than its one very long document has: all others are taken, and it would not bring them nearer.
    assert taken["a"] < sources["a"][1] < 20_000 and taken["a"] == sum(words(t) for _, t, s in rows if s == "a") - 20_000


def test_inclusion_follows_the_odds(spark):
    """A source of equal documents takes each of them equally often over the seeds."""
    rows = [(i, "one two three", s) for s in "ab" for i in range(40 * (s == "b"), 40 + 80 * (s == "b"))]
    frame, times, seeds = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS), {}, 5
    for seed in range(seeds):
        for r in mix_documents(frame, seed=seed).select("row.doc_id", "mix.copies").collect():
            times[r.doc_id] = times.get(r.doc_id, 0) + r.copies
    # Weights 1 and 2 over 40 and 80 documents: each is taken once.
    assert set(times.values()) == {seeds}
    skewed = spark.createDataFrame([(i, "one two three", "a" if i < 90 else "b", 1, "x", 2) for i in range(180)], DOCS)
    share = [0.0] * 180
    for seed in range(seeds):
        for r in mix_documents(skewed, seed=seed).select("row.doc_id", "mix.copies").collect():
            share[r.doc_id] += r.copies / seeds
    assert sum(share[:90]) == pytest.approx(60, abs=0.5) and sum(share[90:]) == pytest.approx(120, abs=0.5)
    assert 0.3 < sum(share[:45]) / 45 < 0.98 and min(share[90:]) >= 1.0


def test_mixture_repeats_rows(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS)
    got = mixture(frame)
    assert got.columns == frame.columns
    want = mix_documents(frame).agg(F.sum(F.col("mix.copies") * F.col("mix.size"))).first()[0]
    assert sum(words(r.text) for r in got.collect()) == want


def test_empty(spark):
    assert mixed(spark, []) == []
    assert mixed(spark, [(1, None, "a"), (2, " ", None)]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_bounded_targets(spark):
    sizes = {"a": 100_000, "b": 10, "c": 500, "d": 0, None: 7}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(frame, (1, 2, 3), 3).collect()}
    assert got == pytest.approx(targets(sizes))


def test_words():
    for text in (None, "", "a", " a", "a ", "a b \x1c c\n\nd", "\x0b\x0c", "東京 x"):
        assert count_words(text) == words(text)

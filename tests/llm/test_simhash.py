import random
import re

import numpy as np
import pytest
import xxhash

from turnwise.llm import simhash
from turnwise.llm.simhash import components, links, near_duplicates, near_pairs


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=4):
    """The smallest place that each place can reach, by comparing all pairs."""
    prints = np.array(prints, np.uint64)
    least = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    while True:
        new = np.array([least[row].min() for row in near])
        if (new == least).all():
            return least.tolist()
        least = new


def test_whole_operator(spark, documents, odd, prose):
    base = prose(400).split()
    near = [(100 + k, " ".join(base[:k * 7] + ["changed"] + base[k * 7 + 1:])) for k in range(12)]
    rows = odd + near + [(50, prose(20)), (51, None)]
    got = sorted(map(tuple, near_duplicates(documents(rows)).collect()), key=str)
    prints = [plain_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    groups = {}
    for i, c in zip(ids, classes(prints)):
        groups.setdefault(c, []).append(i)
    least = {c: min((i for i in g if i is not None), default=None) for c, g in groups.items()}
    want = [(i, f"{p:016x}", least[c]) for i, p, c in zip(ids, prints, classes(prints))]
    assert got == sorted(want, key=str)


def test_fingerprint_of_long_texts_is_made_in_parts(prose):
    text = prose(70_000)
    hashes = simhash.shingle_hashes(text, 4)
    counts = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    assert simhash.majority_bits(hashes) == int("".join("1" if 2 * c > len(hashes) else "0" for c in counts), 2)


def test_empty(spark, documents):
    assert near_duplicates(documents([])).collect() == []
    assert [tuple(r) for r in near_duplicates(documents([(3, "only one")])).collect()] == [
        (3, f"{plain_fingerprint('only one'):016x}", 3)]


def cloud(draw, centres, around, bits):
    out = set()
    for _ in range(centres):
        centre = draw.getrandbits(64)
        for _ in range(around):
            value = centre
            for b in draw.sample(range(64), draw.randint(0, bits)):
                value ^= 1 << b
            out.add(value)
    return sorted(out)


@pytest.mark.parametrize("node_rows, node_bits", [(4096, 6), (8, 5), (3, 16)])
def test_links_of_dense_clouds(spark, node_rows, node_bits):
    """Links and their components are the same however nodes are split."""
    prints = cloud(random.Random(5), 3, 150, 7) + cloud(random.Random(6), 300, 1, 0) + [0, (1 << 64) - 1, 15, 31]
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fingerprint long")
    edges = links(frame, node_rows=node_rows, node_bits=node_bits)
    assert edges.count() < 20 * len(prints)  # forests, not all pairs
    root = {r.node: r.root for r in components(edges).collect()}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    got = [root.get(s, s) for s in signed]
    want = classes(prints)
    same = {}
    for g, w in zip(got, want):
        assert same.setdefault(w, g) == g
    assert len(set(same.values())) == len(same)


@pytest.mark.parametrize("equal", [1, 2, 3, 4])
def test_every_trie_choice_finds_all_pairs(equal):
    draw, radius = random.Random(equal), 4
    prints = np.array(cloud(draw, 12, 12, 5), np.uint64)
    found = set()
    for order, depth in simhash.trie_orders(radius, equal):
        path = simhash.permuted(prints, order)
        at = np.argsort(path)
        path = path[at]
        top = path >> np.uint64(64 - depth)
        start = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        end = np.append(start[1:], len(top))
        none = np.zeros(len(start), np.int64)
        for i, j in near_pairs(path, path, (start, end, start, end, none, np.ones(len(start), bool)), depth, radius):
            found |= {tuple(sorted(p)) for p in zip(at[i].tolist(), at[j].tolist())}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    assert found == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}


def test_number_of_tries_follows_the_fingerprints():
    assert [simhash.equal_blocks(n, 4) for n in (0, 100_000, 10_000_000, 10 ** 9, 10 ** 12)] == [1, 1, 2, 3, 4]


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    frame = spark.createDataFrame(chain + star + [(5000, 4999), (5000, 5000)], "u long, v long")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)} | {5000: 4999}
    assert components(frame.limit(0)).collect() == []


def test_dense_nodes_go_down_in_rounds(spark):
    """Thousands of parts of one node: only pairs that live in the radius are met, far fewer than all."""
    draw = np.random.default_rng(3)
    prints = np.unique(draw.integers(0, 1 << 40, 6_000, dtype=np.uint64))  # one node of the tries with the upper bits at their top
    frame = spark.createDataFrame([(int(p),) for p in prints.astype(np.int64)], "fingerprint long")
    equal = 1
    depths = [depth for _, depth in simhash.trie_orders(4, equal)]
    places = frame.mapInPandas(simhash.place_task(4, equal), "trie int, top long, path long, fingerprint long")
    rows = simhash.node_pairs(places.where("trie = 0"), depths, 4, 8, 4).select("pair", "side").collect()
    pairs = {r.pair for r in rows}
    assert 0 < len(pairs) < 0.02 * len(prints) ** 2 / 2
    sizes = {}
    for r in rows:
        sizes[r.pair, r.side] = sizes.get((r.pair, r.side), 0) + 1
    assert max(sizes.values()) <= 8

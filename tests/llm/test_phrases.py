import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark import cloudpickle

from turnwise.llm import phrases
from turnwise.llm.phrases import BREAK, Codes, encode, mine_phrases

DOCS = "doc_id long, text string, lang string, phrase string, n int, key long"


def pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
        yield re.findall(r"[^\x20\x09]+", piece)


def plain(rows, least, top):
    """All phrases counted, all cuts scored, all longer candidates looked at."""
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        for words in pieces(text):
            for k in range(1, 6):
                counts["und" if lang is None else lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                dropped |= {p[i:i + k] for i in range(len(p) - k + 1) if 100 * a >= 100 * f[p[i:i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, text.decode(), -a, left, right, n, -score)
                for rank, (score, a, text, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    return sorted(map(tuple, mine_phrases(frame, bits=20, **how).collect()))


@pytest.fixture(scope="module")
def rows():
    """Words of very different frequency, fixed phrases, copies, passages that share words, all kinds of breaks."""
    draw, out = random.Random(5), []
    words = [f"w{k}" for k in range(300)] + ["Ärger", "東京", "it's", "x y"]
    weights = [1 / (k + 1) for k in range(len(words))]
    fixed = [["New", "York", "City"], ["a", "a", "a", "a", "a", "a"], ["once", "upon", "a", "time", "there", "was"], ["w0", "w1"]]
    for i in range(400):
        tokens = []
        for _ in range(draw.randint(0, 60)):
            tokens += draw.choice(fixed) if draw.random() < 0.08 else draw.choices(words, weights)
        text = "".join(t + draw.choice([" "] * 8 + [". ", "\n", ", ", "\t", "  ", "?!", "\r\n"]) for t in tokens)
        out.append((i, text, draw.choice(["en", "en", "en", "de", None, "und"])))
    out += [(1_000 + k, "Rare copied passage of seven words here", "de") for k in range(30)]
    out += [(1_000, "Rare copied passage of seven words here", "de"), (None, "w0 w1 w2", None), (1, None, "en"), (2, "", "fr"), (3, " .. \n", "fr")]
    return out


@pytest.mark.parametrize("least, top", [(8, 2_000), (5, 12)])
def test_against_all_phrases(spark, rows, least, top):
    assert mined(spark, rows, least=least, top=top) == plain(rows, least, top)


def test_small_parts_and_a_full_bit_table(spark, rows, monkeypatch):
    """Few codes at a time, a frontier in many parts, and bit tables in which nearly all bits are set change nothing."""
    want = plain(rows, 6, 10)
    assert mined(spark, rows, least=6, top=10, shares=(0.01, 0.3, 1.0)) == want
    monkeypatch.setattr(phrases, "HELD", 700)
    monkeypatch.setattr(phrases, "ROW", 90)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    assert sorted(map(tuple, mine_phrases(frame, least=6, top=10, bits=15).collect())) == want


def test_scores_close_first_words(spark, rows, monkeypatch):
    """Frequent first words are never expanded once enough phrases score above their bound."""
    made, making = [], phrases.bit_table
    monkeypatch.setattr(phrases, "bit_table", lambda keys, bits: made.append(keys) or making(keys, bits))
    big = [(i, t, "en") for i, t, _ in rows]
    assert mined(spark, big, least=8, top=3, shares=(0.35, 1.0)) == plain(big, 8, 3)
    frequent = made[0].count()
    expanded = sum(k.count() for k in made[1:] if set(k.columns) == {"key", "phrase"})
    assert 0 < expanded < frequent


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, None, None), (2, "", "en"), (3, "a few words", "en")]) == []


def test_codes_of_long_texts_are_those_of_short_steps():
    text = "One two,three\nfour\tfive .. six x " * 50
    codes, again = Codes("en", 0), Codes("en", 0)
    whole = encode(text, codes)
    assert np.array_equal(whole, encode(text, again, at_once=7))
    spelling = {c: w for w, c in codes.items()}
    kept = [spelling[c].decode() for c in whole.tolist() if c]
    assert kept == [w for words in pieces(text) for w in words]
    assert Codes("de", 0)[b"one"] != codes[b"one"] and codes[BREAK] == 0


def test_rows_of_codes_are_small_and_read_in_parts(monkeypatch):
    """10,000 rows, as many as an Arrow batch has, hold about 10 MB of codes; parts of a batch end with a break."""
    words = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["four words a piece. " * 100_000]})
    rows = list(phrases.encode_task(0)(iter([words])))
    sizes = [len(x) for batch in rows for x in batch.column("codes").to_pylist()]
    assert max(sizes) <= 2_048 and sum(sizes) == 8 * 500_001
    monkeypatch.setattr(phrases, "HELD", 1_000)
    whole = np.concatenate([np.frombuffer(x, np.uint64) for batch in rows for x in batch.column("codes").to_pylist()])
    parts = list(phrases.held_codes(batch.slice(0, 3_000) for batch in rows))
    assert max(map(len, parts)) <= 1_010 and all(part[-1] == 0 for part in parts)
    skipped = list(phrases.held_codes(batch.slice(2) for batch in rows))
    first = sum(len(x) // 8 for x in rows[0].column("codes").to_pylist()[:2])
    assert len(rows) > 1 or np.array_equal(np.concatenate(skipped), whole[first:])


def test_two_words_of_one_code_lead_to_another_seed(spark, monkeypatch):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = [(k, "same words again and again", "en") for k in range(12)]
    assert weak_code(b"en\0same", 0) == weak_code(b"en\0words", 0)
    monkeypatch.setattr(phrases, "word_code", weak_code)
    assert mined(spark, rows, least=10) == plain(rows, 10, 2_000)


def weak_code(word, seed):
    return 77 if not seed and word.endswith((b"same", b"words")) else xxhash.xxh64_intdigest(word, seed)

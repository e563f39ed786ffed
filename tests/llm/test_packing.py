import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from turnwise.llm import packing
from turnwise.llm.packing import WordEncoder, pack, plan_slots

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH)


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text() | st.sampled_from([
    "The End.", "it's", "I'LL", "  two  blanks\n\n", "<|endoftext|>x", "<|STARTOFTEXT|>", "É", "é", "ΑΣ ΑΣΑ", "İI", " ", "\x1c", "\x85",
    "1234", "!!!", "µ", "ÿŸ", "東京"])).map("".join))
def test_words_give_the_ids_of_the_text(text):
    assert ENCODER.encode([text, text + " " + text]) == [
        np.asarray(plain_ids(t), "<u4").tobytes() for t in (text, text + " " + text)]


def test_full_memory_changes_nothing(prose, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 10)
    encoder, texts = WordEncoder(PATH), [prose(50), prose(50), "x" * 500, ""]
    assert encoder.encode(texts) == [np.asarray(plain_ids(t), "<u4").tobytes() for t in texts]
    assert len(encoder.known) <= 10


@pytest.mark.parametrize("capacity", [4096, 64])
def test_whole_operator(spark, documents, odd, prose, capacity):
    rows = odd + [(200 + i, prose(12)) for i in range(60)] + [(300 + i, "equal length") for i in range(80)]
    got = pack(documents(rows).repartition(5), PATH, capacity=capacity).collect()
    want = Counter()
    for i, text in rows:
        ids = plain_ids(text) + [1]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.asarray(ids[start:start + capacity], "<u4").tobytes()
            want[i, piece, start, len(part) // 4, part, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids), r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // capacity) + 1


def test_empty(spark, documents):
    assert pack(documents([]), PATH).collect() == []


def best_fit(lengths, capacity):
    """Number of sequences of plain best-fit decreasing, piece by piece."""
    room = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, r in enumerate(room) if r >= length]
        if fitting:
            i = min(fitting, key=lambda i: room[i])
            room[i] -= length
        else:
            room.append(capacity - length)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_is_best_fit(lengths):
    slots = plan_slots(Counter(lengths), 40)
    assert len({tuple(s) for s in slots.tolist()}) == len(slots)
    places = defaultdict(list)
    for length in set(lengths):
        own = sorted(s for s in slots.tolist() if s[0] == length)
        ends = [s[1] for s in own[1:]] + [lengths.count(length)]
        for (_, rank, first, offset), end in zip(own, ends):
            for k in range(rank, end):
                places[first + k - rank].append((offset, length))
    for content in places.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= 40
    assert sum(map(len, places.values())) == len(lengths)
    assert len(places) == best_fit(lengths, 40)


def test_word_memory_is_bounded_and_changes_no_ids(monkeypatch):
    """Words beyond the memory, and very long ones, are forgotten after their call; all ids are those of whole texts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "KEPT_WORDS", 6)
    encoder, whole = packing.WordEncoder(path), Tokenizer.from_file(path)
    for texts in (["one two three", "", "two two"], ["four five six seven eight", "x" * 100 + " one"], ["nine eight one"]):
        ids = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert ids == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) <= 6 and all(len(w) <= packing.KEPT_LENGTH for w in encoder.known)

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from turnwise.llm import tokens
from turnwise.llm.tokens import CACHE, count_tokens, read_cache, tokenizer_version

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [MODEL, WORDS])
def test_counts(spark, documents, odd, tmp_path, path):
    if path == MODEL:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    cache = str(tmp_path / "cache")
    got = count_tokens(documents(odd), path, cache)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 4096) for i, t in odd]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert read_cache(spark, cache).count() == len({t or "" for _, t in odd})


def test_only_misses_are_encoded(spark, documents, tmp_path):
    cache = str(tmp_path / "cache")
    assert count_tokens(documents([]), MODEL, cache).collect() == []
    count_tokens(documents([(1, "first text"), (2, "first text")]), MODEL, cache).collect()
    # A stored count is taken as it is: put a wrong one there to see it used.
    digest = read_cache(spark, cache).first()["digest"]
    other = str(tmp_path / "other")
    spark.createDataFrame([(digest, tokenizer_version(MODEL), 77), (digest, "old version", 5)], CACHE).write.parquet(other)
    got = {r.doc_id: r.n_tokens for r in count_tokens(documents([(1, "first text"), (2, "second")]), MODEL, other).collect()}
    assert got[1] == 77 and got[2] != 77
    assert read_cache(spark, other).where(f"tokenizer = '{tokenizer_version(MODEL)}'").count() == 2


def test_few_texts_leave_an_arrow_batch_at_a_time(monkeypatch):
    """A task holds the texts of one call as Python objects, not those of a whole batch."""
    import pyarrow as pa

    calls = []
    monkeypatch.setattr(tokens, "_counter", lambda path: lambda texts: calls.append(len(texts)) or [len(t) for t in texts])
    texts = ["x" * i for i in range(150)]
    batch = pa.RecordBatch.from_pydict({"digest": [bytes([i]) for i in range(150)], "text": texts})
    out = pa.Table.from_batches(tokens.count_texts("a path that no other test uses")(iter([batch, batch.slice(0, 0)])))
    assert out.to_pydict() == {"digest": [bytes([i]) for i in range(150)], "n_tokens": list(range(150))}
    assert sum(calls) == 150 and max(calls) <= tokens.TOGETHER

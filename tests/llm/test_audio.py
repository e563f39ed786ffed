import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from turnwise.llm import audio


def test_media_and_features(spark, documents, odd):
    media = audio.store_media(documents(odd))
    got = audio.audio_features(media).withColumn("payload", audio.wav_samples(F.col("media"))).collect()
    assert len(got) == len(odd)
    want = sorted(((i is None, i), (t or "").encode()) for i, t in odd)
    found = sorted(((r.id is None, r.id), bytes(r.payload), r) for r in got)
    lines = {}
    for (_, raw), (_, payload, r) in zip(want, found):
        padded = raw + b" " * (192 if not raw else -len(raw) % 192)
        assert payload == padded and r.n_bytes == len(raw)
        rate, samples = audio.read_wav(bytes(r.media))
        assert rate == audio.RATE and samples.tobytes() == padded
        assert lines.setdefault(payload, r.feature) == r.feature
        table = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        assert table.schema.field("tensor").type.shape == [audio.PATCH, audio.MELS]
        assert sum(table["frames"].to_pylist()) == r.n_frames
        assert table["start"].to_pylist()[0] == 0 and all(a < b for a, b in zip(table["start"].to_pylist(), table["end"].to_pylist()))
        assert all(0 <= s.start < s.end <= table["end"].to_pylist()[-1] + 1e-9 for s in r.spans)
    assert audio.audio_features(audio.store_media(documents([]))).collect() == []


def test_digests_of_the_query(spark, documents, tmp_path):
    folder = str(tmp_path)
    documents([(1, "abc"), (2, None)]).write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in audio.op1_audio_features(spark, folder).collect()}
    payload = b"abc".ljust(192)
    assert got[1].payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert got[1].tail_crc32 == zlib.crc32(payload[-16:]) and got[1].payload_bytes == 192 and got[1].media_bytes == 236
    assert got[2].n_bytes == 0 and got[2].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest()


def test_resampling_keeps_a_tone():
    n, rate, tone = 12_000, 12_000, 440.0
    y = audio.resample(np.sin(2 * np.pi * tone * np.arange(n) / rate).astype(np.float32))
    assert len(y) == 16_000
    peak = np.argmax(np.abs(np.fft.rfft(y * np.hanning(len(y))))) * 16_000 / len(y)
    assert abs(peak - tone) <= 1.0
    assert np.allclose(audio.resample(np.ones(500, np.float32))[40:-40], 1, atol=1e-5)


def test_polyphase_is_the_plain_filter():
    x = np.random.default_rng(0).normal(size=101).astype(np.float32)
    phases = audio.filter_phases()
    taps = phases.shape[1]
    padded = np.concatenate([np.zeros(taps // 2), x, np.zeros(taps + audio.DOWN)])
    plain = []
    for m in range(-(-len(x) * audio.UP // audio.DOWN)):
        at, phase = divmod(m * audio.DOWN, audio.UP)
        plain.append(sum(phases[phase, k] * padded[at + k + 1 - taps % 2] for k in range(taps)))
    assert np.allclose(audio.resample(x), plain, atol=1e-4)


def test_spans():
    assert audio.sound_spans(np.ones(50)) == []
    energy = np.concatenate([np.zeros(20), np.ones(5) * 0.6, np.ones(10) * 2, np.ones(5) * 0.6, np.zeros(20)])
    (a, b), = audio.sound_spans(energy)
    assert 20 <= a <= 25 and b == 40


def test_mel_frames():
    weights = audio.mel_weights(16_000)
    assert weights.shape == (257, 40) and (weights.sum(axis=0) > 0).all()
    assert len(audio.log_mel(np.zeros(1, np.float32), weights)) == 1
    assert len(audio.log_mel(np.zeros(401, np.float32), weights)) == 2
    tone = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000).astype(np.float32)
    assert audio.log_mel(tone, weights).mean(axis=0).argmax() == weights[32].argmax()
